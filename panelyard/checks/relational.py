"""Joins, alignment, set operations and audits of tables.

Two sparse blocks with different gaps are made up by rules on code and month: alignment is about such gaps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.checks.evaluation import r, tidy
from panelyard.plans import compile as C
from panelyard.plans.nodes import DAILY, Language
from panelyard.plans.stages import promoted
from panelyard.sources import cleaning, panels

BARS = panels.bars_sql()
X, Y = "(code + month(date)) % 4 <> 0", "(code + month(date)) % 5 <> 0"


def blocks(s, sf):
    b = panels.bars(s, sf, True)
    return {"x": b.where(X).select("date", "code", F.col("close").alias("value")), "y": b.where(Y).select("date", "code", F.col("volume").alias("value"))}


BLOCKS_SQL = f"{panels.bars_sql(True)}, x as (select date, code, close as x, true as present_x from bars where {X}), y as (select date, code, volume as y, true as present_y from bars where {Y})"
OVER = Language("blocks", ("x", "y"), frozenset({"daily"}), DAILY.ops)


def _bars(s, sf):
    return panels.bars(s, sf).select("date", "code", "close")


def all_checks() -> dict:
    days = lambda s, sf: _bars(s, sf).where("month(date) = 1").select("date").distinct()
    early = lambda s, sf: _bars(s, sf).where("year(date) < 1997")
    late = lambda s, sf: _bars(s, sf).where("year(date) > 1995").withColumn("close", F.col("close") * 2)
    early_sql, late_sql = "early as (select date, code, close from bars where year(date) < 1997)", "late as (select date, code, close * 2 as close from bars where year(date) > 1995)"
    broken = lambda s, sf: C.union_keep_last(_bars(s, sf), _bars(s, sf).where("year(date) = 1996").withColumn("close", F.when(F.col("code") != 3, F.col("close") + 1))).where("code <> 5 or year(date) <> 1997")
    return {
        "join_align_blocks": (lambda s, sf: tidy(C.align(blocks(s, sf))), f"with {BLOCKS_SQL} select date, code, {r('x')}, {r('y')}, coalesce(present_x, false) present_x, coalesce(present_y, false) present_y from x full join y using (date, code)"),
        "join_over_blocks": (lambda s, sf: tidy(C.over_blocks(C.align(blocks(s, sf)), "sub ts_delta W5 x ts_delta W5 y", OVER)), f"with {BLOCKS_SQL}, a as (select date, code, x - lag(x, 5) over (partition by code order by date) a from x), b as (select date, code, y - lag(y, 5) over (partition by code order by date) b from y) select date, code, {r('a - b', 'factor')} from a join b using (date, code)"),
        "join_reindex": (lambda s, sf: tidy(C.reindex(_bars(s, sf), blocks(s, sf)["x"])), f"with {BLOCKS_SQL} select b.date, b.code, {r('x', 'value')} from bars b left join x using (date, code)"),
        "join_semi": (lambda s, sf: tidy(_bars(s, sf).join(days(s, sf), "date", "left_semi")), f"with {BARS} select date, code, {r('close')} from bars where date in (select date from bars where month(date) = 1)"),
        "join_anti": (lambda s, sf: tidy(_bars(s, sf).join(days(s, sf), "date", "left_anti")), f"with {BARS} select date, code, {r('close')} from bars where date not in (select date from bars where month(date) = 1)"),
        "join_one_to_one": (lambda s, sf: tidy(cleaning.assert_unique(early(s, sf), ("date", "code")).join(late(s, sf).withColumnRenamed("close", "other"), ["date", "code"])), f"with {BARS}, {early_sql}, {late_sql} select e.date, e.code, {r('e.close', 'close')}, {r('l.close', 'other')} from early e join late l using (date, code)"),
        "join_match_coverage": (lambda s, sf: tidy(early(s, sf).join(late(s, sf).select("date", "code", F.lit(1).alias("hit")), ["date", "code"], "left").groupBy("date").agg((F.count("hit") / F.count(F.lit(1))).alias("matched"))), f"with {BARS}, {early_sql}, {late_sql} select e.date, {r('count(l.close) / count(*)', 'matched')} from early e left join late l using (date, code) group by e.date"),
        "set_union_keep_last": (lambda s, sf: tidy(C.union_keep_last(early(s, sf), late(s, sf))), f"with {BARS}, {early_sql}, {late_sql} select date, code, {r('close')} from (select * from late union all select * from early e where not exists (select 1 from late l where l.date = e.date and l.code = e.code))"),
        "set_intersect": (lambda s, sf: early(s, sf).select("date").intersect(late(s, sf).select("date")), f"with {BARS}, {early_sql}, {late_sql} select date from early intersect select date from late"),
        "set_except": (lambda s, sf: early(s, sf).select("date").distinct().exceptAll(late(s, sf).select("date").distinct()), f"with {BARS}, {early_sql}, {late_sql} select date from early except select date from late"),
        "sort_top_per_group": (lambda s, sf: tidy(cleaning.last_of_key(_bars(s, sf), ("code",), ("close", "date"))), f"with {BARS} select date, code, {r('close')} from bars qualify row_number() over (partition by code order by close desc, date desc) = 1"),
        "audit_schema": (lambda s, sf: cleaning.audit_schema(panels.bars(s, sf), {"close": (), "typical": ("high", "low", "close"), "spread": ("bid", "ask"), "code": ()}, {"code": ("string",)}), "select * from (values ('close', 'direct', 'close'), ('typical', 'derived', 'high,low,close'), ('spread', 'missing', null), ('code', 'missing', null)) t(field, status, sources)"),
        "audit_repair": (lambda s, sf: cleaning.validate_repair(_bars(s, sf), broken(s, sf), "1996-01-01", "1996-12-31", value="close"), f"with {BARS} select (select count(*) from bars where code = 5 and year(date) = 1997) as changed_outside, 0::bigint as repeated, (select count(*) from bars where code = 5 and year(date) = 1997) as lost, (select count(*) from bars where code = 3 and year(date) = 1996) as null_inside"),
        "gate_experiments": (lambda s, sf: promoted(s.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("experiment"), F.round(F.col("s_acctbal") / 1000).alias("ir"), F.col("s_nationkey").cast("double").alias("dd")), "1", {"ir": 0.5}, {"dd": 2.0}), "with e as (select s_suppkey::varchar experiment, round(s_acctbal / 1000) ir, s_nationkey::double dd from supplier), b as (select ir bi, dd bd from e where experiment = '1') select experiment, ir - bi gap_ir, dd - bd gap_dd, ir - bi >= 0.5 and dd - bd <= 2 and experiment <> '1' promoted from e, b"),
    }
