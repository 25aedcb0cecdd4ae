"""Cleaning, audits and index research over panels made of the tables.

The tables hold no index, so its membership is made up here (a rule on code and month says who is a member when), as are flaws
of raw rows. Queries then run over all of it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.checks.evaluation import r, rank_sql, tidy
from panelyard.functions.scalar import security_id
from panelyard.index import portfolio as P
from panelyard.index import research as I
from panelyard.sources import cleaning as C
from panelyard.session import shared_path
from panelyard.sources import panels, store

BARS = panels.bars_sql()
#: The same text serves both engines.
RAW = """cast(date as string) as trade_date, concat('  ', cast(code as string)) as symbol, open as open_price, high, low, case when (code + month(date)) % 13 = 0 then null else close end as close,
  case when code % 7 = 0 then -volume else volume end as vol, amount as total_turnover, case when code % 5 = 0 then 2.0 when code % 5 = 1 then null else 1.0 end as ex_cum_factor"""
NAV = """date, 1 + avg(close) / 100000 as nav, 1 + avg(open) / 100000 as benchmark, case when max(volume) < 0 or date < date '1994-03-01' then 0.0 else 0.9 * sum(amount) end as market_value, sum(amount) as total_value"""
TRADES = "o_orderdate as datetime, cast(o_custkey % 100 + 1 as double) as quantity, o_totalprice / 100 as price, o_totalprice * 0.00001 * (1 + o_orderkey % 3) as cost"


def bars(s, sf):
    return panels.bars(s, sf)


def raw(s, sf):
    one = bars(s, sf).selectExpr(*_split(RAW), "1 as version")
    return one.unionByName(one.where("vol > 500").withColumn("version", F.lit(0)).withColumn("high", F.col("high") * 2))


def _split(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in text.replace("\n", " "):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def nav(s, sf):
    return bars(s, sf).groupBy("date").agg(*[F.expr(x) for x in _split(NAV)[1:]])


def trades(s, sf):
    return s.read.parquet(f"{sf}/orders.parquet").selectExpr(*_split(TRADES))


def members(s, sf):
    return bars(s, sf).where((F.col("code") + F.month("date")) % 3 != 0).select("date", "code")


def weights(s, sf):
    caps = s.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("code"), (F.abs("s_acctbal") + 1).alias("weight"))
    return members(s, sf).join(caps, "code").select("date", "code", "weight")


def scores(s, sf):
    return bars(s, sf).select("date", "code", (F.col("close") / F.col("vwap")).alias("score"))


FACTORS = ["x", "y", "z"]


def exposures(s, sf):
    return bars(s, sf).select("date", "code", F.log("volume").alias("x"), (F.col("close") / F.col("vwap")).alias("y"), (F.col("high") / F.col("low")).alias("z"))


def returns(s, sf):
    return bars(s, sf).select("date", "code", (F.col("close") / F.col("open") - 1).alias("ret"))


RAW_SQL = f"raw0 as (select {RAW}, 1 as version from bars), raw as (select * from raw0 union all select * replace (high * 2 as high, 0 as version) from raw0 where vol > 500)"
NAV_SQL = f"nav as (select {NAV} from bars group by date)"
TRADES_SQL = f"trades as (select {TRADES} from orders)"
MEMBERS_SQL = "members as (select date, code from bars where (code + month(date)) % 3 <> 0), weights as (select date, code, abs(s_acctbal) + 1 as weight from members join supplier on s_suppkey = code)"
SCORES_SQL = "scores as (select date, code, close / vwap as score from bars)"
EXPOSURE_SQL = "expo as (select date, code, ln(volume) as x, close / vwap as y, high / low as z from bars), rets as (select date, code, close / open - 1 as ret from bars)"
LABELS_SQL = """cal as (select date, lead(date, 1) over (order by date) as entry_date, lead(date, 5) over (order by date) as exit_date from (select distinct date from bars)),
flags as (select date, code, close, close > 0 and volume > 0 and amount > 0 as active from bars),
labels as (select b.date, b.code, entry_date, exit_date, e.close as entry_close, x.close as exit_close, x.close / e.close - 1 as raw_return, coalesce(e.active and x.active, false) as tradable
  from bars b join cal using (date) left join flags e on e.date = entry_date and e.code = b.code left join flags x on x.date = exit_date and x.code = b.code)"""
_p = ["open", "high", "low", "close", "vwap"]
_w = "over (partition by code order by date rows between unbounded preceding and current row)"
CLEAN_SQL = f"""with {BARS}, {RAW_SQL},
t as (select trade_date::date as date, trim(symbol) as code, open_price as open, high, low, close, vol as volume, total_turnover as amount, ex_cum_factor as adj_factor, total_turnover / nullif(vol, 0) as vwap from raw
  qualify row_number() over (partition by trade_date, symbol order by version desc) = 1),
f as (select date, code, {', '.join(f'last_value({c} ignore nulls) {_w} as {c}' for c in _p)}, greatest(coalesce(volume, 0), 0) as volume, greatest(coalesce(amount, 0), 0) as amount,
  coalesce(last_value(case when adj_factor > 0 then adj_factor end ignore nulls) {_w}, 1.0) as adj_factor from t),
a as (select date, code, adj_factor, amount, volume / adj_factor as volume, {', '.join(f'{c} * adj_factor as {c}' for c in _p)} from f),
k as (select * from a where not coalesce(low > high or open <= 0 or high <= 0 or low <= 0 or close <= 0, false)),
w as (select date, code, adj_factor, {', '.join(f'case when {c} is not null then least(greatest({c}, quantile_cont({c}, 0.001) over (partition by date)), quantile_cont({c}, 0.999) over (partition by date)) end as {c}' for c in [*_p, 'volume', 'amount'])} from k)
select date, code, {r('adj_factor')}, {', '.join(r(c) for c in [*_p, 'volume', 'amount'])},
  {', '.join(r(f'coalesce(case when stddev_samp({c}) over (partition by date) > 1e-12 then ({c} - avg({c}) over (partition by date)) / stddev_samp({c}) over (partition by date) end, 0)', f'z_{c}') for c in ('open', 'high', 'low', 'close', 'volume', 'vwap'))} from w"""

REPORT_SQL = f"""{CLEAN_SQL[:CLEAN_SQL.index('w as (select date, code, adj_factor')]}e as (select *, {', '.join(f'quantile_cont({c}, 0.001) over (partition by date) as lo_{c}, quantile_cont({c}, 0.999) over (partition by date) as hi_{c}' for c in [*_p, 'volume', 'amount'])} from k)
unpivot (select (select count(*) from raw) as input_rows, 0::bigint as invalid_keys, (select count(*) from raw) - (select count(*) from t) as duplicates, (select count(*) from a) - (select count(*) from k) as bad_rows, (select count(*) from k) as output_rows,
  {', '.join(f'count(*) filter (where {c} < lo_{c} or {c} > hi_{c}) as clipped_{c}' for c in [*_p, 'volume', 'amount'])} from e) on columns(*) into name item value n"""
_GRID = "grid as (select unnest([565] || range(571, 691) || range(781, 901))::bigint as minute)"
_TICKS = panels.ticks_sql(True)
AUDIT_SQL = f"""with {_TICKS}, {_GRID}, seen as (select distinct date, hour(datetime) * 60 + minute(datetime) as minute from ticks),
o as (select date, count(*) observed_minutes, count(*) filter (where minute in (select minute from grid)) hits from seen group by date),
i as (select date, sum((code is null or datetime is null)::int) a, sum((open is null or high is null or low is null or close is null or vol is null or amount is null)::int) b, sum(coalesce(open <= 0 or high <= 0 or low <= 0 or close <= 0, false)::int) c,
  sum(coalesce(high < low or high < open or high < close or low > open or low > close, false)::int) d, sum(coalesce(vol < 0 or amount < 0, false)::int) e from ticks group by date),
u as (select date, sum(n - 1) more from (select date, code, datetime, count(*) n from ticks group by all) group by date)
select date, a::bigint invalid_key_rows, b::bigint null_value_rows, c::bigint non_positive_price_rows, d::bigint invalid_ohlc_rows, e::bigint negative_activity_rows, observed_minutes, observed_minutes - hits as extra_minutes, more::bigint duplicate_rows,
  (select count(*) from grid) expected_minutes, (select count(*) from grid) - hits missing_minutes, case when (select count(*) from grid) - hits + observed_minutes - hits + more + a + b + c + d + e > 0 then 'problem' else 'ok' end status
from o join i using (date) join u using (date)"""
DAILY_SQL = f"""with {_TICKS} select date, code, {r('arg_min(open, row(datetime, seq)) filter (where open is not null)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')}, {r('arg_max(close, row(datetime, seq)) filter (where close is not null)', 'close')},
  {r('sum(vol)', 'volume')}, {r('sum(amount)', 'amount')}, count(*) bars, {r('case when sum(vol) > 0 then sum(amount) / sum(vol) end', 'vwap')} from ticks group by date, code"""
MINUTE_CLEAN_SQL = f"""with {_TICKS}, m as (select date, code, date_trunc('hour', datetime) as datetime, seq, open, high, low, close, greatest(vol, 0) vol, greatest(amount, 0) amount from ticks where not coalesce(open <= 0 or high <= 0 or low <= 0 or close <= 0 or low > high, false))
select date, code, datetime, seq, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('vol')}, {r('amount')} from m qualify row_number() over (partition by date, code, datetime order by seq desc) = 1"""
DENSE_SQL = f"""with {_TICKS}, {_GRID}, k as (select distinct date, code from ticks), o as (select date, code, hour(datetime) * 60 + minute(datetime) as minute, close from ticks qualify row_number() over (partition by date, code, hour(datetime) * 60 + minute(datetime) order by datetime desc, seq desc) = 1)
select date, code, minute, {r('close')}, o.date is not null as present from (select * from k cross join grid) g left join (select *, date as own from o) o using (date, code, minute)""".replace("o.date is not null", "own is not null")

_R = "rr as (select *, nav / lag(nav) over (order by date) - 1 as r, benchmark / lag(benchmark) over (order by date) - 1 as b, nav / benchmark as ex from nav)"
BACKTEST_SQL = f"""with {BARS}, {NAV_SQL}, {TRADES_SQL}, {_R}, q as (select *, nav / max(nav) over w - 1 fall, ex / max(ex) over w - 1 xfall, min((market_value = 0)::int) over w cash from rr window w as (order by date rows between unbounded preceding and current row)),
o as (select arg_max(nav, date) n, arg_max(benchmark, date) bm, greatest(date_diff('day', min(date), max(date)) / 365.25, 1 / 252.0) yrs, stddev_samp(r) sr, stddev_samp(r - b) sa, avg(r - b) ma, min(fall) f, min(xfall) xf, avg(market_value / total_value) e, sum(cash) c, arg_min(total_value, date) cap, avg(total_value) mv from q),
c as (select count(*) trades, count(distinct datetime::date) trade_days, sum(quantity * price) notional, sum(cost) costs from trades)
select {r('n - 1', 'total_return')}, {r('pow(n, 1 / yrs) - 1', 'annual_return')}, {r('n / bm - 1', 'excess_return')}, {r('sr * sqrt(252)', 'volatility')}, {r('sa * sqrt(252)', 'tracking_error')}, {r('case when sa > 0 then ma / sa * sqrt(252) end', 'information_ratio')},
  {r('-f', 'max_drawdown')}, {r('-xf', 'max_excess_drawdown')}, {r('e', 'exposure')}, c::bigint cash_days, trades, trade_days, {r('notional / 1e6', 'notional')}, {r('costs / 1e6', 'costs')}, {r('costs / cap', 'cost_over_capital')}, {r('costs / notional * 10000', 'cost_bps')}, {r('notional / mv / yrs', 'turnover')} from o, c"""


def period_sql(period: str) -> str:
    return f"""with {BARS}, {NAV_SQL}, {_R}, p as (select *, {period} as period from rr where r is not null and b is not null),
w as (select *, exp(sum(ln(1 + r)) over w) wv, exp(sum(ln(1 + b)) over w) bv from p window w as (partition by period order by date rows between unbounded preceding and current row)),
d as (select *, wv / max(wv) over w - 1 fall, wv / bv / max(wv / bv) over w - 1 xfall from w window w as (partition by period order by date rows between unbounded preceding and current row))
select period, count(*) as "days", {r('exp(sum(ln(1 + r))) - 1', 'strategy_return')}, {r('exp(sum(ln(1 + b))) - 1', 'benchmark_return')}, {r('exp(sum(ln(1 + r))) / exp(sum(ln(1 + b))) - 1', 'excess_return')}, {r('stddev_samp(r - b) * sqrt(252)', 'tracking_error')},
  {r('case when stddev_samp(r - b) > 0 then avg(r - b) / stddev_samp(r - b) * sqrt(252) end', 'information_ratio')}, {r('-min(fall)', 'max_drawdown')}, {r('-min(xfall)', 'max_excess_drawdown')} from d group by period"""


_LAG = "lagx as (select date, code, lag(x) over (partition by code order by date) x, lag(y) over (partition by code order by date) y, lag(z) over (partition by code order by date) z from expo)"
_m = lambda a, b: f"sum({a} * {b})"
#: Two exposures, so that the normal equations have a closed form: Cramer's rule.
REGRESSION_SQL = f"""with {BARS}, {EXPOSURE_SQL}, {_LAG}, g as (select date, x, y, least(greatest(ret, quantile_cont(ret, 0.01) over (partition by date)), quantile_cont(ret, 0.99) over (partition by date)) v from lagx join rets using (date, code) where x is not null and y is not null and ret is not null),
s as (select date, count(*) n, {_m('x', 'x')} + 1e-6 a, {_m('x', 'y')} b, {_m('y', 'y')} + 1e-6 c, {_m('x', 'v')} p, {_m('y', 'v')} q, sum(v) sv, {_m('v', 'v')} svv from g group by date having count(*) >= 20),
k as (select *, (c * p - b * q) / (a * c - b * b) bx, (a * q - b * p) / (a * c - b * b) bz from s)
select date, k.n, {r('1 - sum(pow(v - bx * x - bz * y, 2)) / (any_value(svv) - any_value(sv) * any_value(sv) / k.n)', 'r2')}, {r('stddev_samp(v - bx * x - bz * y)', 'residual_std')}, {r('any_value(bx)', 'x')}, {r('any_value(bz)', 'y')} from k join g using (date) group by date, k.n"""
ACTIVE = f"""pw as (select date, code, score as weight from scores), bw as (select * from weights), half as (select * from expo where code % 5 <> 0),
pa as (select date, sum(case when h.x is not null then weight end) / sum(weight) pc, {', '.join(f'sum(weight * {f}) / sum(case when h.x is not null then weight end) p_{f}' for f in FACTORS)} from pw left join half h using (date, code) group by date),
ba as (select date, sum(case when h.x is not null then weight end) / sum(weight) bc, {', '.join(f'sum(weight * {f}) / sum(case when h.x is not null then weight end) b_{f}' for f in FACTORS)} from bw left join half h using (date, code) group by date),
act as (select date, pc, bc, {', '.join(f'p_{f} - b_{f} as {f}' for f in FACTORS)} from pa join ba using (date))"""


def active(s, sf):
    half = exposures(s, sf).where("code % 5 <> 0")
    return I.active_exposure(scores(s, sf).withColumnRenamed("score", "weight"), weights(s, sf), half, FACTORS)


def daily_gains(s, sf):
    return exposures(s, sf).groupBy("date").agg(*[(F.avg(f) / 100).alias(f) for f in FACTORS])


def ranked(s, sf):
    return I.index_input(scores(s, sf), members(s, sf))


RANKED_SQL = f"{SCORES_SQL}, {MEMBERS_SQL}, ranked as (select date, code, score, row_number() over (partition by date order by score desc, code) as rank, count(*) over (partition by date) as universe_size from scores join members using (date, code))"
SMOOTH_SQL = f"""with {BARS}, {RANKED_SQL}, dd as (select date, row_number() over (order by date) n_ from (select distinct date from ranked)),
b as (select date, code, score, n_, {rank_sql('score', 'partition by date')} / count(*) over (partition by date) own from ranked join dd using (date)),
j as (select a.date, a.code, a.score, (0.5 * a.own + coalesce(0.3 * p.own, 0) + coalesce(0.2 * q.own, 0)) / (0.5 + case when p.own is not null then 0.3 else 0 end + case when q.own is not null then 0.2 else 0 end) smoothed from b a
  left join b p on p.code = a.code and p.n_ = a.n_ - 1 left join b q on q.code = a.code and q.n_ = a.n_ - 2)
select date, code, {r('score')}, {r('smoothed')} from j"""
STYLES = ["x", "y"]
ATTRIBUTION = " union all ".join(f"select date, '{f}' as factor, {f} * g{f} as c from l join g using (date)" for f in FACTORS)
HISTORY = "date, case when code % 2 = 0 then 'csi300' else 'csi500' end as index_key, lpad(cast(code as string), 6, '0') as code, volume as benchmark_weight"


def history(s, sf):
    """Index weights in long form, written as text and read back with their types."""
    path = shared_path(s, "weights") + ".csv"
    store.write(bars(s, sf).selectExpr(*_split(HISTORY)), path)
    return store.read(s, path, "date date, index_key string, code string, benchmark_weight double")


def csv_bars(s, sf):
    path = shared_path(s, "bars") + ".csv.gz"
    store.write(bars(s, sf).select("date", "code", "open", "close"), path)
    return store.scan_csv(s, path, "date date, code long, open double, close double", "1995-02-01", "1997-01-31", [1, 3, 5, 8])


def yearly(s, sf):
    """Exposures in folders by year: written, some years replaced, and read with both filters."""
    path = shared_path(s, "exposures")
    rows = exposures(s, sf).withColumn("year", F.year("date"))
    store.write(rows, path, ("year",))
    store.write(rows.where("year = 1996").withColumn("x", F.col("x") + 1), path, ("year",))
    return store.exposures(s, path, "1995-06-01", "1996-08-31")


def contributions(s, sf):
    return I.attribution(active(s, sf), daily_gains(s, sf), FACTORS)


def asof(s, sf, strict):
    days = bars(s, sf).select("date", "code")
    known = bars(s, sf).where(F.month("date") % 4 == 1).select("date", "code", "close")
    return I.as_of(days, known, "date", ("code",), ("close",), strict)


def asof_sql(sign: str) -> str:
    return f"with {BARS}, known as (select date as date_found, code, close from bars where month(date) % 4 = 1) select b.date, b.code, k.date_found, {r('k.close', 'close')} from bars b asof left join known k on b.code = k.code and b.date {sign} k.date_found"


def all_checks() -> dict:
    nation_id = "concat(lpad(cast(s_suppkey * 7919 % 1000000 as string), 6, '0'), case s_suppkey % 5 when 0 then '.sh' when 1 then '.SZ' when 2 then '.bj' when 3 then '' else '.XSHG' end)"
    id_sql = """select k, case when regexp_full_match(c, '\\d{6}') then c || case when c[1] in ('5', '6', '9') then '.XSHG' when c[1] in ('4', '8') then '.XBSE' else '.XSHE' end
      else regexp_replace(regexp_replace(regexp_replace(c, '\\.SH$', '.XSHG'), '\\.SZ$', '.XSHE'), '\\.BJ$', '.XBSE') end as id from (select s_suppkey k, upper(trim(%s)) c from supplier)""" % nation_id  # noqa: UP031
    ticks = lambda s, sf: panels.ticks(s, sf, True)
    hourly = lambda s, sf: ticks(s, sf).withColumn("datetime", F.date_trunc("hour", "datetime").cast("timestamp_ntz"))
    labelled = lambda s, sf: I.index_labels(I.forward_labels(bars(s, sf)), members(s, sf), weights(s, sf))
    label_sql = f"""with {BARS}, {MEMBERS_SQL}, {LABELS_SQL}, w as (select m.date, m.code, weight / sum(weight) over (partition by m.date) weight, entry_date, exit_date, entry_close, exit_close, raw_return, coalesce(tradable, false) tradable from members m left join weights using (date, code) left join labels using (date, code)),
      c as (select *, sum(case when raw_return is not null then weight else 0 end) over (partition by date) coverage, sum(case when raw_return is not null then weight * raw_return else 0 end) over (partition by date) gain from w),
      e as (select *, case when coverage >= 0.95 then gain / coverage end benchmark_return, raw_return - case when coverage >= 0.95 then gain / coverage end ex from c), f as (select *, case when ex is not null and tradable then ex end chosen from e)
      select date, code, {r('weight')}, entry_date, exit_date, {r('entry_close')}, {r('exit_close')}, {r('case when chosen is not null then raw_return end', 'raw_return')}, tradable, {r('coverage')}, {r('benchmark_return')}, {r('chosen', 'excess')}, {r(rank_sql('chosen', 'partition by date') + ' / count(chosen) over (partition by date)', 'rank')} from f"""
    attributed = f"with {BARS}, {EXPOSURE_SQL}, {SCORES_SQL}, {MEMBERS_SQL}, {ACTIVE}, g as (select date, avg(x) / 100 gx, avg(y) / 100 gy, avg(z) / 100 gz from expo group by date), l as (select date, lag(x) over w x, lag(y) over w y, lag(z) over w z from act window w as (order by date)), u as ({ATTRIBUTION})"
    attributed_days = f"{attributed}, {NAV_SQL}, {_R}, t as (select date, sum(case when factor in ('x', 'y') then c else 0 end) style, sum(case when factor = 'z' then c else 0 end) industry, any_value(r - b) realised from u join rr using (date) where c is not null group by date)"
    return {
        "clean_daily": (lambda s, sf: tidy(C.clean_daily(raw(s, sf), ("version",))), CLEAN_SQL),
        "clean_report": (lambda s, sf: C.cleaning_report(raw(s, sf), ("version",)), REPORT_SQL),
        "clean_minutes": (lambda s, sf: tidy(C.clean_minutes(hourly(s, sf), "seq").select("date", "code", "datetime", "seq", "open", "high", "low", "close", "vol", "amount")), MINUTE_CLEAN_SQL),
        "clean_security_id": (lambda s, sf: s.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), security_id(F.expr(nation_id)).alias("id")), id_sql),
        "clean_quality_report": (lambda s, sf: C.quality_report(panels.bars(s, sf, True)), f"with {panels.bars_sql(True)} unpivot (select count(*) - count(date) as date, count(*) - count(code) as code, count(*) - count(open) as open, count(*) - count(high) as high, count(*) - count(low) as low, count(*) - count(close) as close, count(*) - count(volume) as volume, count(*) - count(amount) as amount, count(*) - count(vwap) as vwap from bars) on columns(*) into name \"column\" value missing"),
        "source_liquid_universe": (lambda s, sf: tidy(C.liquid_universe(bars(s, sf), 20, "1995-01-01", "1996-12-31")), f"with {BARS} select code, {r('sum(greatest(amount, 0))', 'turnover')} from bars where date between date '1995-01-01' and date '1996-12-31' group by code order by sum(greatest(amount, 0)) desc, code limit 20"),
        "source_date_range": (lambda s, sf: tidy(C.between(bars(s, sf), "1995-01-01", "1995-06-30").select("date", "code", "close")), f"with {BARS} select date, code, {r('close')} from bars where date between date '1995-01-01' and date '1995-06-30'"),
        "source_coverage": (lambda s, sf: C.require_coverage(bars(s, sf), "1994-01-05", "2000-01-01"), f"with {BARS} select min(date) as first, max(date) as last, min(date) <= date '1994-01-12' and max(date) >= date '1999-12-25' as covered from bars"),
        "source_duplicates": (lambda s, sf: C.duplicates(hourly(s, sf), ("date", "code", "datetime")), f"with {_TICKS} select date, code, date_trunc('hour', datetime) as datetime, count(*) n from ticks group by all having count(*) > 1"),
        "source_minute_of_day": (lambda s, sf: ticks(s, sf).select("seq", C.minute_of_day(F.col("datetime"), "timestamp").alias("a"), C.minute_of_day(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"), "text").alias("b"), C.minute_of_day(F.hour("datetime") * 3600 + F.minute("datetime") * 60, "s").alias("c")), f"with {_TICKS} select seq, hour(datetime) * 60 + minute(datetime) as a, hour(datetime) * 60 + minute(datetime) as b, hour(datetime) * 60 + minute(datetime) as c from ticks"),
        "source_session_grid": (lambda s, sf: C.session_grid(s), f"with {_GRID} select minute from grid"),
        "source_densify": (lambda s, sf: tidy(C.densify(ticks(s, sf), C.session_grid(s), "close")), DENSE_SQL),
        "source_daily_from_minutes": (lambda s, sf: tidy(C.daily_from_minutes(ticks(s, sf))), DAILY_SQL),
        "source_replace_range": (lambda s, sf: tidy(C.replace_range(bars(s, sf).select("date", "code", "close"), bars(s, sf).select("date", "code", F.col("open").alias("close")), "1995-01-01", "1995-12-31")), f"with {BARS} select date, code, {r('''case when date between date '1995-01-01' and date '1995-12-31' then open else close end''', 'close')} from bars"),
        "audit_minutes": (lambda s, sf: C.audit_minutes(ticks(s, sf), C.session_grid(s)), AUDIT_SQL),
        "audit_symbols": (lambda s, sf: C.audit_symbols(ticks(s, sf), 13), f"with {_TICKS} select date, code, count(*) n, min(datetime) first_time, max(datetime) last_time, case when count(*) < 13 then 'short' when count(*) > 13 then 'long' else 'ok' end issue from ticks group by date, code"),
        "index_forward_labels": (lambda s, sf: tidy(I.forward_labels(bars(s, sf))), f"with {BARS}, {LABELS_SQL} select date, code, entry_date, exit_date, {r('entry_close')}, {r('exit_close')}, {r('raw_return')}, tradable from labels"),
        "index_labels": (lambda s, sf: tidy(labelled(s, sf)), label_sql),
        "index_as_of": (lambda s, sf: tidy(asof(s, sf, False)), asof_sql(">=")),
        "index_as_of_strict": (lambda s, sf: tidy(asof(s, sf, True)), asof_sql(">")),
        "index_input": (lambda s, sf: tidy(ranked(s, sf)), f"with {BARS}, {RANKED_SQL} select date, code, {r('score')}, rank, universe_size from ranked"),
        "index_universe_coverage": (lambda s, sf: tidy(I.universe_coverage(scores(s, sf), members(s, sf))), f"with {BARS}, {MEMBERS_SQL}, m as (select date, count(distinct code) components from members group by date), p as (select date, count(distinct code) predictions from bars group by date) select date, components, predictions, {r('predictions / components', 'coverage')} from m full join p using (date)"),
        "index_smoothed_ranks": (lambda s, sf: tidy(P.smoothed_ranks(ranked(s, sf), (0.5, 0.3, 0.2)).select("date", "code", "score", "smoothed")), SMOOTH_SQL),
        "index_portfolio_path": (lambda s, sf: P.portfolio_path(P.smoothed_ranks(ranked(s, sf), (0.5, 0.3, 0.2)), 10, 20, 0.3, 2), None),
        "index_optimised_weights": (lambda s, sf: P.optimise_dates(_problem(s, sf)), None),
        "index_backtest": (lambda s, sf: tidy(I.backtest(nav(s, sf), trades(s, sf)).withColumns({"notional": F.col("notional") / 1e6, "costs": F.col("costs") / 1e6})), BACKTEST_SQL),
        "index_years": (lambda s, sf: tidy(I.period_table(nav(s, sf), F.year("date").cast("string"))), period_sql("year(date)::varchar")),
        "index_months": (lambda s, sf: tidy(I.period_table(nav(s, sf), F.date_format("date", "yyyy-MM"))), period_sql("strftime(date, '%Y-%m')")),
        "index_cash_drag": (lambda s, sf: tidy(I.cash_drag(nav(s, sf))), f"with {BARS}, {NAV_SQL}, {_R}, q as (select *, min((market_value = 0)::int) over (order by date rows between unbounded preceding and current row) idle, 1 - market_value / total_value cash from rr) select sum(idle)::bigint cash_days, min(case when market_value <> 0 then date end) first_invested, {r('avg(cash)', 'mean_cash')}, {r('median(cash)', 'median_cash')}, {r('exp(coalesce(sum(case when idle = 1 then ln(1 + b) end), 0)) - 1', 'idle_benchmark_return')} from q"),
        "index_fee_audit": (lambda s, sf: tidy(I.fee_audit(trades(s, sf))), f"with {TRADES_SQL}, f as (select cost / (quantity * price) as rate from trades where quantity * price <> 0) select {r('quantile_cont(rate, 0.1)', 'p10')}, {r('quantile_cont(rate, 0.5)', 'median')}, {r('quantile_cont(rate, 0.9)', 'p90')}, count(rate) n from f"),
        "index_factor_returns": (lambda s, sf: tidy(I.factor_returns(exposures(s, sf), returns(s, sf), ["x", "y"])), REGRESSION_SQL),
        "index_active_exposure": (lambda s, sf: tidy(active(s, sf)), f"with {BARS}, {EXPOSURE_SQL}, {SCORES_SQL}, {MEMBERS_SQL}, {ACTIVE} select date, {r('pc', 'portfolio_coverage')}, {r('bc', 'benchmark_coverage')}, {r('x')}, {r('y')}, {r('z')} from act"),
        "index_attribution": (lambda s, sf: tidy(contributions(s, sf)), f"{attributed} select date, factor, {r('c', 'contribution')} from u where c is not null"),
        "index_attribution_days": (lambda s, sf: tidy(I.attribution_days(contributions(s, sf), nav(s, sf), STYLES)), f"{attributed_days} select date, {r('style')}, {r('industry')}, {r('style + industry', 'factors')}, {r('realised')}, {r('realised - style - industry', 'residual')} from t"),
        "index_attribution_totals": (lambda s, sf: tidy(I.attribution_totals(I.attribution_days(contributions(s, sf), nav(s, sf), STYLES))), f"{attributed_days} select count(*) as \"days\", min(date) as first, max(date) as last, {r('sum(style)', 'style')}, {r('sum(industry)', 'industry')}, {r('sum(style + industry)', 'factors')}, {r('sum(realised)', 'realised')}, {r('sum(realised - style - industry)', 'residual')} from t"),
        "index_attribution_summary": (lambda s, sf: tidy(I.attribution_summary(contributions(s, sf), STYLES)), f"{attributed} select factor, case when factor in ('x', 'y') then 'style' else 'industry' end as kind, {r('sum(c)', 'cumulative')}, {r('avg(c) * 252', 'annualised')}, {r('stddev_samp(c)', 'volatility')} from u where c is not null group by factor"),
        "index_exposure_summary": (lambda s, sf: tidy(I.exposure_summary(active(s, sf), FACTORS, STYLES)), f"with {BARS}, {EXPOSURE_SQL}, {SCORES_SQL}, {MEMBERS_SQL}, {ACTIVE}, u as (" + " union all ".join(f"select date, '{f}' as factor, {f} v from act" for f in FACTORS) + f") select factor, case when factor in ('x', 'y') then 'style' else 'industry' end as kind, {r('avg(v)', 'mean')}, {r('avg(abs(v))', 'mean_abs')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'least')}, {r('max(v)', 'most')}, {r('arg_max(v, date)', 'latest')}, {r('avg((v > 0)::int)', 'positive')} from u group by factor"),
        "index_weight_history": (lambda s, sf: tidy(P.weight_history(history(s, sf), "csi300", "1994-01-01", "1996-12-31")), f"with {BARS}, h as (select date, lpad(code::varchar, 6, '0') c, volume from bars where code % 2 = 0 and date between date '1994-01-01' and date '1996-12-31') select date, c || case when c[1] in ('5', '6', '9') then '.XSHG' when c[1] in ('4', '8') then '.XBSE' else '.XSHE' end as code, {r('volume / sum(volume) over (partition by date)', 'benchmark_weight')} from h"),
        "source_csv_scan": (lambda s, sf: tidy(csv_bars(s, sf)), f"with {BARS} select date, code, {r('open')}, {r('close')} from bars where date between date '1995-02-01' and date '1997-01-31' and code in (1, 3, 5, 8)"),
        "source_partitioned": (lambda s, sf: tidy(yearly(s, sf)), f"with {BARS}, {EXPOSURE_SQL} select date, code, {r('case when year(date) = 1996 then x + 1 else x end', 'x')}, {r('y')}, {r('z')}, year(date)::bigint as year from expo where date between date '1995-06-01' and date '1996-08-31'"),
        "index_window_diagnostics": (lambda s, sf: tidy(I.window_diagnostics(panels.bars(s, sf, True).select("date", "code", "close", F.month("date").cast("double").alias("flat")), ["close", "flat"])), f"with {panels.bars_sql(True)}, l as (select date, 'close' factor, close v from bars union all select date, 'flat', month(date)::double from bars), d as (select factor, date, stddev_pop(v) s, count(v) n, count(*) m from l group by all) select factor, sum((coalesce(s, 0) > 1e-12)::int)::bigint varying_dates, sum((coalesce(s, 0) <= 1e-12)::int)::bigint constant_dates, {r('sum(n) / sum(m)', 'coverage')} from d group by factor"),
    }


def _problem(s, sf):
    """Smoothed ranks against the benchmark; what is held is an equal weight of every seventh name."""
    held = F.when(F.col("code") % 7 == 0, 0.98 / F.sum((F.col("code") % 7 == 0).cast("int")).over(Window.partitionBy("date"))).otherwise(0.0)
    smoothed = P.smoothed_ranks(ranked(s, sf), (0.5, 0.3, 0.2)).join(weights(s, sf), ["date", "code"])
    return smoothed.select("date", "code", F.col("smoothed").alias("score"), F.col("weight").alias("benchmark"), held.alias("current"))
