"""Operators of the expression language: a query for each, and SQL written apart from the kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.scalar import rounded
from panelyard.operators import registry as R
from panelyard.plans import compile as C
from panelyard.plans.nodes import MINUTE, Node, parse
from panelyard.sources import panels

CODE = "partition by code order by date"
DAY = "partition by date, code"
BARS = "partition by date, code order by datetime, seq"


def _sdiv(a: str, b: str) -> str:
    return f"case when abs({b}) > 1e-12 then {a} / {b} end"


def _rank(x: str, part: str) -> str:
    return f"""case when {x} is not null then (rank() over ({part} order by {x} asc nulls last) + count({x}) over ({part}) + 1
      - rank() over ({part} order by {x} desc nulls last)) / 2.0 / count({x}) over ({part}) end"""


def _full(expr: str, x: str, w: int) -> str:
    return f"case when count({x}) over ({CODE} rows between {w - 1} preceding and current row) = {w} then {expr.format(x=x, r=f'({CODE} rows between {w - 1} preceding and current row)')} end"


def _enough(fn: str, x: str, w: int) -> str:
    r = f"({BARS} rows between {w - 1} preceding and current row)"
    return f"case when count({x}) over {r} >= {max(2, w // 2)} then {fn}({x}) over {r} end"


def _top(x: str, c: str, w: int, way: str) -> str:
    return f"case when {c} is not null and row_number() over ({DAY} order by {c} {way} nulls last, datetime, seq) <= {w} then {x} end"


def op_sql(name: str, a: list[str], w: int | None) -> list[str]:
    """SQL of an operator over columns; all but the last are columns that the next can use as {0}, {1}..."""
    x, y = a[0], a[-1]
    lag = f"lag({x}) over ({BARS})"
    n = f"count(*) over ({DAY})"
    spot = f"row_number() over ({BARS})"
    median = lambda c: f"median({c}) over ({DAY})"
    quart = lambda q: f"quantile_cont({x}, {q}) over ({DAY})"
    table = {
        "log": f"ln(abs({x}) + 1e-12)", "abs": f"abs({x})", "neg": f"-{x}", "sqrt": f"sqrt(abs({x}))", "tanh": f"tanh({x})",
        "add": f"{x} + {y}", "sub": f"{x} - {y}", "mul": f"{x} * {y}", "div": _sdiv(x, y),
        "ts_delay": f"lag({x}, {w}) over ({CODE})", "ts_delta": f"{x} - lag({x}, {w}) over ({CODE})",
        "cs_rank": _rank(x, "partition by date"), "cs_demean": f"{x} - avg({x}) over (partition by date)",
        "cs_zscore": f"case when stddev_samp({x}) over (partition by date) > 1e-12 then ({x} - avg({x}) over (partition by date)) / stddev_samp({x}) over (partition by date) end",
        "m_ret": _sdiv(x, lag) + " - 1", "m_logret": f"case when ({_sdiv(x, lag)}) > 0 then ln({_sdiv(x, lag)}) end", "m_rank": _rank(x, DAY),
        "m_zscore": _sdiv(f"({x} - avg({x}) over ({DAY}))", f"(stddev_samp({x}) over ({DAY}))"), "m_abs": f"abs({x})", "m_sign": f"sign({x})::double", "m_log": f"ln(abs({x}) + 1e-12)",
        "m_delay": f"lag({x}, {w}) over ({BARS})", "m_delta": f"{x} - lag({x}, {w}) over ({BARS})",
        "m_add": f"{x} + {y}", "m_sub": f"{x} - {y}", "m_mul": f"{x} * {y}", "m_div": _sdiv(x, y),
        "m_head": f"case when {spot} <= {w} then {x} end", "m_tail": f"case when {spot} > {n} - {w} then {x} end",
        "m_mid": f"case when {spot} - 1 between greatest({n} - {w}, 0) // 2 and greatest({n} - {w}, 0) // 2 + {(w or 1) - 1} then {x} end",
        "m_above": f"case when {x} > {median(x)} then {x} end", "m_below": f"case when {x} < {median(x)} then {x} end",
        "m_inner": f"case when {x} >= {quart(0.25)} and {x} <= {quart(0.75)} then {x} end", "m_outer": f"case when {x} < {quart(0.25)} or {x} > {quart(0.75)} then {x} end",
        "m_when_pos": f"case when {y} > 0 then {x} end", "m_when_gt": f"case when {y} > {median(y)} then {x} end",
    }
    if w:
        table |= {
            "ts_mean": _full("avg({x}) over {r}", x, w), "ts_std": _full("stddev_samp({x}) over {r}", x, w), "ts_sum": _full("sum({x}) over {r}", x, w),
            "ts_max": _full("max({x}) over {r}", x, w), "ts_min": _full("min({x}) over {r}", x, w),
            "ts_zscore": _full("case when stddev_samp({x}) over {r} > 1e-12 then ({x} - avg({x}) over {r}) / stddev_samp({x}) over {r} end", x, w),
            "m_ma": _enough("avg", x, w), "m_std": _enough("stddev_samp", x, w), "m_top": _top(x, x, w, "desc"), "m_bot": _top(x, x, w, "asc"), "m_at_top": _top(x, y, w, "desc"), "m_at_bot": _top(x, y, w, "asc"),
        }
    if name == "ts_rank":
        seen = _full("list({x}) over {r}", x, w)
        return [seen, f"case when {{0}} is not null then (len(list_filter({{0}}, lambda v: v < {x})) + (len(list_filter({{0}}, lambda v: v = {x})) + 1) / 2.0) / {w} end"]
    if name == "m_xtreme":
        return [f"abs({x} - {median(x)})", _top(x, "{0}", w, "desc")]
    return [table[name]]


FEATURE_SQL = {
    "vwap": ["amount", "vol", lambda a, v: _sdiv(a, v)], "ret": ["close", lambda c: op_sql("m_ret", [c], None)[0]], "logret": ["close", lambda c: op_sql("m_logret", [c], None)[0]],
    "hl_pct": ["high", "low", "close", lambda h, l, c: _sdiv(f"({h} - {l})", f"abs({c})")], "bar_pos": ["close", "low", "high", lambda c, l, h: _sdiv(f"({c} - {l})", f"({h} - {l})")],
    "amihud": ["ret", "amount", lambda r, a: _sdiv(f"abs({r})", f"abs({a})")], "rv": ["ret", lambda r: f"{r} * {r}"],
    "signed_vol": ["ret", "vol", lambda r, v: f"coalesce(sign({r}), 0) * {v}"], "signed_amt": ["ret", "amount", lambda r, v: f"coalesce(sign({r}), 0) * {v}"],
    "typical": ["high", "low", "close", lambda h, l, c: f"({h} + {l} + {c}) / 3"],
    "vwap_cum": ["amount", "vol", lambda a, v: _sdiv(f"(case when {a} is not null then sum({a}) over ({BARS}) end)", f"(case when {v} is not null then sum({v}) over ({BARS}) end)")],
    "twap": ["close", lambda c: f"avg({c}) over ({BARS} rows between unbounded preceding and current row)"],
    "obv": ["signed_vol", lambda s: f"case when {s} is not null then sum({s}) over ({BARS}) end"],
    "pvt": ["ret", "vol", lambda r, v: f"case when {r} * {v} is not null then sum({r} * {v}) over ({BARS}) end"],
    "oc_ret": ["close", "open", lambda c, o: _sdiv(c, o) + " - 1"],
}

_PAIR = "filter (where {x} is not null and {y} is not null)"
REDUCE_SQL = {
    "r_mean": "avg({x})", "r_std": "stddev_samp({x})", "r_sum": "coalesce(sum({x}), 0)", "r_max": "max({x})", "r_min": "min({x})", "r_median": "median({x})",
    "r_first": "arg_min({x}, row(datetime, seq)) filter (where {x} is not null)", "r_last": "arg_max({x}, row(datetime, seq)) filter (where {x} is not null)",
    "r_skew": "case when count({x}) >= 3 then case when var_pop({x}) <= 1e-12 then 0 else skewness({x}) end end",
    "r_kurt": "case when count({x}) >= 4 then case when var_pop({x}) <= 1e-12 then 0 else kurtosis({x}) end end",
    "r_slope": "case when count({x}) >= 2 then regr_slope({x}, {t}) end",
    "r_rsquare": "case when count({x}) >= 2 and var_pop({x}) * count({x}) > 1e-12 then pow(covar_pop({x}, {t}), 2) / (var_pop({t}) * var_pop({x})) end",
    "r_argmax": "min(case when {x} = {m} then {p} end) / greatest(1, count(*) - 1)",
    "r_corr": "case when count(*) " + _PAIR + " >= 2 and count(*) " + _PAIR + " * stddev_pop({x}) " + _PAIR + " * stddev_pop({y}) " + _PAIR + " > 1e-12 then covar_pop({x}, {y}) / (stddev_pop({x}) " + _PAIR + " * stddev_pop({y}) " + _PAIR + ") end",
    "r_cov": "covar_samp({x}, {y})", "r_wmean": "case when abs(sum({y}) " + _PAIR + ") > 1e-12 then sum({x} * {y}) / sum({y}) " + _PAIR + " end",
}


class Script:
    """A chain of common table expressions; each adds one column to the one before."""

    def __init__(self, source: str, first: str):
        self.parts, self.at, self.n = [source], first, 0
        self.blocks: dict[Node, str] = {}

    def column(self, sql: str) -> str:
        self.n += 1
        name = f"c{self.n}"
        self.parts.append(f"s{self.n} as (select *, {sql} as {name} from {self.at})")
        self.at = f"s{self.n}"
        return name

    def node(self, node: Node) -> str:
        if node in self.blocks:
            return self.blocks[node]
        if not node.args:
            if node.name in FEATURE_SQL and self.parts[0].startswith("ticks"):
                *needs, make = FEATURE_SQL[node.name]
                return self.column(make(*[self.node(Node(x)) for x in needs]))
            return node.name
        if node.name in R.REDUCERS:
            return self.reduce(node)
        args = [self.node(a) for a in node.args]
        out: list[str] = []
        for sql in op_sql(node.name, args, node.window):
            for i, c in enumerate(out):
                sql = sql.replace(f"{{{i}}}", c)
            out.append(self.column(sql))
        return out[-1]

    def reduce(self, node: Node) -> str:
        args = [self.node(a) for a in node.args]
        x = args[0]
        names = {"x": x, "y": args[-1]}
        if node.name in ("r_slope", "r_rsquare"):
            names["t"] = self.column(f"case when {x} is not null then count({x}) over ({BARS} rows between unbounded preceding and current row) - 1 end")
        if node.name == "r_argmax":
            names["p"], names["m"] = self.column(f"row_number() over ({BARS}) - 1"), self.column(f"max({x}) over ({DAY})")
        self.n += 1
        name = f"c{self.n}"
        self.parts.append(f"s{self.n} as (select date, code, {REDUCE_SQL[node.name].format(**names)} as {name} from {self.at} group by date, code)")
        self.at = f"s{self.n}"
        return name

    def select(self, columns: str) -> str:
        return f"with {', '.join(self.parts)} select {columns} from {self.at}"


def _round(c: str) -> str:
    return f"round({c}::double + 3.1e-8::double, 6) + 0.0::double"


def daily(expression: str, nulls: bool = True):
    tree = parse(expression)
    script = Script(panels.bars_sql(nulls), "bars")
    column = script.node(tree)
    sql = script.select(f"date, code, {_round(column)} as factor")
    return lambda spark, sf: C.daily_factors(panels.bars(spark, sf, nulls), {"factor": tree}).select("date", "code", rounded(F.col("factor")).alias("factor")), sql


def bar_values(tree: Node):
    script = Script(panels.ticks_sql(True), "ticks")
    column = script.node(tree)
    sql = script.select(f"date, code, seq, {_round(column)} as value")
    return lambda spark, sf: C.minute_values(panels.ticks(spark, sf, True), {"value": tree}).select("date", "code", "seq", rounded(F.col("value")).alias("value")), sql


def minute_sql(tree: Node, name: str = "factor") -> str:
    """Each distinct block on its own, joined by key; daily operators on top."""
    blocks: dict[Node, str] = {}

    def collect(node: Node) -> None:
        if node.name in R.REDUCERS:
            blocks.setdefault(node, f"b{len(blocks)}")
        else:
            for a in node.args:
                collect(a)

    collect(tree)
    parts = []
    for node, block in blocks.items():
        script = Script(panels.ticks_sql(True), "ticks")
        column = script.node(node)
        parts.append(f"{block} as ({script.select(f'date, code, {column} as {block}')})")
    first, *rest = blocks.values()
    parts.append(f"joined as (select * from {first} " + " ".join(f"join {b} using (date, code)" for b in rest) + ")")
    script = Script(", ".join(parts), "joined")
    script.blocks = blocks
    column = script.node(tree)
    return script.select(f"date, code, {_round(column)} as {name}")


def minute(expression: str):
    tree = parse(expression, MINUTE)
    return lambda spark, sf: C.minute_factors(panels.ticks(spark, sf, True), {"factor": tree}).select("date", "code", rounded(F.col("factor")).alias("factor")), minute_sql(tree)


#: A larger batch, all in one plan: nested partitions, shared subtrees.
BATCH = {
    "f1": "cs_rank ts_mean W5 close", "f2": "sub cs_rank ts_mean W5 close cs_rank ts_mean W20 close", "f3": "ts_zscore W10 div volume add close vwap", "f4": "neg ts_rank W10 cs_zscore ts_delta W5 close",
    "f5": "mul cs_demean log volume tanh ts_std W20 close", "f6": "cs_zscore ts_delta W5 log volume",
}
MINUTE_BATCH = {"g1": "r_corr ret vol", "g2": "cs_rank ts_mean W5 r_mean m_top W5 ret", "g3": "div r_std ret r_mean hl_pct", "g4": "ts_delta W5 r_last vwap_cum", "g5": "cs_zscore r_wmean ret vol", "g6": "r_skew m_when_gt ret vol"}


def daily_batch(spark, sf):
    out = C.daily_factors(panels.bars(spark, sf, True), BATCH)
    return out.select("date", "code", *[rounded(F.col(k)).alias(k) for k in BATCH])


def minute_batch(spark, sf):
    out = C.minute_factors(panels.ticks(spark, sf, True), MINUTE_BATCH)
    return out.select("date", "code", *[rounded(F.col(k)).alias(k) for k in MINUTE_BATCH])


def daily_batch_sql() -> str:
    script = Script(panels.bars_sql(True), "bars")
    columns = {k: script.node(parse(v)) for k, v in BATCH.items()}
    return script.select("date, code, " + ", ".join(f"{_round(c)} as {k}" for k, c in columns.items()))


def minute_batch_sql() -> str:
    parts = [f"{k} as ({minute_sql(parse(v, MINUTE), k)})" for k, v in MINUTE_BATCH.items()]
    first, *rest = MINUTE_BATCH
    return f"with {', '.join(parts)} select * from {first} " + " ".join(f"join {k} using (date, code)" for k in rest)


def all_checks() -> dict:
    """name -> (query, sql)"""
    out = {f"daily_{f}": daily(f) for f in R.DAILY_FEATURES}
    shown = {"log": "volume", "abs": "sub close vwap", "neg": "close", "sqrt": "sub close vwap", "tanh": "div sub close vwap vwap"}
    out |= {f"daily_{n}": daily(f"{n} {shown[n]}") for n in R.UNARY}
    out |= {f"daily_{n}": daily(f"{n} close vwap" if n != "div" else "div close sub high high") for n in R.BINARY}
    out["daily_div_regular"] = daily("div close vwap")
    out |= {f"daily_{n}": daily(f"{n} W5 close") for n in R.TIME_SERIES}
    out |= {f"daily_{n}_w20": daily(f"{n} W20 volume") for n in ("ts_mean", "ts_std", "ts_rank", "ts_zscore")}
    out |= {f"daily_{n}": daily(f"{n} close") for n in R.CROSS_SECTION}
    out |= {f"minute_{f}": bar_values(Node(f)) for f in R.MINUTE_FEATURES}
    minute_arg = {"m_abs": "ret", "m_sign": "ret", "m_when_pos": "ret", "m_div": "ret"}
    for n, op in (R.MINUTE | R.MASKS).items():
        args = (Node("close"),) if len(op.takes) == 1 else (Node("close"), Node(minute_arg.get(n, "vol")))
        if n in ("m_abs", "m_sign"):
            args = (Node("ret"),)
        out[f"minute_{n}"] = bar_values(Node(n, args, 5 if op.windowed else None))
    out |= {f"minute_{n}": minute(f"{n} close" if len(op.takes) == 1 else f"{n} ret vol") for n, op in R.REDUCERS.items()}
    out["minute_masked_reduce"] = minute("r_mean m_at_top W5 ret vol")
    out["minute_daily_over_blocks"] = minute("cs_rank ts_mean W5 r_std ret")
    out["daily_batch"] = (daily_batch, daily_batch_sql())
    out["minute_batch"] = (minute_batch, minute_batch_sql())
    return out


