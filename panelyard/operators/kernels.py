"""Operators as Spark columns.

A kernel adds steps to a plan: a step is a column over earlier ones, of no partition (elementwise) or of one (a window over
a code's dates, a date's codes, or a day's bars). Equal steps of different expressions are one step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from panelyard.functions.scalar import EPS, finite, log_abs, log_ratio, pct_rank, ratio
from panelyard.operators import registry as R


def _code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def _date() -> WindowSpec:
    return Window.partitionBy("date")


def _day() -> WindowSpec:
    return Window.partitionBy("date", "code")


def _bars() -> WindowSpec:
    return _day().orderBy("datetime", "seq")


class Steps:
    """Hash-consed columns; ``add`` gives the name of the one column that has this key."""

    def __init__(self) -> None:
        self.by_key: dict[tuple, str] = {}
        self.steps: list[tuple[str, tuple[str, ...], Callable[..., Column], str | None]] = []

    def add(self, key: tuple, inputs: tuple[str, ...], make: Callable[..., Column], part: str | None = None) -> str:
        if (*key, *inputs) not in self.by_key:
            name = f"{'_x' if part != 'agg' else '_r'}{len(self.by_key)}"
            self.by_key[(*key, *inputs)] = name
            self.steps.append((name, inputs, make, part))
        return self.by_key[(*key, *inputs)]


def _last(w: int):
    return _code().rowsBetween(-(w - 1), 0)


def _full(w: int, value: Callable[[Column, object], Column]) -> Callable[[Column], Column]:
    """A rolling value that needs all ``w`` rows present and non-null."""
    return lambda x: finite(F.when(F.count(x).over(_last(w)) == w, value(x, _last(w))))


def _rolling_rank(w: int) -> Callable[[Column], Column]:
    def make(x: Column) -> Column:
        seen = F.collect_list(x).over(_last(w))
        less, same = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
        return F.when(F.count(x).over(_last(w)) == w, (less + (same + 1) / 2) / w)

    return make


ELEMENTWISE = {
    "log": lambda x: finite(log_abs(x)), "abs": F.abs, "neg": lambda x: -x, "sqrt": lambda x: F.sqrt(F.abs(x)), "tanh": F.tanh,
    "add": lambda x, y: finite(x + y), "sub": lambda x, y: finite(x - y), "mul": lambda x, y: finite(x * y), "div": lambda x, y: finite(ratio(x, y)),
    "m_abs": F.abs, "m_sign": F.signum, "m_log": log_abs, "m_add": lambda x, y: x + y, "m_sub": lambda x, y: x - y, "m_mul": lambda x, y: x * y, "m_div": ratio,
    "m_when_pos": lambda x, c: F.when(c > 0, x),
}
ROLLING = {
    "ts_delay": lambda w: lambda x: F.lag(x, w).over(_code()), "ts_delta": lambda w: lambda x: x - F.lag(x, w).over(_code()),
    "ts_mean": lambda w: _full(w, lambda x, r: F.avg(x).over(r)), "ts_std": lambda w: _full(w, lambda x, r: F.stddev_samp(x).over(r)),
    "ts_sum": lambda w: _full(w, lambda x, r: F.sum(x).over(r)), "ts_max": lambda w: _full(w, lambda x, r: F.max(x).over(r)), "ts_min": lambda w: _full(w, lambda x, r: F.min(x).over(r)),
    "ts_rank": _rolling_rank, "ts_zscore": lambda w: _full(w, lambda x, r: ratio(x - F.avg(x).over(r), F.stddev_samp(x).over(r))),
}
CROSS = {
    "cs_rank": lambda x: pct_rank(x, _date()), "cs_demean": lambda x: finite(x - F.avg(x).over(_date())),
    "cs_zscore": lambda x: finite(F.when(F.stddev_samp(x).over(_date()) > EPS, (x - F.avg(x).over(_date())) / F.stddev_samp(x).over(_date()))),
}


def _enough(w: int, value: Callable[[Column, object], Column]) -> Callable[[Column], Column]:
    """An intraday rolling value: half the window, and two bars at least."""

    def make(x: Column) -> Column:
        frame = _bars().rowsBetween(-(w - 1), 0)
        return F.when(F.count(x).over(frame) >= max(2, w // 2), value(x, frame))

    return make


def _position(x: Column) -> Column:
    return F.row_number().over(_bars())


def _size() -> Column:
    return F.count(F.lit(1)).over(_day())


def _among(c: Column, w: int, descending: bool) -> Column:
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return c.isNotNull() & (F.row_number().over(_day().orderBy(order, "datetime", "seq")) <= w)


def _quartile(x: Column, q: float) -> Column:
    return F.percentile(x, F.lit(q)).over(_day())


INTRADAY = {
    "m_ret": lambda w: lambda x: ratio(x, F.lag(x).over(_bars())) - 1, "m_logret": lambda w: lambda x: log_ratio(x, F.lag(x).over(_bars())),
    "m_rank": lambda w: lambda x: pct_rank(x, _day()), "m_zscore": lambda w: lambda x: ratio(x - F.avg(x).over(_day()), F.stddev_samp(x).over(_day())),
    "m_delay": lambda w: lambda x: F.lag(x, w).over(_bars()), "m_delta": lambda w: lambda x: x - F.lag(x, w).over(_bars()),
    "m_ma": lambda w: _enough(w, lambda x, r: F.avg(x).over(r)), "m_std": lambda w: _enough(w, lambda x, r: F.stddev_samp(x).over(r)),
    "m_head": lambda w: lambda x: F.when(_position(x) <= w, x), "m_tail": lambda w: lambda x: F.when(_position(x) > _size() - w, x),
    "m_mid": lambda w: lambda x: F.when((_position(x) - 1 - F.floor(F.greatest(_size() - w, F.lit(0)) / 2)).between(0, w - 1), x),
    "m_top": lambda w: lambda x: F.when(_among(x, w, True), x), "m_bot": lambda w: lambda x: F.when(_among(x, w, False), x),
    "m_above": lambda w: lambda x: F.when(x > F.median(x).over(_day()), x), "m_below": lambda w: lambda x: F.when(x < F.median(x).over(_day()), x),
    "m_inner": lambda w: lambda x: F.when((x >= _quartile(x, 0.25)) & (x <= _quartile(x, 0.75)), x),
    "m_outer": lambda w: lambda x: F.when((x < _quartile(x, 0.25)) | (x > _quartile(x, 0.75)), x),
    "m_at_top": lambda w: lambda x, c: F.when(_among(c, w, True), x), "m_at_bot": lambda w: lambda x, c: F.when(_among(c, w, False), x),
    "m_when_gt": lambda w: lambda x, c: F.when(c > F.median(c).over(_day()), x),
}


def _sums(x: Column, y: Column) -> tuple[Column, Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return a, b, F.count(a)


def _corr(x: Column, y: Column) -> Column:
    a, b, n = _sums(x, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((n >= 2) & (n * spread > EPS), F.covar_pop(a, b) / spread)


def _wmean(x: Column, y: Column) -> Column:
    a, b, _ = _sums(x, y)
    return ratio(F.sum(a * b), F.sum(b))


def _skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.when(F.var_pop(x) <= EPS, F.lit(0.0)).otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))))


def _kurt(x: Column) -> Column:
    n = F.count(x).cast("double")
    below = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, F.when(F.var_pop(x) <= EPS, F.lit(0.0)).otherwise((n - 1) * ((n + 1) * F.kurtosis(x) + 6) / below))


def _r2(x: Column, t: Column) -> Column:
    """1 - SSR / SST of x on t, t being null where x is."""
    n, total = F.count(x), F.var_pop(x) * F.count(x)
    explained = F.covar_pop(x, t) * F.covar_pop(x, t) / F.nullif(F.var_pop(t) * F.var_pop(x), F.lit(0.0))
    return F.when((n >= 2) & (total > EPS), explained)


def _when_present(x: Column, value: Callable[..., Column]) -> Column:
    return value(F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.struct("datetime", "seq")))


REDUCE = {
    "r_mean": F.avg, "r_std": F.stddev_samp, "r_sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "r_max": F.max, "r_min": F.min, "r_median": F.median,
    "r_first": lambda x: _when_present(x, F.min_by), "r_last": lambda x: _when_present(x, F.max_by), "r_skew": _skew, "r_kurt": _kurt,
    "r_corr": _corr, "r_cov": lambda x, y: F.covar_samp(*_sums(x, y)[:2]), "r_wmean": _wmean,
}


def build(plan: Steps, name: str, args: tuple[str, ...], window: int | None) -> str:
    """The column of an operator over columns ``args``."""
    key = (name, window)
    if name in ELEMENTWISE:
        return plan.add(key, args, ELEMENTWISE[name])
    if name in ROLLING:
        return plan.add(key, args, ROLLING[name](window), "code")
    if name in CROSS:
        return plan.add(key, args, CROSS[name], "date")
    if name == "m_xtreme":
        away = plan.add(("deviation",), args, lambda x: F.abs(x - F.median(x).over(_day())), "day")
        return plan.add(key, (*args, away), INTRADAY["m_at_top"](window), "day")
    if name in INTRADAY:
        return plan.add(key, args, INTRADAY[name](window), "day")
    if name in ("r_slope", "r_rsquare"):
        t = plan.add(("order",), args, lambda x: F.when(x.isNotNull(), (F.count(x).over(_bars().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("double")), "day")
        return plan.add(key, (*args, t), F.regr_slope if name == "r_slope" else _r2, "agg")
    if name == "r_argmax":
        t = plan.add(("position",), (), lambda: F.row_number().over(_bars()) - 1, "day")
        first = lambda x, t: F.min_by(F.when(x.isNotNull(), t), F.when(x.isNotNull(), F.struct(-x, t)))
        return plan.add(key, (*args, t), lambda x, t: first(x, t) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1)), "agg")
    return plan.add(key, args, REDUCE[name], "agg")


def minute_feature(plan: Steps, name: str, present: set[str]) -> str:
    """The column of a minute feature; one that the panel has already is taken as it is."""
    if name in present:
        return plan.add((f"given {name}",), (), lambda: F.col(name).try_cast("double") if hasattr(Column, "try_cast") else F.col(name).cast("double"))
    f = lambda x: minute_feature(plan, x, present)
    running = lambda x: F.sum(x).over(_bars().rowsBetween(Window.unboundedPreceding, 0))
    kept = lambda x: F.when(x.isNotNull(), running(x))
    if name in ("ret", "logret"):
        return plan.add((name,), (f("close"),), INTRADAY[f"m_{name}"](None), "day")
    if name in ("signed_vol", "signed_amt"):
        return plan.add((name,), (f("ret"), f("vol" if name == "signed_vol" else "amount")), lambda r, v: F.coalesce(F.signum(r), F.lit(0.0)) * v)
    if name == "obv":
        return plan.add((name,), (f("signed_vol"),), kept, "day")
    if name == "pvt":
        return plan.add((name,), (plan.add(("pv",), (f("ret"), f("vol")), lambda r, v: r * v),), kept, "day")
    if name == "vwap_cum":
        return plan.add((name,), (f("amount"), f("vol")), lambda a, v: ratio(kept(a), kept(v)), "day")
    if name == "twap":
        return plan.add((name,), (f("close"),), lambda c: F.avg(c).over(_bars().rowsBetween(Window.unboundedPreceding, 0)), "day")
    simple = {
        "vwap": (("amount", "vol"), ratio), "hl_pct": (("high", "low", "close"), lambda h, l, c: ratio(h - l, F.abs(c))),
        "bar_pos": (("close", "low", "high"), lambda c, l, h: ratio(c - l, h - l)), "amihud": (("ret", "amount"), lambda r, a: ratio(F.abs(r), F.abs(a))),
        "rv": (("ret",), lambda r: r * r), "typical": (("high", "low", "close"), lambda h, l, c: (h + l + c) / 3), "oc_ret": (("close", "open"), lambda c, o: ratio(c, o) - 1),
    }
    needs, make = simple[name]
    return plan.add((name,), tuple(f(x) for x in needs), make)


KNOWN = set(ELEMENTWISE) | set(ROLLING) | set(CROSS) | set(INTRADAY) | set(REDUCE) | {"m_xtreme", "r_slope", "r_rsquare", "r_argmax"}
assert KNOWN == set(R.DAILY_OPS) | set(R.INTRADAY_OPS)
