"""Column functions that keep one null model: NULL is the only missing value, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where |b| <= EPS."""
    return F.when(F.abs(b) > EPS, a / b)


def log_abs(x: Column) -> Column:
    return F.log(F.abs(x) + EPS)


def log_ratio(a: Column, b: Column) -> Column:
    r = ratio(a, b)
    return F.when(r > 0, F.log(r))


def rounded(x: Column, digits: int = 6) -> Column:
    """For comparison of results: rounded, without negative zero, and a little off the ties that decimal prices fall on."""
    return F.round(x + 3.1e-8, digits) + F.lit(0.0)


def average_rank(x: Column, whole: WindowSpec) -> Column:
    """Average rank of non-null x among the non-null x of the partition ``whole`` (an unordered window).

    Ties are the rows of an equal-value frame, so rank and ties share one window and one sort.
    """
    ordered = whole.orderBy(x.asc_nulls_last())
    ties = F.count(x).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(ordered) + (ties - 1) / F.lit(2.0))


def pct_rank(x: Column, whole: WindowSpec) -> Column:
    n = F.count(x).over(whole.orderBy(x.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return average_rank(x, whole) / n


def moment_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; NULL where either side doesn't vary (the built-in raises there)."""
    zero = F.lit(0.0)
    below = F.sqrt(F.greatest(n * sxx - sx * sx, zero) * F.greatest(n * syy - sy * sy, zero))
    return F.when(below > EPS, (n * sxy - sx * sy) / below)


def corr_agg(x: Column, y: Column) -> Column:
    """The same as an aggregate over rows where both are present."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return moment_corr(F.count(a).cast("double"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b))


def security_id(x: Column) -> Column:
    """One notation for exchange codes: suffixes are spelled out, and six bare digits take the exchange of the first."""
    code = F.upper(F.trim(x.cast("string")))
    for short, full in (("SH", "XSHG"), ("SZ", "XSHE"), ("BJ", "XBSE")):
        code = F.regexp_replace(code, rf"\.{short}$", f".{full}")
    first = F.substring(code, 1, 1)
    exchange = F.when(first.isin("5", "6", "9"), ".XSHG").when(first.isin("4", "8"), ".XBSE").otherwise(".XSHE")
    return F.when(code.rlike(r"^\d{6}$"), F.concat(code, exchange)).otherwise(code)
