"""Raw rows to panels: names, types, keys, filling, adjustment, winsorizing; bars by minute; audits."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES, REQUIRED = ("open", "high", "low", "close", "vwap"), ("date", "code", "open", "high", "low", "close", "volume")
#: Names that vendors give to the columns.
ALIASES = {
    "date": ("date", "datetime", "trade_date", "trading_date", "time", "日期", "交易日期"),
    "code": ("code", "symbol", "ticker", "security_id", "order_book_id", "股票代码", "证券代码"),
    "open": ("open", "open_price", "开盘", "开盘价"),
    "high": ("high", "high_price", "最高", "最高价"),
    "low": ("low", "low_price", "最低", "最低价"),
    "close": ("close", "close_price", "收盘", "收盘价"),
    "volume": ("volume", "vol", "trade_volume", "成交量"),
    "amount": ("amount", "turnover", "total_turnover", "trade_amount", "成交额"),
    "vwap": ("vwap", "avg_price", "average_price", "均价", "成交均价"),
    "adj_factor": ("adj_factor", "adjust_factor", "ex_cum_factor", "factor", "复权因子"),
    "industry": ("industry", "industry_code", "申万行业", "行业"),
    "market_cap": ("market_cap", "total_market_cap", "float_market_cap", "市值", "总市值", "流通市值"),
}


def _plain(name: str) -> str:
    return re.sub(r"[\s_\-()./]+", "", name).lower()


def column_mapping(df: DataFrame, mapping: Mapping[str, str] | None = None) -> dict[str, str]:
    """Source column of each canonical name: by ``mapping``, else by aliases. Raises if a required one is missing."""
    by_plain = {_plain(c): c for c in df.columns}
    found = {}
    for canonical, names in ALIASES.items():
        hits = [by_plain[_plain(n)] for n in (canonical, *names) if _plain(n) in by_plain]
        if hits:
            found[canonical] = hits[0]
    for source, canonical in (mapping or {}).items():
        if source not in df.columns or canonical not in ALIASES:
            raise ValueError(f"{source!r} can't become {canonical!r}")
        found[canonical] = source
    if missing := [c for c in REQUIRED if c not in found]:
        raise ValueError(f"no columns for {missing} among {df.columns}")
    return found


def rename(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` under canonical names; other columns go."""
    return df.select(*[F.col(f"`{s}`").alias(c) for c, s in column_mapping(df, mapping).items()])


def typed(df: DataFrame) -> DataFrame:
    """Dates, trimmed codes and doubles; what can't be read, and NaN, is NULL."""
    def number(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x).alias(c)

    text = {"date": F.col("date").try_cast("date").alias("date"), "code": F.trim(F.col("code").cast("string")).alias("code")}
    return df.select(*[text.get(c) if c in text else F.col(c) if c in ("industry", "_order") else number(c) for c in df.columns])


def last_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows that share ``keys`` the last in ``order``."""
    down = [c.desc() if isinstance(c, Column) else F.desc(c) for c in order]
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*down))).where("_at = 1").drop("_at")


def clean_daily(df: DataFrame, order: Sequence[Column | str], limits: tuple[float, float] = (0.001, 0.999), mapping: Mapping[str, str] | None = None) -> DataFrame:
    """A daily panel from raw rows; ``order`` ranks rows of one key, the last one counts.

    Prices are filled forward within a code, never backward; volume and amount are clipped at 0; prices are adjusted; bad rows go;
    columns are clipped to same-day quantiles and scored. Windows by code come first, then those by date: two exchanges.
    """
    return _clean(last_of_key(_keyed(df, order, mapping).where(KEYED), ("date", "code"), ("_order",)).drop("_order"), limits)


KEYED = "date is not null and code is not null and code <> ''"
#: Of adjusted rows; those where it is NULL stay.
BAD = "low > high or open <= 0 or high <= 0 or low <= 0 or close <= 0"


def _keyed(df: DataFrame, order: Sequence[Column | str], mapping: Mapping[str, str] | None) -> DataFrame:
    found = column_mapping(df, mapping)
    return typed(df.select(*[F.col(f"`{s}`").alias(c) for c, s in found.items()], F.struct(*order).alias("_order")))


def cleaning_report(df: DataFrame, order: Sequence[Column | str], limits: tuple[float, float] = (0.001, 0.999), mapping: Mapping[str, str] | None = None) -> DataFrame:
    """item, n: what ``clean_daily`` does to ``df``: input_rows, invalid_keys, duplicates, bad_rows, output_rows, and clipped_<column> for
    each column that is clipped to quantiles of its date."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0).cast("long"))
    keyed = _keyed(df, order, mapping)
    good = F.coalesce(F.expr(KEYED), F.lit(False))
    keys = keyed.groupBy("date", "code", good.alias("good")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    before = keys.agg(total(F.col("n")).alias("input_rows"), total(F.when(~F.col("good"), F.col("n"))).alias("invalid_keys"), total(F.when(F.col("good"), F.col("n") - 1)).alias("duplicates"))
    adjusted = _adjusted(last_of_key(keyed.where(KEYED), ("date", "code"), ("_order",)).drop("_order"))
    bad = F.coalesce(F.expr(BAD), F.lit(False))
    columns = _clipped_columns(adjusted)
    # Bad rows form a partition of their own, so that quantiles are those of the rows that stay.
    day = Window.partitionBy("date", "_bad")
    edges = adjusted.withColumn("_bad", bad).withColumns({f"_{c}": (F.col(c) < F.percentile(c, F.lit(limits[0])).over(day)) | (F.col(c) > F.percentile(c, F.lit(limits[1])).over(day)) for c in columns})
    after = edges.agg(n(F.col("_bad")).alias("bad_rows"), n(~F.col("_bad")).alias("output_rows"), *[n(~F.col("_bad") & F.col(f"_{c}")).alias(f"clipped_{c}") for c in columns])
    return before.unpivot([], before.columns, "item", "n").unionByName(after.unpivot([], after.columns, "item", "n"))


def _clean(data: DataFrame, limits: tuple[float, float]) -> DataFrame:
    data = _adjusted(data).where(~F.coalesce(F.expr(BAD), F.lit(False)))
    day = Window.partitionBy("date")
    clipped = _clipped_columns(data)
    edges = data.withColumns({f"{c}_{i}": F.percentile(c, F.lit(q)).over(day) for c in clipped for i, q in enumerate(limits)})
    data = edges.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, f"{c}_0"), f"{c}_1")) for c in clipped}).drop(*[f"{c}_{i}" for c in clipped for i in (0, 1)])
    score = lambda c: F.coalesce(F.when(F.stddev_samp(c).over(day) > 1e-12, (F.col(c) - F.avg(c).over(day)) / F.stddev_samp(c).over(day)), F.lit(0.0))
    return data.withColumns({f"z_{c}": score(c) for c in ("open", "high", "low", "close", "volume", "vwap")})


def _clipped_columns(data: DataFrame) -> list[str]:
    return [*PRICES, *[c for c in ("volume", "amount") if c in data.columns]]


def _adjusted(data: DataFrame) -> DataFrame:
    if "vwap" not in data.columns:
        data = data.withColumn("vwap", F.col("amount") / F.nullif("volume", F.lit(0.0)) if "amount" in data.columns else (F.col("high") + F.col("low") + F.col("close")) / 3)
    so_far = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    fill = lambda x: F.last(x, ignorenulls=True).over(so_far)
    flows = [c for c in ("volume", "amount") if c in data.columns]
    data = data.withColumns({c: fill(F.col(c)) for c in PRICES} | {c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in flows} | ({"adj_factor": F.coalesce(fill(F.when(F.col("adj_factor") > 0, F.col("adj_factor"))), F.lit(1.0))} if "adj_factor" in data.columns else {}))
    if "adj_factor" in data.columns:
        data = data.withColumns({c: F.col(c) * F.col("adj_factor") for c in PRICES} | {"volume": F.col("volume") / F.col("adj_factor")})
    return data


def liquid_universe(df: DataFrame, n: int, start=None, end=None) -> DataFrame:
    """The ``n`` codes with the largest sums of positive amounts in [start, end]; ties by code."""
    rows = between(df, start, end) if start or end else df
    return rows.groupBy("code").agg(F.sum(F.greatest("amount", F.lit(0.0))).alias("turnover")).orderBy(F.desc("turnover"), "code").limit(n)


def between(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Rows with start <= date <= end; the bounds reach the scan."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df.where(F.col(column) <= F.lit(end)) if end is not None else df


def sliced(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """``between``; raises if no row is left."""
    rows = between(df, start, end, column)
    if rows.isEmpty():
        raise ValueError(f"no rows in [{start}, {end}]")
    return rows


def require_coverage(df: DataFrame, start, end, days: int = 7, column: str = "date") -> DataFrame:
    """One row: first, last, and whether they lie within ``days`` of [start, end]."""
    edges = df.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    near = (F.col("first") <= F.date_add(F.lit(start).cast("date"), days)) & (F.col("last") >= F.date_sub(F.lit(end).cast("date"), days))
    return edges.withColumn("covered", F.coalesce(near, F.lit(False)))


def check_split(train_start, train_end, test_start, test_end) -> None:
    if not train_start <= train_end < test_start <= test_end:
        raise ValueError("the test period must follow the training period")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``; raises if ``keys`` repeat."""
    again = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{keys} repeat, for example {again[0].asDict()}")
    return df


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clean_minutes(df: DataFrame, order: Column | str) -> DataFrame:
    """Bars with valid keys and prices, activity clipped at 0, the last of each (date, code, datetime)."""
    bad = (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0) | (F.col("low") > F.col("high"))
    key = F.col("date").isNotNull() & F.col("datetime").isNotNull() & F.col("code").isNotNull()
    kept = df.where(key & ~F.coalesce(bad, F.lit(False))).withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(c, F.lit(0.0))) for c in ("vol", "amount")})
    return last_of_key(kept, ("date", "code", "datetime"), (order,))


def daily_from_minutes(bars: DataFrame) -> DataFrame:
    """First open, highest high, lowest low, last close and sums of each day: one two-step aggregation."""
    at = F.struct("datetime", "seq")
    first = lambda c, fn: fn(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at))
    days = bars.groupBy("date", "code").agg(
        first("open", F.min_by).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), first("close", F.max_by).alias("close"),
        F.sum("vol").alias("volume"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("bars"),
    )
    return days.withColumn("vwap", F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")))


def minute_of_day(x: Column, kind: str) -> Column:
    """Minutes since midnight of a time given as 'timestamp', 'text', or a number of 'ns', 'ms', 's' or 'min'; -1 if unreadable."""
    if kind == "timestamp":
        out = F.hour(x) * 60 + F.minute(x)
    elif kind == "text":
        clock = F.regexp_extract(F.trim(x), r"(\d{1,2}):(\d{2})(?::[\d.]+)?$", 0)
        out = F.when(clock != "", F.split(clock, ":")[0].cast("int") * 60 + F.split(clock, ":")[1].cast("int"))
    else:
        out = F.floor(x / {"ns": 60_000_000_000, "ms": 60_000, "s": 60, "min": 1}[kind])
    return F.coalesce(out.cast("long"), F.lit(-1).cast("long"))


#: The sessions of a trading day, in minutes since midnight.
SESSIONS = ((565, 565), (571, 690), (781, 900))


def session_grid(spark: SparkSession, sessions=SESSIONS) -> DataFrame:
    """minute: each minute of the sessions."""
    parts = F.flatten(F.array(*[F.sequence(F.lit(a), F.lit(b)) for a, b in sessions]))
    return spark.range(1).select(F.explode(parts).alias("minute")).select(F.col("minute").cast("long"))


def densify(bars: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """A row for each (date, code) that has bars and each minute of the bounded ``grid``; present tells if there was a bar."""
    minutes = grid.agg(F.sort_array(F.collect_set("minute")).alias("minutes"))  # one row
    keys = bars.select("date", "code").distinct().join(F.broadcast(minutes)).select("date", "code", F.explode("minutes").alias("minute"))
    own = last_of_key(bars.withColumn("minute", minute_of_day(F.col("datetime"), "timestamp")), ("date", "code", "minute"), ("datetime", "seq"))
    return keys.join(own.select("date", "code", "minute", value, F.lit(True).alias("present")), ["date", "code", "minute"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def audit_minutes(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """A row per date: observed, missing and extra minutes, value issues, duplicates, status. Missing and extra are anti joins
    of distinct (date, minute), so no date's rows are gathered."""
    at = minute_of_day(F.col("datetime"), "timestamp").alias("minute")
    seen = bars.where("datetime is not null").select("date", at).distinct()
    extra = seen.join(expected, "minute", "left_anti").groupBy("date").agg(F.count(F.lit(1)).alias("extra_minutes"))
    hits = seen.join(expected, "minute", "left_semi").groupBy("date").agg(F.count(F.lit(1)).alias("hits"))
    observed = seen.groupBy("date").agg(F.count(F.lit(1)).alias("observed_minutes"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    c = F.col
    issues = bars.groupBy("date").agg(
        n(c("code").isNull() | c("datetime").isNull()).alias("invalid_key_rows"),
        n(c("open").isNull() | c("high").isNull() | c("low").isNull() | c("close").isNull() | c("vol").isNull() | c("amount").isNull()).alias("null_value_rows"),
        n((c("open") <= 0) | (c("high") <= 0) | (c("low") <= 0) | (c("close") <= 0)).alias("non_positive_price_rows"),
        n((c("high") < c("low")) | (c("high") < c("open")) | (c("high") < c("close")) | (c("low") > c("open")) | (c("low") > c("close"))).alias("invalid_ohlc_rows"),
        n((c("vol") < 0) | (c("amount") < 0)).alias("negative_activity_rows"),
    )
    again = bars.groupBy("date", "code", "datetime").agg((F.count(F.lit(1)) - 1).alias("more")).groupBy("date").agg(F.sum("more").alias("duplicate_rows"))
    size = expected.agg(F.count(F.lit(1)).alias("expected_minutes"))
    out = issues.join(observed, "date", "left").join(hits, "date", "left").join(extra, "date", "left").join(again, "date", "left").join(F.broadcast(size)).na.fill(0)
    out = out.withColumn("missing_minutes", c("expected_minutes") - c("hits")).drop("hits")
    wrong = ["missing_minutes", "extra_minutes", "duplicate_rows", "invalid_key_rows", "null_value_rows", "non_positive_price_rows", "invalid_ohlc_rows", "negative_activity_rows"]
    return out.withColumn("status", F.when(sum((F.col(x) for x in wrong), F.lit(0)) > 0, "problem").otherwise("ok"))


def audit_symbols(bars: DataFrame, expected_rows: int) -> DataFrame:
    """date, code, rows, first and last time, and whether the count is as expected."""
    out = bars.groupBy("date", "code").agg(F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"))
    return out.withColumn("issue", F.when(F.col("n") < expected_rows, "short").when(F.col("n") > expected_rows, "long").otherwise("ok"))


def quality_report(df: DataFrame) -> DataFrame:
    """column, missing: NULLs of each column, in one pass."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "missing").withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))


def replace_range(old: DataFrame, new: DataFrame, start, end, column: str = "date") -> DataFrame:
    """``old`` with its rows of [start, end] replaced by those of ``new``."""
    inside = F.col(column).between(F.lit(start), F.lit(end))
    return old.where(~inside).unionByName(new.where(inside).select(*old.columns))


def audit_schema(df: DataFrame, required: Mapping[str, Sequence[str]], kinds: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """field, status, sources: whether each required field is there (direct), can be made of the columns it names (derived), or is missing;
    a column of another kind than ``kinds`` allows counts as missing."""
    have = dict(df.dtypes)
    fits = lambda c: c in have and (not (kinds or {}).get(c) or any(have[c].startswith(k) for k in kinds[c]))
    rows = [(f, "direct", f) if fits(f) else (f, "derived", ",".join(s)) if s and all(map(fits, s)) else (f, "missing", None) for f, s in required.items()]
    return df.sparkSession.createDataFrame(rows, "field string, status string, sources string")


def validate_repair(old: DataFrame, new: DataFrame, start, end, keys: Sequence[str] = ("date", "code"), value: str = "value") -> DataFrame:
    """One row: rows outside [start, end] that differ, keys that repeat or went missing, and NULLs inside."""
    inside = F.col("date").between(F.lit(start), F.lit(end))
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(1).alias("_in_old"))
    b = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_new"))
    both = a.join(b, list(keys), "full_outer")
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0).cast("long"))
    return both.agg(n(~inside & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed_outside"), n(F.col("_n") > 1).alias("repeated"), n(F.col("_n").isNull()).alias("lost"), n(inside & F.col("_n").isNotNull() & F.col("_new").isNull()).alias("null_inside"))
