"""Scores of factors against forward returns.

All factors are scored in one plan over the long form (factor, date, code, value, target): windows share the partition (factor, date),
which also holds for finer ones, so the long form is shuffled once and reduced to a row per factor and date, then per factor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalar import EPS, average_rank, corr_agg, finite, moment_corr, pct_rank
from panelyard.session import stored

YEAR = 252.0
#: Sums over the rows where both sides of a pair are known.
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def forward_return(panel: DataFrame, horizon: int = 5) -> DataFrame:
    """``panel`` with target: close of row t+horizon over that of row t+1, less one, along each code's own rows."""
    if horizon <= 1:
        raise ValueError("the return runs from t+1 to t+horizon, so horizon must exceed 1")
    rows = Window.partitionBy("code").orderBy("date")
    start, end = F.lead("close", 1).over(rows), F.lead("close", horizon).over(rows)
    return panel.withColumn("target", finite(F.when(start != 0, end / start - 1)))


def long_form(frame: DataFrame, factors: list[str]) -> DataFrame:
    keys = [c for c in frame.columns if c not in factors]
    return frame.unpivot(keys, factors, "factor", "value").withColumn("value", finite(F.col("value").cast("double"))).withColumn("target", finite(F.col("target")))


def once(long: DataFrame) -> DataFrame:
    """The long form as a table of the shared folder, for what reads it several times: factors are computed once."""
    return stored(long, "long")


def _per_day():
    return Window.partitionBy("factor", "date")


def _ratio_of(mean: Column, std: Column, n: Column, horizon: int) -> Column:
    return F.when((n > 1) & (std > 0), mean / std * math.sqrt(YEAR / (horizon - 1))).otherwise(0.0)


def _tops(long: DataFrame, quantile: float) -> DataFrame:
    """Rows with both numbers, marked where the value reaches its day's upper quantile."""
    both = long.where("value is not null and target is not null")
    cut = F.percentile("value", F.lit(1.0 - quantile)).over(_per_day())
    return both.withColumn("cut", cut).withColumn("top", F.col("value") >= F.col("cut"))


def reward(
    long: DataFrame, horizon: int = 5, min_cross_section: int = 20, min_coverage: float = 0.8, coverage_power: float = 2.0, top_quantile: float = 0.1, risk_aversion: float = 0.5, floor: float = 1e-8
) -> DataFrame:
    """A row per factor: rank IC, long-leg information ratio, exposures, coverages, reward. Needs industry and market_cap."""
    day = _per_day()
    eligible = long.where("target is not null").withColumns({"n_all": F.count(F.lit(1)).over(day), "n": F.count("value").over(day)}).where(F.col("n_all") >= min_cross_section)
    # Scored rows are marked, not filtered, so that coverage comes from the same pass.
    scored = F.col("value").isNotNull() & (F.col("n") >= min_cross_section)
    size = F.when(F.col("market_cap").isNotNull(), F.greatest("market_cap", F.lit(0.0)))
    marked = eligible.withColumns({"v": F.when(scored, F.col("value")), "t": F.when(scored, F.col("target")), "size": F.when(scored, size)})
    marked = marked.withColumns({"value_s": F.when(F.col("size").isNotNull(), F.col("v")), "value_i": F.when(F.col("industry").isNotNull(), F.col("v")), "kind": F.when(scored, F.col("industry"))})
    ranked = marked.withColumns(
        {
            "cut": F.percentile("v", F.lit(1.0 - top_quantile)).over(day), "rank_v": average_rank(F.col("v"), day), "rank_t": average_rank(F.col("t"), day), "rank_s": average_rank(F.col("size"), day),
            "rank_vs": average_rank(F.col("value_s"), day), "mean_d": F.avg("value_i").over(day), "mean_i": F.avg("value_i").over(Window.partitionBy("factor", "date", "kind")),
        }
    )
    days = ranked.groupBy("factor", "date").agg(
        F.count(F.lit(1)).alias("n_all"), F.count("value").alias("n"), corr_agg(F.col("rank_v"), F.col("rank_t")).alias("ic"),
        (F.avg(F.when(F.col("v") >= F.col("cut"), F.col("t"))) - F.avg("t")).alias("excess"),
        F.when(F.count("size") >= 5, F.abs(corr_agg(F.col("rank_vs"), F.col("rank_s")))).alias("size_ic"),
        F.count("value_i").alias("n_i"), (F.min("kind") != F.max("kind")).alias("mixed"),
        F.sum((F.col("value_i") - F.col("mean_d")) ** 2).alias("total"), F.sum((F.col("value_i") - F.col("mean_i")) ** 2).alias("within"),
    )
    explained = F.when((F.col("n_i") >= 8) & F.col("mixed") & (F.col("total") > EPS), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("within") / F.col("total"))))
    zero = F.lit(0.0)
    out = days.groupBy("factor").agg(
        (F.sum("n") / F.sum("n_all")).alias("coverage"), (F.sum((F.col("n") >= min_cross_section).cast("long")) / F.count(F.lit(1))).alias("date_coverage"),
        F.coalesce(F.avg("ic"), zero).alias("rank_ic"), _ratio_of(F.avg("excess"), F.stddev_samp("excess"), F.count("excess"), horizon).alias("long_ir"),
        F.coalesce(F.avg("excess") * (YEAR / (horizon - 1)), zero).alias("annualized"), F.coalesce(F.avg(explained), zero).alias("industry_exposure"), F.coalesce(F.avg("size_ic"), zero).alias("size_exposure"),
    )
    penalty = F.least(F.lit(1.0), F.pow(F.least("coverage", "date_coverage") / min_coverage, F.lit(coverage_power)))
    value = F.abs("rank_ic") * F.greatest(F.lit(0.05), 1 + F.least(F.greatest("long_ir", F.lit(-0.95)), F.lit(5.0))) * F.exp(-risk_aversion * (F.col("industry_exposure") + F.col("size_exposure"))) * penalty
    return out.withColumn("penalty", penalty).withColumn("reward", F.greatest(F.lit(floor), value))


def _days(both: DataFrame, top: Column) -> DataFrame:
    """factor, date, n, ic_all, rank_ic_all, excess of the marked rows, over rows with both numbers."""
    day = _per_day()
    ranked = both.withColumns({"rank_v": average_rank(F.col("value"), day), "rank_t": average_rank(F.col("target"), day)})
    return ranked.groupBy("factor", "date").agg(
        F.count(F.lit(1)).alias("n"), corr_agg(F.col("value"), F.col("target")).alias("ic_all"), corr_agg(F.col("rank_v"), F.col("rank_t")).alias("rank_ic_all"), (F.avg(F.when(top, F.col("target"))) - F.avg("target")).alias("excess")
    )


def daily_ic(long: DataFrame, min_cross_section: int = 20) -> DataFrame:
    """factor, date, ic, rank_ic on rows with both numbers, on days with enough of them."""
    days = _days(long.where("value is not null and target is not null"), F.lit(False))
    return days.where(F.col("n") >= min_cross_section).select("factor", "date", F.col("ic_all").alias("ic"), F.col("rank_ic_all").alias("rank_ic"))


def stability(long: DataFrame) -> DataFrame:
    """factor, rank_stability, rank_turnover: ranks of a code on neighbouring dates of the whole panel."""
    dates = long.select("date").distinct().withColumn("at", F.row_number().over(Window.orderBy("date")))  # a row per date
    ranked = long.withColumn("rank", pct_rank(F.col("value"), _per_day())).join(dates, "date")
    before = Window.partitionBy("factor", "code").orderBy("date")
    pairs = ranked.withColumn("last", F.when(F.lag("at").over(before) == F.col("at") - 1, F.lag("rank").over(before))).where("rank is not null and last is not null")
    days = pairs.groupBy("factor", "date").agg(F.count(F.lit(1)).alias("n"), corr_agg(F.col("rank"), F.col("last")).alias("c"), F.avg(F.abs(F.col("rank") - F.col("last"))).alias("change")).where("n >= 3")
    return days.groupBy("factor").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("rank_stability"), F.coalesce(F.avg("change"), F.lit(1.0)).alias("rank_turnover"))


def summary(long: DataFrame, horizon: int = 5, min_cross_section: int = 20, rolling: int = 60, top_quantile: float = 0.1) -> DataFrame:
    """A row per factor: IC, RankIC, ICIR, Sharpe, rolling and temporal stability, rank stability and turnover.

    ``long`` is read three times; unless it is a table already, make it one with ``once``.
    """
    days = _days(_tops(long, top_quantile), F.col("top"))
    known = (F.col("n") >= min_cross_section) & F.col("rank_ic_all").isNotNull()
    days = days.select("factor", "date", "excess", F.when(F.col("n") >= min_cross_section, F.col("ic_all")).alias("ic"), F.when(known, F.col("rank_ic_all")).alias("rank_ic"), known.alias("known"))
    # Days without a rank IC are a partition of their own, so that they take no place in the rolling frames.
    frame = Window.partitionBy("factor", "known").orderBy("date").rowsBetween(-(rolling - 1), 0)
    whole = Window.partitionBy("factor")
    days = days.withColumns({"roll": F.when(F.count("rank_ic").over(frame) >= min(10, rolling), F.avg("rank_ic").over(frame)), "mean": F.avg("rank_ic").over(whole)})
    zero = F.lit(0.0)
    out = days.groupBy("factor").agg(
        _ratio_of(F.avg("excess"), F.stddev_samp("excess"), F.count("excess"), horizon).alias("Sharpe"), F.avg("ic").alias("IC"), F.avg("rank_ic").alias("RankIC"),
        _ratio_of(F.avg("rank_ic"), F.stddev_samp("rank_ic"), F.count("rank_ic"), horizon).alias("ICIR"), F.coalesce(F.avg("roll"), F.avg("rank_ic")).alias("rolling_ic_mean"),
        F.when(F.count("roll") > 1, F.stddev_samp("roll")).otherwise(zero).alias("rolling_ic_std"), F.avg((F.signum("rank_ic") == F.signum("mean")).cast("double")).alias("same"),
    )
    out = out.join(stability(long), "factor", "left").na.fill(0.0)
    return out.withColumn("temporal_stability", F.col("same") / (1 + F.col("rolling_ic_std"))).drop("same")


def perturbed(long: DataFrame, scale: float = 0.05, seed: int = 42) -> DataFrame:
    """``long`` with normal noise of ``scale`` daily deviations; the noise is a function of (seed, factor, date, code)."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "factor", "date", "code"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * math.pi * unit(1))
    return long.withColumn("value", F.col("value") + normal * scale * F.coalesce(F.stddev_samp("value").over(_per_day()), F.lit(0.0)))


def robustness(long: DataFrame, min_cross_section: int = 20) -> DataFrame:
    """factor, robustness: how little the mean rank IC moves under noise."""
    base = daily_ic(long, min_cross_section).groupBy("factor").agg(F.coalesce(F.avg("rank_ic"), F.lit(0.0)).alias("base"))
    noisy = daily_ic(perturbed(long), min_cross_section).groupBy("factor").agg(F.avg("rank_ic").alias("noisy"))
    kept = 1 - F.abs(F.col("noisy") - F.col("base")) / F.greatest(F.abs("base"), F.lit(0.01))
    return base.join(noisy, "factor", "left").select("factor", F.when(F.col("noisy").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), kept))).alias("robustness"))


def logic_score(complexity: float, depth: float) -> float:
    return math.exp(-0.08 * max(0.0, complexity - 5.0) - 0.20 * max(0.0, depth - 3.0))


def rank_correlation(frame: DataFrame, factors: list[str], max_rows: int | None = None) -> DataFrame:
    """a, b, corr for each pair of factors: correlation of daily percentile ranks over every date. Only a caller that names ``max_rows``
    gets evenly spaced dates of larger panels instead.

    Each partition adds up the moments of all pairs as matrix products, and sends one row per pair.
    """
    if max_rows is not None:
        counts = frame.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
        n_rows, n_dates = counts.agg(F.sum("n"), F.count("n")).first()
        if (n_rows or 0) > max_rows:
            wanted = max(1, int(n_dates * max_rows / n_rows))
            spots = sorted({int(x) for x in np.linspace(0, n_dates - 1, wanted)})
            dates = counts.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("at")).where(F.col("at").isin(spots))
            frame = frame.join(dates.select("date"), "date", "left_semi")
    day = Window.partitionBy("date")
    ranked = frame.select(*[pct_rank(F.col(f), day).alias(f"x{i}") for i, f in enumerate(factors)])
    k = len(factors)
    a, b = np.triu_indices(k, 1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            square = (x * x).T @ m
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, square, square.T, x.T @ x])
        yield pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(t[a, b]) for t in total]], names=["i", "j", *MOMENTS])

    parts = ranked.mapInArrow(moments, "i int, j int, " + ", ".join(f"{c} double" for c in MOMENTS))
    pairs = parts.groupBy("i", "j").agg(moment_corr(*[F.sum(c) for c in MOMENTS]).alias("corr"))
    names = F.array(*[F.lit(f) for f in factors])
    return pairs.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.coalesce("corr", F.lit(0.0)).alias("corr"))


def determinantal_choice(kernel: np.ndarray, k: int) -> list[int]:
    """Greedy choice of ``k`` rows of a positive semidefinite kernel: each next row adds most to the log determinant."""
    left = np.clip(np.diag(kernel).astype(float), 0, None)
    basis = np.zeros((0, len(kernel)))
    chosen: list[int] = []
    while len(chosen) < min(k, len(kernel)):
        best = int(np.argmax(left))
        if left[best] <= EPS:
            break
        row = (kernel[best] - basis[:, best] @ basis) / math.sqrt(left[best])
        basis = np.vstack([basis, row])
        chosen.append(best)
        left = np.clip(left - row * row, 0, None)
        left[chosen] = -np.inf
    return chosen


def _z(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / x.std() if len(x) and x.std() > EPS else np.zeros(len(x))


def scores(frame: DataFrame, factors: dict[str, tuple[int, int]], choose: int = 3, horizon: int = 5, min_cross_section: int = 20) -> DataFrame:
    """The whole evaluation: a row per factor with its scores, diversity and whether it is chosen. ``factors``: (complexity, depth) by name.

    Only rows per factor and the pairwise correlations reach the driver.
    """
    frame = stored(frame.select("date", "code", "target", *factors), "factors")
    long = long_form(frame, list(factors))
    table = summary(long, horizon, min_cross_section).join(robustness(long, min_cross_section), "factor").orderBy("factor").toPandas()
    table["logic_score"] = [logic_score(*factors[f]) for f in table.factor]
    table["pps_score"] = _z(table.RankIC.abs().to_numpy()) + _z(table.ICIR.abs().to_numpy())
    table["rre_score"] = _z(table.rank_stability.to_numpy()) - _z(table.rank_turnover.to_numpy())
    weights = {"pps_score": 0.35, "temporal_stability": 0.20, "robustness": 0.15, "logic_score": 0.15, "rre_score": 0.15}
    table["base_score"] = sum(w * _z(table[c].to_numpy()) for c, w in weights.items())
    at = {f: i for i, f in enumerate(table.factor)}
    corr = np.eye(len(at))
    for r in rank_correlation(frame, list(at)).collect():
        corr[at[r.a], at[r.b]] = corr[at[r.b], at[r.a]] = r["corr"]
    quality = np.exp(np.clip(table.base_score.to_numpy(), -4, 4))
    chosen = determinantal_choice(quality[:, None] * np.clip(corr, -1, 1) ** 2 * quality[None, :] + 1e-8 * np.eye(len(at)), choose)
    table["chosen"] = [i in chosen for i in range(len(at))]
    table["diversity"] = [1.0 - np.mean([abs(corr[i, j]) for j in chosen if j != i]) if set(chosen) - {i} else 1.0 for i in range(len(at))]
    table["score"] = table.base_score + 0.20 * _z(table.diversity.to_numpy())
    return frame.sparkSession.createDataFrame(table)


def buckets(x: Column, whole, order: list, q: int = 5) -> Column:
    """Quantile bucket 1..q of x by its rank, ties in ``order``; NULL where fewer than q have one."""
    n, at = F.count(x).over(whole), F.row_number().over(whole.orderBy(x.asc_nulls_last(), *order))
    return F.when(x.isNotNull() & (n >= q), F.greatest(F.lit(1), F.ceil((at - 1) * q / F.nullif(n - 1, F.lit(0))).cast("int")))


def quantile_returns(long: DataFrame, q: int = 5) -> DataFrame:
    """factor, year, bucket, n, mean_target, mean of daily bucket means, and share of positive targets."""
    both = long.where("value is not null and target is not null")
    cut = both.withColumn("bucket", buckets(F.col("value"), _per_day(), ["code"], q)).where("bucket is not null")
    days = cut.groupBy("factor", "date", "bucket").agg(F.avg("target").alias("m"), F.count("target").alias("n"), F.sum((F.col("target") > 0).cast("long")).alias("up"))
    return days.groupBy("factor", F.year("date").alias("year"), "bucket").agg(F.sum("n").alias("n"), F.avg("m").alias("mean_target"), (F.sum("up") / F.sum("n")).alias("positive"))


def prediction_quality(long: DataFrame, top_n: int = 10, q: int = 5, lags: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """A row per factor: coverage of labels, the mean and positive share of each day's first ``top_n``, high less low bucket,
    monotonicity over buckets, autocorrelation of ranks at ``lags`` of the signal calendar."""
    day = _per_day()
    rows = long.where("value is not null")
    first = rows.withColumn("at", F.row_number().over(day.orderBy(F.desc("value"), "code")))
    tops = first.groupBy("factor").agg((F.count("target") / F.count(F.lit(1))).alias("label_coverage"), F.avg(F.when(F.col("at") <= top_n, F.col("target"))).alias("top_mean"), F.avg(F.when((F.col("at") <= top_n) & F.col("target").isNotNull(), (F.col("target") > 0).cast("double"))).alias("top_positive"))
    cut = rows.where("target is not null").withColumn("bucket", buckets(F.col("value"), day, ["code"], q)).where("bucket is not null")
    means = cut.groupBy("factor", "bucket").agg(F.avg("target").alias("m"))
    ranked = means.withColumn("r", average_rank(F.col("m"), Window.partitionBy("factor")))
    shape = ranked.groupBy("factor").agg((F.max(F.when(F.col("bucket") == q, F.col("m"))) - F.max(F.when(F.col("bucket") == 1, F.col("m")))).alias("high_low"), corr_agg(F.col("bucket").cast("double"), F.col("r")).alias("monotonicity"))
    dates = rows.select("date").distinct().withColumn("at", F.row_number().over(Window.orderBy("date")))
    ranks = rows.withColumn("rank", pct_rank(F.col("value"), day)).select("factor", "code", "date", "rank").join(dates, "date")
    out = tops.join(shape, "factor", "left")
    for lag in lags:
        earlier = ranks.select("factor", "code", (F.col("at") + lag).alias("at"), F.col("rank").alias("old"))
        days = ranks.join(earlier, ["factor", "code", "at"]).groupBy("factor", "at").agg(corr_agg(F.col("rank"), F.col("old")).alias("c"))
        out = out.join(days.groupBy("factor").agg(F.avg("c").alias(f"autocorr_{lag}")), "factor", "left")
    return out


def daily_quality(long: DataFrame, top_n: int = 10, q: int = 5) -> DataFrame:
    """factor, date, predictions, labels, rank_ic, top_mean (of the first ``top_n``), high_low and monotonicity over the day's buckets."""
    day = _per_day()
    rows = long.where("value is not null")
    both = F.col("target").isNotNull()
    marked = rows.withColumns({"at": F.row_number().over(day.orderBy(F.desc("value"), "code")), "v": F.when(both, F.col("value"))})
    marked = marked.withColumns({"rank_v": average_rank(F.col("v"), day), "rank_t": average_rank(F.col("target"), day), "bucket": buckets(F.col("v"), day, ["code"], q)})
    days = marked.groupBy("factor", "date").agg(F.count("value").alias("predictions"), F.count("target").alias("labels"), corr_agg(F.col("rank_v"), F.col("rank_t")).alias("rank_ic"), F.avg(F.when(F.col("at") <= top_n, F.col("target"))).alias("top_mean"))
    means = marked.where("bucket is not null").groupBy("factor", "date", "bucket").agg(F.avg("target").alias("m"))
    ranked = means.withColumn("r", average_rank(F.col("m"), day))
    shape = ranked.groupBy("factor", "date").agg((F.max(F.when(F.col("bucket") == q, F.col("m"))) - F.max(F.when(F.col("bucket") == 1, F.col("m")))).alias("high_low"), corr_agg(F.col("bucket").cast("double"), F.col("r")).alias("monotonicity"))
    return days.join(shape, ["factor", "date"], "left")


def annual_quality(days: DataFrame) -> DataFrame:
    """A row per factor and year of ``daily_quality``: dates, and mean, deviation, ratio and positive share of the IC, means of the rest."""
    ic = F.col("rank_ic")
    return days.groupBy("factor", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("dates"), F.count(ic).alias("ic_dates"), F.avg(ic).alias("ic_mean"), F.stddev_samp(ic).alias("ic_std"),
        F.when(F.stddev_samp(ic) > 0, F.avg(ic) / F.stddev_samp(ic) * math.sqrt(YEAR)).alias("ic_ir"), F.avg((ic > 0).cast("double")).alias("ic_positive"),
        F.avg("high_low").alias("high_low"), F.avg((F.col("high_low") > 0).cast("double")).alias("high_low_positive"), F.avg("monotonicity").alias("monotonicity"),
        F.avg("top_mean").alias("top_mean"), (F.sum("labels") / F.sum("predictions")).alias("label_coverage"),
    )
