"""Walk-forward fusion of factors into one prediction with Spark's own learners.

Gradient-boosted trees, a linear model with squared or Huber loss, and a linear ranker with a listwise loss over each date's relevance bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.evaluation.metrics import buckets, daily_quality
from panelyard.session import discard, shared_path, stored


@dataclass(frozen=True)
class Step:
    """Train on dates in [first, last], predict those in [start, end]; all inclusive."""

    first: object
    last: object
    start: object
    end: object


def windows(dates: Sequence, train: int, horizon: int, refit: int, start=None, end=None) -> list[Step]:
    """Steps over a sorted calendar; ``horizon`` dates before a step are left out, since their targets reach into it."""
    out = []
    at = next((i for i, d in enumerate(dates) if start is None or d >= start), len(dates))
    stop = len(dates) if end is None else sum(d <= end for d in dates)
    at = max(at, train + horizon)
    while at < stop:
        last = at - horizon - 1
        out.append(Step(dates[last - train + 1], dates[last], dates[at], dates[min(at + refit, stop) - 1]))
        at += refit
    return out


def prepared(matrix: DataFrame, factors: Sequence[str], top_quantile: float = 0.9, top_weight: float = 3.0, bins: int = 5) -> DataFrame:
    """``matrix`` with factors scored within their date (missing is 0), a sample weight for the upper targets and relevance bins."""
    day = Window.partitionBy("date")
    z = {f: F.coalesce(F.when(F.stddev_samp(f).over(day) > 1e-12, (F.col(f) - F.avg(f).over(day)) / F.stddev_samp(f).over(day)), F.lit(0.0)) for f in factors}
    cut = F.percentile("target", F.lit(top_quantile)).over(day)
    weight = F.when(F.col("target") >= cut, top_weight).otherwise(1.0)
    return matrix.select("date", "code", "target", *[c.alias(f) for f, c in z.items()], weight.alias("sample_weight"), (buckets(F.col("target"), day, ["code"], bins) - 1).alias("relevance"))


def learner(kind: str, seed: int = 7):
    shared = {"featuresCol": "features", "labelCol": "target", "weightCol": "sample_weight"}
    if kind == "trees":
        return GBTRegressor(maxIter=10, maxDepth=3, seed=seed, **shared)
    return LinearRegression(loss="huber" if kind == "huber" else "squaredError", maxIter=50, regParam=1e-3, **shared)


def listwise(train: DataFrame, factors: Sequence[str], ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights w that minimise the cross entropy, per date, of softmax(x w) against softmax(relevance), both weighted by sample_weight.

    The loss is convex: damped Newton steps. Rows of a date (a cross-section, bounded by the number of codes) are packed once into a
    table; a step is one pass over it without a shuffle, from which only sums (loss, gradient, Hessian) reach the driver.
    """
    k = len(factors)
    row = F.struct(F.array(*factors).alias("x"), F.col("relevance").cast("double").alias("y"), F.col("sample_weight").alias("s"))
    spark, path = train.sparkSession, shared_path(train.sparkSession, "lists")
    train.where("relevance is not null").groupBy("date").agg(F.collect_list(row).alias("rows")).select("rows").write.parquet(path)
    packed = spark.read.parquet(path)

    def sums(w: np.ndarray, ridge: float = ridge) -> tuple[float, np.ndarray, np.ndarray]:
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + k + k * k)
            for batch in batches:
                for rows in batch.column(0):
                    flat = rows.values
                    x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    y, s = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("y", "s"))
                    score = x @ w
                    top = score.max()
                    e, q = s * np.exp(score - top), s * np.exp(y - y.max())
                    p, q = e / e.sum(), q / q.sum()
                    mean = p @ x
                    total[0] += 1
                    total[1] += top + np.log(e.sum()) - q @ score
                    total[2 : 2 + k] += mean - q @ x
                    total[2 + k :] += ((x * p[:, None]).T @ x - np.outer(mean, mean)).ravel()
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tolist()], pa.list_(pa.float64()))})

        # Each partition sends one short row, whatever it holds.
        got = np.sum([r.total for r in packed.mapInArrow(parts, "total array<double>").collect()] or [np.zeros(2 + k + k * k)], axis=0)
        n = max(got[0], 1.0)
        return got[1] / n + ridge / 2 * w @ w, got[2 : 2 + k] / n + ridge * w, got[2 + k :].reshape(k, k) / n + ridge * np.eye(k)

    w = np.zeros(k)
    loss, slope, curve = sums(w)
    for _ in range(steps):
        move = np.linalg.solve(curve, slope)
        if slope @ move < 1e-12:
            break
        size = 1.0
        while size > 1e-6:
            next_ = sums(w - size * move)
            if next_[0] <= loss - 1e-4 * size * (slope @ move):
                break
            size /= 2
        else:
            break
        w, (loss, slope, curve) = w - size * move, next_
    discard(spark, path)
    return w


def quality(predictions: DataFrame, matrix: DataFrame, top_n: int = 10, q: int = 5) -> DataFrame:
    """A row per date of ``walk_forward``: predictions, labels, rank_ic, top_mean, high_low, monotonicity against the targets of ``matrix``."""
    joined = predictions.join(matrix.select("date", "code", "target"), ["date", "code"], "left")
    return daily_quality(joined.select(F.lit("score").alias("factor"), "date", "code", F.col("score").alias("value"), "target"), top_n, q).drop("factor")


def walk_forward(matrix: DataFrame, factors: Sequence[str], train: int, horizon: int, refit: int, kind: str = "trees") -> DataFrame:
    """date, code, score, rank on dates out of sample; targets of the predicted dates aren't read."""
    # Every window of the walk reads the prepared matrix, twice, so it is made once.
    data = VectorAssembler(inputCols=list(factors), outputCol="features").transform(stored(prepared(matrix, factors), "matrix"))
    dates = [r.date for r in data.select("date").distinct().orderBy("date").collect()]  # the calendar
    out = None
    for step in windows(dates, train, horizon, refit):
        past = data.where(F.col("date").between(step.first, step.last) & F.col("target").isNotNull())
        ahead = data.where(F.col("date").between(step.start, step.end))
        if kind == "listwise":
            score = sum((F.col(f) * float(x) for f, x in zip(factors, listwise(past, factors))), F.lit(0.0))
            part = ahead.select("date", "code", score.alias("score"))
        else:
            part = learner(kind).fit(past).transform(ahead).select("date", "code", F.col("prediction").alias("score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the calendar is shorter than one training window")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "code")))
