"""Staged runs that can be taken up again, and a gate over experiments."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_stages(spark: SparkSession, folder: str, stages: Sequence[tuple[str, dict, Callable[[dict[str, DataFrame]], DataFrame]]]) -> dict[str, DataFrame]:
    """Results of (name, settings, function) in turn, each a table in ``folder`` under a digest of its settings and of all before.

    A stage whose table is complete (Spark marks that with _SUCCESS) isn't run again. Functions get the results so far.
    """
    done: dict[str, DataFrame] = {}
    chain = ""
    for name, settings, make in stages:
        chain = hashlib.sha256(json.dumps([chain, name, settings], sort_keys=True, default=str).encode()).hexdigest()
        path = f"{folder}/{name}-{chain[:16]}"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            make(done).write.mode("overwrite").parquet(path)
        done[name] = spark.read.parquet(path)
    return done


def promoted(results: DataFrame, base: str, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """experiment, gap_<metric>, promoted: an experiment passes if it beats ``base`` by at least ``least`` and exceeds it by at most ``most``."""
    metrics = [*least, *most]
    own = results.where(F.col("experiment") == base).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    gaps = results.join(F.broadcast(own.limit(1))).select("experiment", *[(F.col(m) - F.col(f"_{m}")).alias(f"gap_{m}") for m in metrics])
    passes = F.lit(True)
    for m, x in least.items():
        passes &= F.col(f"gap_{m}") >= x
    for m, x in most.items():
        passes &= F.col(f"gap_{m}") <= x
    return gaps.withColumn("promoted", F.coalesce(passes, F.lit(False)) & (F.col("experiment") != base))
