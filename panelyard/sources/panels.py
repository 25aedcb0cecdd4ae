"""Panels from the tables of a folder: monthly bars of suppliers, and ticks of user groups.

Both are deterministic, so that SQL on the same tables can check what is computed on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = 25


def bars(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """date, code, OHLC, volume, amount, vwap; ``nulls``: each eleventh close (by date and code) is missing."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("code"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("key"), "l_quantity", "l_extendedprice",
    )
    days = rows.groupBy("date", "code").agg(
        F.min_by("p", "key").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "key").alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )
    out = days.withColumn("vwap", F.col("amount") / F.col("volume"))
    if nulls:
        out = out.withColumn("close", F.when((F.month("date") + F.col("code")) % 11 != 0, F.col("close")))
    return out


def with_risk(panel: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``panel`` with industry and market_cap of each code. The codes are a key-to-key join; adaptive execution broadcasts it if small."""
    facts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("code"), (F.col("s_nationkey") % 5).cast("string").alias("industry"), F.col("s_acctbal").alias("market_cap")
    )
    return panel.join(facts, "code", "left")


def ticks(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """Bars within days: date, code, datetime, seq (which orders equal times), OHLC, vol, amount."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    open_ = F.col("value") * (1 + ((F.col("event_id") % 7) - 3) * F.lit(0.001))
    out = e.select(F.to_date("ts").alias("date"), (F.col("user_id") % CODES).alias("code"), F.col("ts").alias("datetime"), F.col("event_id").alias("seq"), open_.alias("open"), F.col("value").alias("close"), (1 + F.col("event_id") % 100).cast("double").alias("vol"))
    out = out.select("*", (F.greatest("open", "close") * 1.002).alias("high"), (F.least("open", "close") * 0.998).alias("low"), (F.col("close") * F.col("vol")).alias("amount"))
    if nulls:
        out = out.withColumn("close", F.when(F.col("seq") % 11 != 0, F.col("close")))
    return out


BARS_SQL = """bars as (
  select date, code, open, high, low, {close} as close, volume, amount, amount / volume as vwap from (
    select date_trunc('month', l_shipdate)::date as date, l_suppkey as code, arg_min(p, key) as open, max(p) as high, min(p) as low, arg_max(p, key) as close,
      sum(l_quantity) as volume, sum(l_extendedprice) as amount
    from (select *, l_extendedprice / l_quantity as p, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as key from lineitem)
    group by all))"""
TICKS_SQL = """ticks as (
  select date, code, datetime, seq, open, {close} as close, vol, greatest(open, close) * 1.002 as high, least(open, close) * 0.998 as low, close * vol as amount from (
    select ts::date as date, user_id % 25 as code, ts as datetime, event_id as seq, value * (1 + ((event_id % 7) - 3) * 0.001::double) as open, value as close,
      (1 + event_id % 100)::double as vol from events))"""


def bars_sql(nulls: bool = False) -> str:
    return BARS_SQL.format(close="case when (month(date) + code) % 11 <> 0 then close end" if nulls else "close")


def ticks_sql(nulls: bool = False) -> str:
    return TICKS_SQL.format(close="case when seq % 11 <> 0 then close end" if nulls else "close")
