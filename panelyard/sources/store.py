"""Readers and writers of panels and factors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelyard.plans.nodes import Node


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table by its suffix: .csv, .csv.gz, .json, .orc; anything else is Parquet. CSV needs a schema to keep its types."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    kind = path.removesuffix(".gz").rpartition(".")[2]
    if kind == "csv":
        return reader.csv(path, header=True)
    return reader.json(path) if kind == "json" else reader.orc(path) if kind == "orc" else reader.parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, start=None, end=None, codes: Sequence | None = None) -> DataFrame:
    """Rows of a CSV table by date (bounds included) and code; the filters go to the scan, which drops rows before it has read their other columns."""
    rows = spark.read.schema(schema).csv(path, header=True)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows if codes is None else rows.where(F.col("code").isin(*codes))


def write(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """``df`` by the suffix of ``path``; ``by``: partition columns, of which only those present are replaced."""
    kind = path.removesuffix(".gz").rpartition(".")[2]
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer = writer.partitionBy(*by) if by else writer
    if kind == "csv":
        writer.option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)
    elif kind in ("json", "orc"):
        getattr(writer, kind)(path)
    else:
        writer.parquet(path)


def fingerprint(df: DataFrame, expressions: dict[str, Node]) -> str:
    """SHA-256 of a schema and of expressions: the identity of a stored factor matrix."""
    return hashlib.sha256(json.dumps([df.schema.jsonValue(), {k: v.tokens() for k, v in sorted(expressions.items())}], sort_keys=True).encode()).hexdigest()


def exposures(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Risk exposures in folders by year: the filter on year prunes folders, that on date rows."""
    year = lambda x: F.year(F.lit(x).cast("date"))
    return spark.read.parquet(path).where(F.col("year").between(year(start), year(end)) & F.col("date").between(F.lit(start), F.lit(end)))


def content_digest(df: DataFrame) -> DataFrame:
    """One row: n and an order-free digest of all rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))
