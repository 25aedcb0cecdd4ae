"""Token counts from the exact histogram of encoded lengths.

Documents are aggregated by their encoded length; there are far fewer lengths than documents, and partial counts
meet in a two-step aggregation, so a very common length is no hot key. Suffix sums over the histogram then give, for the length of every
row as a context limit, how many documents are at least as long, their tokens, and the corpus total with every document truncated there.
Sums run in two levels (within ranges of ``RANGE`` lengths, and over the ranges), so no task holds the whole histogram.

Defined cases: a null or empty text has length 0; rows that repeat each count; no rows give an empty histogram; limits below, between and above the
lengths are answered exactly, and quantiles are the smallest length that the share of documents reaches; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm import bpe
from panelyard.session import stored

RANGE = 128


def histogram(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""
    lengths = bpe.lengths(docs, path, pattern, id_col, text_col)
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``hist`` with docs_at_least, tokens_at_least, truncated_tokens (the total at this context limit) and quantile (the share
    of documents that are no longer)."""
    own = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / RANGE).alias("part"))
    parts = own.groupBy("part").agg(F.sum("docs").alias("part_docs"), F.sum("tokens").alias("part_tokens"))
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # a row for RANGE lengths
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    parts = parts.select("part", *[F.coalesce(F.sum(f"part_{x}").over(later), zero).alias(f"later_{x}") for x in ("docs", "tokens")], *[F.sum(f"part_{x}").over(every).alias(f"all_{x}") for x in ("docs", "tokens")])
    here = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    out = own.join(parts, "part").withColumns({f"{x}_at_least": F.sum(x).over(here) + F.col(f"later_{x}") for x in ("docs", "tokens")})
    truncated = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.select("n_tokens", "docs", "docs_at_least", "tokens_at_least", truncated.alias("truncated_tokens"), ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("quantile"))


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, tokens, truncated_docs, lost_tokens for any limits, in one pass over the histogram."""
    cut = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.sum(F.least("n_tokens", F.lit(x)) * F.col("docs")), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("docs"))), F.lit(0)).cast("long").alias("truncated_docs"), F.coalesce(F.sum(F.greatest(F.col("n_tokens") - x, F.lit(0)) * F.col("docs")), F.lit(0)).cast("long").alias("lost_tokens")) for x in limits]
    return hist.agg(F.array(*cut).alias("rows")).select(F.inline("rows"))


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of documents doesn't exceed."""
    sums = suffix_sums(hist)
    one = sums.agg(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]).alias("rows"))
    return one.select(F.inline("rows"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram and suffix sums over the encoded lengths of every whole text of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hist = histogram(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return suffix_sums(stored(hist, "lengths"))  # read twice, made once
