"""A training corpus in five stages; each is one operator over all that the stage before it kept.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``docs``. ``run`` applies them to the ``documents`` of a folder, writing each result as Parquet to the
shared folder and reading it again, so a lost executor costs one stage at most.

Rejected: documents without a language (no letter at all, or no language whose share of the words stands out, ``langid.STAND_OUT``); documents predicted toxic; of each near-duplicate group all
but the document with the smallest doc_id; contaminated documents. The last stage encodes what is left and returns its digests.

Defined cases: those of the operators; where no row has a lang, only texts without a letter are rejected by language; texts are judged row by row, so rows that share a doc_id, or have none, are judged by their
own text; rows without a doc_id aren't dropped as duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import bpe, decontaminate, langid, simhash, toxicity
from panelyard.llm.lm import held_out
from panelyard.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_language(docs, langid.train(docs, ~held_out(F.col("doc_id"), 3, 1)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(toxicity.sample(docs, labels, ~held_out(F.col("doc_id"), 5, 0))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash_near_dedup", near_duplicates), ("decontamination", contamination), ("bpe", tokens)]

#: No stage but the fourth can be said in SQL; tests/llm/test_pipeline.py replays the decisions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
