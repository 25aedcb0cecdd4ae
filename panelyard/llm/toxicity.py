"""Toxicity by weak supervision.

Voters are mined from labelled rows: whole words (the lexicon) and word beginnings (the patterns) that go with label 1 vote toxic where
they occur, those that go with label 0 vote clean, and counts of the first kind vote both ways: none of them, more than one,
more than three. The given label is a voter like the others. A generative label model, a latent class with two rates per voter
(how often it fires on clean and on toxic texts), estimates all of them by EM, the label's too, which only starts it. From the posteriors
come the correlations between voters that the class doesn't explain; a voter counts for one over the sum of its
squared correlations, so that voters that say the same thing count once. The posteriors, not the labels, train a
linear classifier on the presence of words and word beginnings, which scores all texts.

Mining and fitting happen on the driver, on at most ``SAMPLE_ROWS`` labelled texts per label and ``SAMPLE_BYTES`` of toxic
text, half as much of clean, chosen by a hash of doc_id. The sample's ids go to the documents as a broadcast of at most twice ``SAMPLE_ROWS`` rows.
Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text has the score of a text without features; without labelled rows, or with one label
only, every score is the share of label 1 (0 if unknown); a doc_id with several labels takes the largest; rows that repeat each give a row; no rows
give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import words
from panelyard.llm.lm import held_out

SAMPLE_ROWS, SAMPLE_BYTES = 4000, 8 << 20
#: Lengths in bytes of word beginnings.
BEGINNINGS = (4, 5, 6)
MOST_FEATURES, MOST_VOTERS, MOST_CLEAN, LEAST_DOCS, LEAST_ODDS, LEAST_SURE, VOTER_SURE = 1000, 200, 100, 3, 2.0, 5.0, 12.0
#: LABEL_START: what the label is taken for in the first round.
ROUNDS, EPOCHS, RATE, DECAY, LABEL_START = 30, 300, 0.3, 1e-4, 0.98
LETTERS = words.table((0x61, 0x7A), (0x80, 0xFF))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings of all texts, and for each the number of its text."""
    buf, offsets = words.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    s, e, first = words.spans(buf, offsets, LETTERS)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    hashed, docs = [words.hashes(buf, s, e)], [doc]
    for k in BEGINNINGS:
        fits = np.flatnonzero(e - s > k)
        hashed.append(words.hashes(buf, s[fits], s[fits] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        docs.append(doc[fits])
    return np.concatenate(hashed), np.concatenate(docs)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.bias)
        if len(self.features):
            hashed, doc = tokens(column)
            at = self.members.find(hashed)
            held = np.unique(doc[at] * len(self.features) + np.searchsorted(self.features, hashed[at]))
            total += np.bincount(held // len(self.features), self.weights[held % len(self.features)], len(column))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    def __post_init__(self):
        self.members = words.Members(self.features, 16)


def posteriors(votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each text by a latent class model over 0/1 ``votes``; the voters' rates (clean, toxic) and the weight that
    their correlations leave to each. ``start``: 0/1, which texts are first taken for toxic; only the first round knows it."""
    p = np.where(start == 1, LABEL_START, 1 - LABEL_START)
    weight = np.ones(votes.shape[1])
    for turn in range(rounds):
        share = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        rates = np.stack([(votes * (1 - p)[:, None]).sum(0) + 0.02, (votes * p[:, None]).sum(0) + 0.02]) / np.array([[(1 - p).sum() + 1], [p.sum() + 1]])
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        if turn % 10 == 1:  # what the classes don't explain
            rest = votes - (p[:, None] * rates[1] + (1 - p)[:, None] * rates[0])
            norm = np.sqrt((rest**2).sum(0)) + 1e-9
            weight = 1 / (((rest.T @ rest) / np.outer(norm, norm)) ** 2).sum(axis=1).clip(1, None)
        yes, no = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        p = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + (votes * yes + (1 - votes) * no) @ weight, -40, 40)))
    return p, rates, weight


def fit(samples: list[tuple[str | None, int]], report: dict | None = None) -> Model:
    """A classifier of (text, label) samples; ``report`` gets how many voters there are and how often the label model departs from the labels."""
    y = np.array([int(label) for _, label in samples])
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    hashed, doc = tokens(pa.array([t or "" for t, _ in samples], pa.large_string()))
    types, kind = np.unique(hashed, return_inverse=True)
    pairs = np.unique(doc * len(types) + kind)
    doc, kind = pairs // len(types), pairs % len(types)
    toxic, clean = np.bincount(kind, y[doc], len(types)), np.bincount(kind, 1 - y[doc], len(types))
    n_toxic, n_clean = y.sum(), (1 - y).sum()
    odds = np.log((toxic + 0.1) / (n_toxic + 0.2)) - np.log((clean + 0.1) / (n_clean + 0.2))
    # Signed deviance: how surely a feature goes with a label.
    rate = (toxic + clean) / len(y)
    sure = np.sign(odds) * (toxic * np.log(np.maximum(toxic, 1e-9) / np.maximum(n_toxic * rate, 1e-9)) + clean * np.log(np.maximum(clean, 1e-9) / np.maximum(n_clean * rate, 1e-9)))
    good = np.flatnonzero((toxic >= LEAST_DOCS) & (odds > LEAST_ODDS) & (sure > LEAST_SURE))
    chosen = np.sort(good[np.argsort(-sure[good], kind="stable")[:MOST_FEATURES]])
    able = good[sure[good] > VOTER_SURE]
    voters = able[np.argsort(-sure[able], kind="stable")[:MOST_VOTERS]]

    def table(some: np.ndarray) -> np.ndarray:
        place = np.full(len(types), -1)
        place[some] = np.arange(len(some))
        inside = place[kind] >= 0
        out = np.zeros((len(y), len(some)), np.float32)
        out[doc[inside], place[kind[inside]]] = 1
        return out

    against = np.flatnonzero((clean >= LEAST_DOCS) & (odds < 0) & (-sure > VOTER_SURE))
    against = against[np.argsort(-np.abs(sure[against]), kind="stable")[:MOST_CLEAN]]
    signs = table(voters)
    n_signs = signs.sum(axis=1)
    votes = np.column_stack([signs, table(against), n_signs == 0, n_signs > 1, n_signs > 3, y]).astype(np.float32)
    target, *_ = posteriors(votes, y)
    if report is not None:
        report |= {"texts": len(y), "voters": votes.shape[1], "turned_clean": int(((target < 0.5) & (y == 1)).sum()), "turned_toxic": int(((target >= 0.5) & (y == 0)).sum())}
    x = table(chosen)
    weights, bias = np.zeros(len(chosen), np.float32), 0.0
    squares, bias_square = np.full(len(chosen), 1e-8, np.float32), 1e-8
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -40, 40)))
        error = ((target - p) / len(y)).astype(np.float32)
        g = error @ x - DECAY * weights
        squares += g * g
        bias_square += error.sum() ** 2
        weights += RATE * g / np.sqrt(squares)
        bias += RATE * error.sum() / np.sqrt(bias_square)
    return Model(types[chosen], weights.astype(float), float(bias))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """Labelled (text, label) rows for fitting, bounded in number and bytes for each label."""
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    known = known.withColumn("key", F.xxhash64("doc_id"))
    count = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not count:
        return []
    share = F.lit(0.0)
    for label, n in count.items():
        share = F.when(F.col("label") == label, min(1.0, rows / n)).otherwise(share)
    million = F.lit(1_000_000)
    some = known.where(F.pmod("key", million) < share * million)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(some), "doc_id").select("key", "label", "text")  # bounded by rows for each label
    size = {r.label: r.size or 0 for r in joined.groupBy("label").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    fits = F.lit(False)
    for label, n in size.items():
        # The same hash again, finer: rows are drawn at the rate that the bytes allow.
        fits = F.when(F.col("label") == label, F.pmod(F.xxhash64("key"), million) < F.lit(min(1.0, (most if label else most // 2) / max(1, n))) * million).otherwise(fits)
    chosen = joined.where(fits).collect()
    return [(r.text, r.label) for r in sorted(chosen, key=lambda r: (r.key, r.text or ""))]


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) for each row, with the columns in ``keep``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                scores = own.scores(piece.column("text"))
                columns = [piece.column(f.name) for f in kept]
                yield pa.record_batch([*columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*(f.name for f in kept), "score", "predicted"])

    return rows.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))
    return words.filtered(docs, text_col, lambda column: Model(*shared.value).scores(column) < 0.5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores of every whole text of ``documents``, learned from ``labels``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    test = held_out(F.col("doc_id"), 5, 0)
    return classify(docs.withColumn("held_out", test), fit(sample(docs, labels, ~test)), keep=("held_out",))
