"""Language ID by a linear-chain conditional random field over words.

Features of a word are its whole form (the lexicon), its first and last 1 to 4 bytes and its 2- and 3-byte grams, hashed
into one weight table; transitions between the languages of neighbouring words are learned with them. Training maximizes
the conditional likelihood with AdaGrad on sequences that join passages of different languages, since a document's label
alone would never show a switch. Forward-backward gives each word its posterior over languages; a text's label is the
language with the largest expected share of words, its score that share.

The model is fitted on the driver, on at most ``SAMPLE_ROWS`` labelled texts and ``SAMPLE_BYTES`` of text per language,
chosen by a hash of doc_id. Scoring is one pass without a shuffle; words are looked up once per piece of text, and
segments of a text run side by side: transfer matrices of whole segments first, then exact messages within them.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing is labelled;
ties go to the language that sorts first; very long texts are labelled whole; rows that repeat each give a row; no rows
give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import words
from panelyard.llm.lm import held_out

UNKNOWN = "und"
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 2 << 20
BUCKETS, AFFIX, SEGMENT, PIECE = 1 << 19, 4, 256, 1 << 20
EPOCHS, RATE, DECAY, BATCH_WORDS = 3, 0.2, 1e-6, 30_000
#: A text has no language if the likeliest one's share of its words is less than so many times an even split (and less than a half).
STAND_OUT = 1.2
#: Letters by byte: ASCII letters and all bytes of longer characters; whether a text has a letter is asked of its characters.
LETTERS = words.table((0x61, 0x7A), (0x80, 0xFF))
_LETTER = regex.compile(r"\p{L}")


def _place(x: np.ndarray, salt: int) -> np.ndarray:
    """Row of the weight table; row 0 stays zero."""
    return 1 + ((words.mix(x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(20)) % np.uint64(BUCKETS - 1)).astype(np.int32)


def affixes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Rows of the whole word, its prefixes and its suffixes; 0 where a word is too short."""
    out = np.zeros((len(s), 1 + 2 * AFFIX), dtype=np.int32)
    out[:, 0] = _place(whole, 1)
    size = e - s
    head, tail = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
    for k in range(1, AFFIX + 1):
        fits = size >= k
        head = head * np.uint64(257) + buf[np.where(fits, s + k - 1, s)] + np.uint64(1)
        tail = tail * np.uint64(257) + buf[np.where(fits, e - k, s)] + np.uint64(1)
        out[fits, k] = _place(head[fits], 10 + k)
        out[fits, AFFIX + k] = _place(tail[fits], 20 + k)
    return out


def grams(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the 2- and 3-byte grams of all words, and where each word's begin (and the last ends)."""
    size = e - s
    first = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(first[-1]) + np.repeat(s - first[:-1], size)
    left = np.repeat(e, size) - at
    b0 = buf[at].astype(np.uint64) + np.uint64(1)
    b1 = np.where(left > 1, buf[np.minimum(at + 1, len(buf) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    b2 = np.where(left > 2, buf[np.minimum(at + 2, len(buf) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    two = b0 * np.uint64(512) + b1
    rows = np.empty(2 * len(at), np.int32)
    rows[0::2], rows[1::2] = _place(two, 31), _place(two * np.uint64(512) + b2, 32)
    return rows, 2 * first


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    moves: np.ndarray  # log weights of transitions
    start: np.ndarray

    def emissions(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, whole: np.ndarray) -> np.ndarray:
        out = np.zeros((len(s), len(self.labels)), np.float32)
        if not len(s):
            return out
        a = affixes(buf, s, e, whole)
        for j in range(a.shape[1]):
            out += self.weights[a[:, j]]
        rows, first = grams(buf, s, e)
        return out + np.add.reduceat(self.weights[rows], first[:-1], axis=0) / np.sqrt(np.diff(first))[:, None].astype(np.float32)


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of all words of sequences that begin at ``first[:-1]``; also forward messages, and backward ones with
    and without the word's own score, each up to a factor per word."""
    n_labels = scores.shape[1]
    own = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -60, 0).astype(np.float64))
    step, begin = np.exp(moves - moves.max()), np.exp(start - start.max())
    sizes = np.diff(first)
    parts = -(-sizes // segment)  # segments of each sequence
    seq = np.repeat(np.arange(len(sizes)), parts)
    rank = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = first[:-1][seq] + rank * segment
    length = np.minimum(segment, first[1:][seq] - at)
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(1, segment + 1), side="right")  # segments that have a word t
    at_, opens = at[order], (rank == 0)[order]
    eye = np.eye(n_labels)
    # Transfer matrices are needed only where a sequence has several segments.
    several = (parts > 1)[seq][order]
    entry = np.tile(begin, (len(seq), 1))
    leave = np.ones((len(seq), n_labels))
    if several.any():
        index = np.flatnonzero(several)
        m = np.where(opens[index][:, None, None], eye, step) * own[at_[index]][:, None, :]
        for t in range(1, segment):
            n = np.searchsorted(index, live[t])
            if not n:
                break
            x = (m[:n].reshape(-1, n_labels) @ step).reshape(n, n_labels, n_labels) * own[at_[index[:n]] + t][:, None, :]
            m[:n] = x / x.max(axis=(1, 2), keepdims=True)
        where = np.full(len(seq), -1)
        where[order[index]] = np.arange(len(index))
        by_rank = lambda r: np.flatnonzero((rank == r) & (where >= 0))
        entry_, leave_ = np.tile(begin, (len(seq), 1)), np.ones((len(seq), n_labels))
        for r in range(1, int(rank.max()) + 1):
            i = by_rank(r)
            x = np.einsum("ni,nij->nj", entry_[i - 1], m[where[i - 1]])
            entry_[i] = x / x.sum(axis=1, keepdims=True)
        for r in range(int(rank.max()), 0, -1):
            i = by_rank(r)
            x = np.einsum("nij,nj->ni", m[where[i]], leave_[i])
            leave_[i - 1] = x / x.sum(axis=1, keepdims=True)
        entry, leave = entry_[order], leave_[order]
    ahead, back, after = np.empty_like(own), np.empty_like(own), np.empty_like(own)
    a = np.where(opens[:, None], entry, entry @ step) * own[at_]
    a /= a.sum(axis=1, keepdims=True)
    ahead[at_] = a
    for t in range(1, segment):
        n = live[t]
        if not n:
            break
        a = (a[:n] @ step) * own[at_[:n] + t]
        a /= a.sum(axis=1, keepdims=True)
        ahead[at_[:n] + t] = a
    b = leave.copy()
    end = length[order] - 1
    after[at_ + end] = b
    for t in range(segment - 1, 0, -1):
        n = live[t]
        if not n:
            continue
        pos = at_[:n] + t
        x = (own[pos] * after[pos]) @ step.T
        after[pos - 1] = x / x.sum(axis=1, keepdims=True)
    back = own * after
    posterior = ahead * after
    posterior /= posterior.sum(axis=1, keepdims=True)
    return posterior, ahead, back, after


def fit(samples: list[tuple[str, str]], seed: int = 0) -> Model | None:
    """A model of (text, language) samples."""
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    index = {x: i for i, x in enumerate(labels)}
    buf, offsets = words.utf8(pc.utf8_lower(pa.array([t for t, _ in samples], pa.large_string())))
    s, e, first = words.spans(buf, offsets, LETTERS)
    whole = words.hashes(buf, s, e)
    _, one, of = np.unique(whole, return_index=True, return_inverse=True)
    fixed = affixes(buf, s[one], e[one], whole[one])
    rows, begin = grams(buf, s[one], e[one])
    # Passages of 8 to 64 words, shuffled, three or so to a sequence: neighbours mostly differ in language.
    passages = []
    for doc, (_, lang) in enumerate(samples):
        at = int(first[doc])
        while at < first[doc + 1]:
            to = min(at + int(rng.integers(8, 65)), int(first[doc + 1]))
            passages.append((at, to, index[lang]))
            at = to
    model = Model(labels, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
    squares = np.full_like(model.weights, 1e-3)
    move_squares = np.full_like(model.moves, 1e-3)
    n_labels = len(labels)
    for _ in range(EPOCHS):
        rng.shuffle(passages)
        at = 0
        while at < len(passages):
            some, total = [], 0
            while at < len(passages) and total < BATCH_WORDS:
                some.append(passages[at])
                total += passages[at][1] - passages[at][0]
                at += 1
            take = np.concatenate([np.arange(a, b) for a, b, _ in some])
            truth = np.repeat([y for _, _, y in some], [b - a for a, b, _ in some])
            ends = np.cumsum([b - a for a, b, _ in some])
            sequences = np.unique(np.concatenate(([0], ends[2::3], ends[-1:])))
            used, local = np.unique(of[take], return_inverse=True)
            counts = begin[used + 1] - begin[used]
            grams_at = np.concatenate(([0], np.cumsum(counts)))
            gram_rows = rows[np.arange(grams_at[-1]) + np.repeat(begin[used] - grams_at[:-1], counts)]
            scale = (1 / np.sqrt(counts)).astype(np.float32)
            emission = model.weights[fixed[used]].sum(axis=1) + np.add.reduceat(model.weights[gram_rows], grams_at[:-1], axis=0) * scale[:, None]
            posterior, ahead, back, _ = forward_backward(emission[local], sequences, model.moves, model.start)
            error = -posterior
            error[np.arange(len(take)), truth] += 1
            per_word = np.stack([np.bincount(local, error[:, y], len(used)) for y in range(n_labels)], axis=1)
            touched = np.concatenate([fixed[used].ravel(), gram_rows])
            for y in range(n_labels):
                spread = np.concatenate([np.repeat(per_word[:, y], fixed.shape[1]), np.repeat(per_word[:, y] * scale, counts)])
                gradient = np.bincount(touched, spread, BUCKETS).astype(np.float32)
                gradient[0] = 0
                moved = np.flatnonzero(gradient)
                g = gradient[moved] / 100 - DECAY * model.weights[moved, y]
                squares[moved, y] += g * g
                model.weights[moved, y] += RATE * g / np.sqrt(squares[moved, y])
            inner = np.ones(len(take), bool)
            inner[sequences[:-1]] = False
            later = np.flatnonzero(inner)
            step = np.exp(model.moves - model.moves.max())
            u, v = ahead[later - 1], back[later]
            z = ((u @ step) * v).sum(axis=1, keepdims=True)
            expected = step * ((u / z).T @ v)
            seen = np.bincount(truth[later - 1] * n_labels + truth[later], minlength=n_labels**2).reshape(n_labels, n_labels)
            g = (seen - expected) / max(1, len(later)) * 100 - 1e-3 * model.moves
            move_squares += g * g
            model.moves += RATE * g / np.sqrt(move_squares)
    return model


def sample(docs: DataFrame, label: Column, by: list[Column], rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list:
    """Rows of (text, label) for fitting: per label at most about ``rows`` rows and ``most`` bytes, by a hash of doc_id."""
    known = docs.select(F.xxhash64(*by).alias("key"), F.col("text"), label.alias("label")).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    if not sizes:
        return []
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("label") == r.label, min(1.0, rows / r.n, most / max(1, r.size))).otherwise(share)
    million = F.lit(1_000_000)
    chosen = known.where(F.pmod("key", million) < share * million).collect()
    return [(r.text, r.label) for r in sorted(chosen, key=lambda r: (r.key, r.text))]


def label(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) for each row, with the columns in ``keep``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = shared.value
        for batch in batches:
            for piece in words.pieces(batch, "text", PIECE):
                langs, scores = _label(own, piece.column("text"))
                columns = [piece.column(f.name) for f in kept]
                yield pa.record_batch([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in kept), "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def _label(model: Model | None, column: pa.Array) -> tuple[list[str], list[float]]:
    if model is None:
        return [UNKNOWN] * len(column), [0.0] * len(column)
    buf, offsets = words.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    s, e, first = words.spans(buf, offsets, LETTERS)
    langs, scores = [UNKNOWN] * len(column), [0.0] * len(column)
    if not len(s):
        return langs, scores
    whole = words.hashes(buf, s, e)
    _, one, of = np.unique(whole, return_index=True, return_inverse=True)
    emission = model.emissions(buf, s[one], e[one], whole[one])[of]
    has = np.flatnonzero(np.diff(first))
    posterior, *_ = forward_backward(emission, np.append(first[has], first[-1]), model.moves, model.start)
    share = np.add.reduceat(posterior, first[has], axis=0) / np.diff(first)[has][:, None]
    ascii_letter = np.concatenate(([0], np.cumsum(words.table((0x61, 0x7A))[buf], dtype=np.int64)))
    sure = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for row, i in enumerate(has.tolist()):
        if sure[i] or _LETTER.search(column[i].as_py()):
            best = int(share[row].argmax())
            langs[i], scores[i] = model.labels[best], float(min(1.0, share[row, best]))
    return langs, scores


def accepted(model: Model | None, column: pa.Array, stand_out: float = STAND_OUT) -> np.ndarray:
    """Which texts have a language: one that isn't ``und`` and whose expected share of the words stands out. Without a model, all that have a letter."""
    if model is None:
        return np.array([bool(x and _LETTER.search(x)) for x in column.to_pylist()], dtype=bool)
    langs, scores = _label(model, column)
    return (np.array(langs, dtype=object) != UNKNOWN) & (np.array(scores) >= min(0.5, stand_out / len(model.labels)))


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", stand_out: float = STAND_OUT) -> DataFrame:
    """``docs`` without the rows that ``accepted`` rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return words.filtered(docs, text_col, lambda column: accepted(shared.value, column, stand_out))


def train(docs: DataFrame, learn: Column) -> Model | None:
    return fit(sample(docs.where(learn), F.col("lang"), [F.col("doc_id")]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's labels of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    test = held_out(F.col("doc_id"), 3, 1)
    return label(docs.withColumn("held_out", test), train(docs, ~test), keep=("held_out",))
