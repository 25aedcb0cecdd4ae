"""Benchmark decontamination by winnowing.

Of every run of ``window`` words the smallest hash of its ``k``-word grams is kept. Two equal runs keep the same one, so
every shared run of ``window`` words meets in the join of training and test fingerprints; nothing long enough is
missed. A meeting is then extended: the whole runs of words around it are compared as text, and hit words are those
inside a run that is really equal. Items shorter than a window are matched by grams of their own length.

The benchmark goes to the tasks in blocks of at most ``most_bytes``: one block (the size is summed
beforehand) is the usual case and costs one pass over the documents without a shuffle. A larger benchmark is dealt into
several blocks, a pass each, and the runs that were hit are united per document.

Defined cases: a null or empty text has no words and no hits; an item without words matches nothing; an item_id that
repeats counts once; hits of a null item_id count as hits, but it isn't listed; rows that repeat each give a row; empty
tables on either side are fine; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import words

WINDOW, GRAM = 13, 8
MOST_BYTES = 16 << 20
SHARE = 20


def fingerprint_runs(h: np.ndarray, window: int = WINDOW, k: int = GRAM) -> np.ndarray:
    """Element i: the smallest k-gram hash in the run of ``window`` words that starts at i."""
    if len(h) < window:
        return h[:0]
    g = words.grams(h, k)
    m = len(h) - window + 1
    low = g[:m].copy()
    for j in range(1, window - k + 1):
        np.minimum(low, g[j : j + m], out=low)
    return low


class Runs:
    """All runs of ``n`` words of a benchmark: sorted hashes, and of each distinct run a place where it stands and the items that hold it."""

    def __init__(self, h: np.ndarray, item: np.ndarray, starts: np.ndarray, n: int, same):
        """h: word hashes of all items; ``starts``: words at which a run begins; ``same(a, b)``: whether the runs at two words are equal as text."""
        self.n = n
        keys = words.grams(h, n)[starts]
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], starts[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.flatnonzero(new)
        # Two texts under one hash would be one chance in 2 ** 64 a pair; they are told apart all the same.
        for i in np.flatnonzero(~new).tolist():
            if not same(int(at[i - 1]), int(at[i]), n):
                raise ValueError("two runs of the benchmark share a hash")
        self.keys, self.place = keys[head], at[head]
        pairs = np.unique((np.cumsum(new) - 1).astype(np.int64) << 32 | item[at])
        self.items, self.first = (pairs & 0xFFFFFFFF).astype(np.int32), np.searchsorted(pairs >> 32, np.arange(len(head) + 1))

    def find(self, x: np.ndarray) -> np.ndarray:
        """The number of the run with each hash; -1 without one."""
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return np.where(self.keys[at] == x, at, -1)


class Benchmark:
    """A block of the benchmark: fingerprints for the join, and the exact runs with the items that hold them. All items are
    hashed in one pass; of their text only the words are kept, one after the other, for exact comparison."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, k: int = GRAM):
        self.window, self.k = window, k
        self.names = [item for item, _ in items]
        parts = list(words.pieces(pa.record_batch([pa.array([t for _, t in items], pa.large_string())], names=["text"]), "text"))
        hashed, sizes, text, ends = [], [], [], []
        for part in parts:
            buf, offsets = words.utf8(part.column("text"))
            s, e, first = words.spans(buf, offsets, words.ALNUM)
            hashed.append(words.hashes(buf, s, e))
            sizes.append(np.diff(first))
            text.append(b" ".join([buf[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist())]))
            ends.append(np.cumsum(e - s + 1))
        h = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.text = b"".join([t + b" " for t in text if t])
        shift = np.cumsum([0] + [int(x[-1]) if len(x) else 0 for x in ends])
        self.ends = np.concatenate([x + d for x, d in zip(ends, shift)] or [np.zeros(0, np.int64)])  # of each word, with the space after it
        item = np.repeat(np.arange(len(size)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(item))  # words from here to the item's end
        self.runs: dict[int, Runs] = {}
        self.members: dict[int, words.Members] = {}
        for n in np.unique(np.minimum(size[size > 0], window)).tolist():
            starts = np.flatnonzero((np.minimum(size, window)[item] == n) & (left >= n))
            prints = fingerprint_runs(h, window, k) if n == window else words.grams(h, n)
            self.members[n] = words.Members(prints[starts])
            self.runs[n] = Runs(h, item, starts, n, lambda a, b, n: self.run(a, n) == self.run(b, n))

    def run(self, at: int, n: int) -> bytes:
        """The text of the run of ``n`` words that begins at a word."""
        return self.text[self.ends[at - 1] if at else 0 : self.ends[at + n - 1] - 1]

    def match(self, column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """Words of each text; for texts with hits, the runs [from, to) of hit words and the items."""
        buf, offsets = words.utf8(column)
        s, e, first = words.spans(buf, offsets, words.ALNUM)
        h = words.hashes(buf, s, e)
        hits: dict[int, tuple[list, set]] = {}
        of = np.repeat(np.arange(len(column)), np.diff(first)) if self.members else None
        for n, members in self.members.items():
            prints = fingerprint_runs(h, self.window, self.k) if n == self.window else words.grams(h, n)
            at = members.find(prints)
            at = at[of[at] == of[at + n - 1]]  # within one text
            if len(at):
                self._extend(n, at, of, h, buf, s, e, first, hits)
        return np.diff(first), hits

    def _extend(self, n: int, at: np.ndarray, of: np.ndarray, h, buf, s, e, first, hits) -> None:
        """Compares the runs at the meetings with those of the benchmark: by the hash of the whole run, then as text."""
        runs = self.runs[n]
        which = runs.find(words.grams_at(h, at, n))
        for i, r in zip(at[which >= 0].tolist(), which[which >= 0].tolist()):
            if b" ".join([buf[a:b].tobytes() for a, b in zip(s[i : i + n].tolist(), e[i : i + n].tolist())]) != self.run(int(runs.place[r]), n):
                continue
            doc = int(of[i])
            spans_, all_items = hits.setdefault(doc, ([], set()))
            a = i - int(first[doc])
            if spans_ and spans_[-1][1] >= a >= spans_[-1][0]:
                spans_[-1][1] = max(spans_[-1][1], a + n)
            else:
                spans_.append([a, a + n])
            all_items.update(name for x in runs.items[runs.first[r] : runs.first[r + 1]].tolist() if (name := self.names[x]) is not None)


_held: dict[str, Benchmark] = {}


def _benchmark(name: str, items: list[tuple], window: int, k: int) -> Benchmark:
    """The index of a block, built once in a worker; ``name`` is the block's own."""
    if name not in _held:
        _held.clear()
        _held[name] = Benchmark(items, window, k)
    return _held[name]


def _matched(docs: DataFrame, block: list[tuple], window: int, k: int) -> DataFrame:
    """doc_id, digest of the text, n_words, runs, items for each row of (doc_id, text)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _benchmark(name, shared.value, window, k)
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                n, hits = own.match(piece.column("text"))
                runs = [hits[i][0] if i in hits else [] for i in range(piece.num_rows)]
                items = [sorted(hits[i][1]) if i in hits else [] for i in range(piece.num_rows)]
                yield pa.record_batch(
                    [piece.column("doc_id"), piece.column("digest"), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "digest", "n_words", "runs", "items"],
                )

    return docs.mapInArrow(run, f"doc_id {id_type}, digest string, n_words long, runs array<array<bigint>>, items array<string>")


def _united(runs: Column) -> Column:
    """Words in the union of sorted or unsorted runs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to"))
    step = lambda acc, r: F.struct((acc.n + F.greatest(r[1] - F.greatest(r[0], acc.to), F.lit(0).cast("long"))).alias("n"), F.greatest(acc.to, r[1]).alias("to"))
    return F.aggregate(F.sort_array(runs), start, step, lambda acc: acc.n)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, math.ceil(size / most_bytes))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, k: int = GRAM, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of ``docs``; items are sorted as strings."""
    items, blocks = _blocks(benchmark, item_col, item_text_col, most_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if blocks == 1:
        found = _matched(rows.withColumn("digest", F.lit(None).cast("string")), [tuple(r) for r in items.collect()], window, k)
    else:
        rows = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
        parts = [_matched(rows, [tuple(r) for r in dealt.where(F.col("block") == b).select("item", "text").collect()], window, k) for b in range(blocks)]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        found = union.groupBy("doc_id", "digest").agg(
            F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count("*").alias("n"),
        )
        found = found.withColumn("one", F.explode(F.sequence(F.lit(1), (F.col("n") / blocks).cast("int")))).drop("one", "n")
    return found.select("doc_id", "n_words", F.coalesce(_united(F.col("runs")), F.lit(0)).cast("long").alias("n_hit"), "items")


def is_contaminated(n_hit: Column, n_words: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = GRAM, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` without contaminated rows: in place against one block; by the digests of their texts against several, which need runs united first."""
    items, blocks = _blocks(benchmark, "item_id", "text", most_bytes)
    if blocks > 1:
        digest = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
        found = contamination(docs.select(digest.alias("digest"), docs[text_col].alias("text")), benchmark, "digest", "text", window=window, k=k, most_bytes=most_bytes)
        bad = found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("bad")).distinct()
        return docs.join(bad, digest == bad["bad"], "left_anti")
    shared, name = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex

    def clean(column: pa.Array) -> np.ndarray:
        n, hits = _benchmark(name, shared.value, window, k).match(column)
        keep = np.ones(len(column), dtype=bool)
        for i, (runs, _) in hits.items():
            hit = np.zeros(n[i], dtype=bool)
            for a, b in runs:
                hit[a:b] = True
            keep[i] = SHARE * hit.sum() < n[i]
        return keep

    return words.filtered(docs, text_col, clean)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's hits of every item of ``benchmark`` in every text of ``documents``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP5_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item, least(13, len(w)) n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') g from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
h as (select doc_id, i, dw.n, item from dw join bw using (n, g)),
p as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from (select distinct doc_id, i, n from h)) group by doc_id),
s as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join p on d.doc_id = p.doc_id left join s on d.doc_id = s.doc_id
"""
