"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``2 * half`` bits have a word between them that is within ``half`` bits of both. So
every fingerprint emits its whole ball of radius ``half`` (2081 words for 2), and fingerprints that emit the same word
are exactly the pairs that link: none is missed, and a shared word proves the link by the triangle inequality (it is
verified all the same).

The ball isn't written out row by row. The words are dealt by a k-bit syndrome (parities of k groups of bits). Flipping
one or two bits changes none, one or two of the parities, so a ball of 2081 words lies in 1 + k + k(k-1)/2 buckets; a
fingerprint is sent once to each, and the bucket makes the part of the ball that belongs to it. k grows with the logarithm
of the number of distinct fingerprints, which holds a bucket's work steady. Within a bucket, fingerprints that share a
word are joined to a forest (never to all their pairs), so at most one link leaves per fingerprint and bucket. Connected
components of the links are found by alternating stars over tables in the shared folder.

Equal fingerprints are one from the start, so copies, however many, cost nothing.

Defined cases: a null or empty text has fingerprint zero, and such texts link to each other; rows that repeat count once
in groups and each gives a row; a row with a null doc_id takes part, but only names its component if no other can; no
rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import words as words_
from panelyard.session import discard, shared_path, stored

WORDS, SEED, HALF = 4, 42, 2
#: Words of a ball that a bucket holds at once.
AT_ONCE = 1 << 21
_STEP = 1 << 14
#: Parts of a node's neighbours.
SLOTS = 64


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """The fingerprint of one text; its shingles are held a bounded number at a time."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) >= n:
        starts, ends = starts[: len(found) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) for each row; fp's 64 bits are held in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((x.as_py() or "").encode(), words) for x in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        words_.give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(4)
def _flips(k: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """All words of up to ``half`` bits and their syndromes: bit i belongs to parity i mod k."""
    flips, syndromes = [np.uint64(0)], [0]
    level = [(0, 0, -1)]
    for _ in range(half):
        level = [(w | 1 << i, s ^ (1 << i % k), i) for w, s, last in level for i in range(last + 1, 64)]
        flips += [np.uint64(w) for w, _, _ in level]
        syndromes += [s for _, s, _ in level]
    return np.array(flips, dtype=np.uint64), np.array(syndromes, dtype=np.int64)


def _syndromes(fps: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.int64)
    for g in range(k):
        group = np.uint64(sum(1 << i for i in range(g, 64, k)))
        out |= (np.bitwise_count(fps & group).astype(np.int64) & 1) << g
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _meet(fps: np.ndarray, bucket: int, k: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger) that span what meets in a bucket. fps: sorted, distinct."""
    flips, syndromes = _flips(k, half)
    need = _syndromes(fps, k) ^ bucket
    order = np.argsort(need, kind="stable")
    kinds, first = np.unique(need[order], return_index=True)
    parts = [(np.sort(order[i:j]), flips[syndromes == s]) for s, i, j in zip(kinds, first, [*first[1:], len(order)])]
    rounds = max(1, math.ceil(sum(len(i) * len(e) for i, e in parts) / AT_ONCE))
    links_a, links_b = [], []
    for turn in range(rounds):  # each makes the words whose hash falls to it
        words, owners = [], []
        for index, part in parts:
            step = max(1, AT_ONCE // max(1, len(part)))
            for at in range(0, len(index), step):
                some = index[at : at + step]
                w = (fps[some][:, None] ^ part[None, :]).ravel()
                o = np.repeat(some.astype(np.int32), len(part))
                if rounds > 1:
                    mine = ((w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(rounds) == turn
                    w, o = w[mine], o[mine]
                words.append(w)
                owners.append(o)
        w, o = np.concatenate(words), np.concatenate(owners)
        seen = np.sort(w)
        twice = seen[1:][seen[1:] == seen[:-1]]
        if not len(twice):
            continue
        place = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
        flags = np.zeros(1 << 22, dtype=bool)
        flags[place(twice)] = True
        near = flags[place(w)]
        w, o = w[near], o[near]
        by = np.lexsort((o, w))
        w, o = w[by], o[by]
        start = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        head = np.repeat(o[start], np.diff(np.append(start, len(w))))
        pair = np.unique(head[head != o].astype(np.int64) * len(fps) + o[head != o])
        links_a.append(pair // len(fps))
        links_b.append(pair % len(fps))
    if not links_a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    true = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * half
    root = _roots(len(fps), a[true], b[true])
    member = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[member]], fps[member]


def links(fps: DataFrame, n: int, half: int = HALF) -> DataFrame:
    """Links (a, b) over the distinct fingerprints in column fp whose components are those of all pairs within 2 * half bits."""
    k = min(24, max(4, math.ceil(math.log2(max(n, 1) / 1000 + 1))))
    reached = np.unique(_flips(k, half)[1])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                to = _syndromes(x.view(np.uint64), k)[:, None] ^ reached[None, :]
                yield pa.record_batch([pa.array(to.ravel().astype(np.int32)), pa.array(np.repeat(x, len(reached)))], names=["bucket", "fp"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        x = np.unique(table.column("fp").to_numpy().view(np.uint64))
        a, b = _meet(x, key[0].as_py(), k, half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInArrow(send, "bucket int, fp long").groupBy("bucket").applyInArrow(meet, "a long, b long")


def _with_least(rows: DataFrame, u: str, v: str) -> DataFrame:
    """``rows`` with m, the smallest ``v`` of their ``u``. A u with very many rows is dealt into ``SLOTS`` parts by v: each part has its smallest, these
    are compared, and the result goes back to the parts, so no task gets more than a part."""
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64(v), F.lit(SLOTS)))
    parts = dealt.groupBy(u, "slot").agg(F.min(v).alias("m"))
    least = parts.groupBy(u).agg(F.min("m").alias("m"))
    return dealt.join(parts.select(u, "slot").join(least, u), [u, "slot"]).drop("slot")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b) that isn't its component's smallest, by large and small stars.

    Stars only ever ask for a node's smallest neighbour. Each round's table replaces that of the round before.
    """
    spark = edges.sparkSession
    at = shared_path(spark, "links")
    edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(at)
    before = None
    while True:
        state = spark.read.schema("u long, v long").parquet(at)
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == before or not mark[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, last, at = mark, at, shared_path(spark, "links")
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large, "u", "v")
        joined = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.where("v = m").select("u", "v"))
        joined.distinct().write.parquet(at)
        discard(spark, last)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, half: int = HALF) -> DataFrame:
    """(doc_id, fp, component_id, leads) for each row; of each group, rows of the smallest doc_id with its smallest fingerprint lead."""
    each = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, distinct.count(), half))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lead = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "fp"))).alias("lead")
    named = placed.join(placed.groupBy("root").agg(lead), "root").select("fp", F.col("lead.first").alias("component_id"), (F.col("lead.fp") == F.col("fp")).alias("own"))
    return each.join(named, "fp").select("doc_id", "fp", "component_id", (F.col("own") & (F.col("doc_id") == F.col("component_id"))).alias("leads"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, half: int = HALF) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id that links reach."""
    return _grouped(docs, id_col, text_col, words, half).drop("leads")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id, of several texts with that id the one with the
    smallest fingerprint, then digest. Rows without doc_id stay."""
    found = _grouped(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("leads"), F.col("fp"))).alias("fps"))
    kept = stored(found.where("size(fps) > 0").withColumnRenamed("doc_id", id_col), "kept")
    # The ids grow with the documents, so the join is a shuffle at every size; their hash tables are small, texts aren't sorted.
    rows = docs.join(kept.where("n = 1").hint("shuffle_hash"), id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    if kept.where("n > 1").isEmpty():
        return rows
    # Rows that share an id are told apart by their texts: one text stays for each group that the id leads.
    shared = kept.where("n > 1").select(id_col, "fps")
    digest = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    texts = docs.join(shared.hint("shuffle_hash"), id_col, "left_semi").select(F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("key"), F.col(text_col).alias("text"))
    prints = fingerprints(texts.dropDuplicates(["key"]), "key", "text").select("doc_id.id", "doc_id.digest", "fp")
    chosen = prints.join(shared.select(F.col(id_col).alias("id"), F.explode("fps").alias("fp")), ["id", "fp"]).groupBy("id", "fp").agg(F.min("digest").alias("digest"))
    wanted = stored(chosen.select("id", "digest"), "chosen")
    own = F.struct(docs[id_col].alias("id"), digest.alias("digest"))
    one = docs.join(wanted.hint("shuffle_hash"), (docs[id_col] == wanted["id"]) & (digest == wanted["digest"]), "left_semi")
    return rows.unionByName(one.withColumn("_key", own).dropDuplicates(["_key"]).select(*docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's groups over ``documents``: 4-word shingles, links at 4 or fewer differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
