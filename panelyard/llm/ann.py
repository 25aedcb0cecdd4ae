"""Nearest neighbours by multiprobe p-stable hashing.

Largest inner products become nearest points by one more coordinate: rows are divided by the largest norm and
completed to the unit sphere, queries are scaled to it. A table has k Gaussian projections, each cut into ``CUTS``
intervals at a random offset; a bucket is one interval of each. Given a query, the chance that a point at the target
distance lies in a bucket is a product of normal probabilities. Buckets are visited in the order of this chance until
the visited ones hold ``mass`` of all chance over occupied buckets (and enough rows); candidates of all tables are merged and
reranked by the exact measure in double precision. There is no cap on candidates: a visited bucket is scanned whole.

Projections are scaled, and the target distance is taken, on a bounded sample of ``SAMPLE`` rows; every row is indexed. The
directory of buckets has ``CUTS ** k`` entries a table, ``CUTS ** MOST_K`` at most, so it can be broadcast. Buckets are
packed into shards of bounded rows, and a bucket with more rows than that is split into several shards, which a query then visits all.
Rows go to their shard once; a shard is copied only for each further ``QUERY_ROWS`` queries that visit it, so what is moved follows the visits.
Rows with equal vectors are one entry that keeps the ``top + 1`` smallest ids: no others can be among the nearest.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id;
vectors meet only those of their own length; ties go to the smaller id; rows that repeat count once; fewer candidates than ``top`` are all
returned; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm import words
from panelyard.session import stored

TOP, TABLES, MASS, CUTS, WIDTH, MOST_K = 20, 2, 0.95, 4, 0.8, 8
SAMPLE, BUCKET_ROWS, SHARD_ROWS, QUERY_ROWS = 2048, 16, 32_768, 16_384


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


@dataclass
class Index:
    """Hash functions of one vector length."""

    largest: float  # norm
    target: float  # distance of the nearest
    directions: np.ndarray  # (tables, k, dimension + 1)
    centre: np.ndarray  # (tables, k)
    spread: np.ndarray
    offset: np.ndarray
    codes: np.ndarray  # (buckets, k): intervals of each bucket

    @staticmethod
    def fit(sample: np.ndarray, largest: float, n: int, tables: int = TABLES, seed: int = 1) -> Index:
        rng = np.random.default_rng(seed)
        k = min(MOST_K, max(1, round(math.log(max(n, 2) / BUCKET_ROWS, CUTS))))
        directions = rng.normal(size=(tables, k, sample.shape[1] + 1))
        index = Index(largest, 1.0, directions, np.zeros((tables, k)), np.ones((tables, k)), rng.uniform(-0.5, 0.5, size=(tables, k)), np.stack(np.unravel_index(np.arange(CUTS**k), (CUTS,) * k), axis=1))
        points = index.lift(sample)
        projected = np.einsum("tkd,nd->tkn", directions, points)
        index.centre, index.spread = projected.mean(axis=2), projected.std(axis=2) + 1e-9
        picked = np.arange(0, len(sample), max(1, len(sample) // 256))
        some = index.aim(sample[picked])
        squared = np.maximum(0, (some**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * some @ points.T)
        squared[np.arange(len(picked)), picked] = np.inf  # itself
        away = np.sort(squared, axis=1)[:, min(len(points) - 1, int(len(points) * min(1.0, TOP / n)))]
        away = away[np.isfinite(away)]
        if len(away):  # what suffices for three queries of four; the others' lie in the tail of the chances
            index.target = float(np.sqrt(np.quantile(away, 0.75)))
        return index

    def lift(self, x: np.ndarray) -> np.ndarray:
        y = x / self.largest
        return np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))])

    @staticmethod
    def aim(q: np.ndarray) -> np.ndarray:
        return np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])

    def place(self, points: np.ndarray, table: int) -> np.ndarray:
        """Where the projections of points stand, in intervals."""
        f = (points @ self.directions[table].T - self.centre[table]) / self.spread[table]
        return f / WIDTH + self.offset[table] + CUTS / 2

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        cell = np.clip(np.floor(self.place(self.lift(x), table)), 0, CUTS - 1).astype(np.int64)
        return np.ravel_multi_index(cell.T, (CUTS,) * cell.shape[1])

    def probes(self, q: np.ndarray, table: int, rows: np.ndarray, mass: float, least: int) -> list[np.ndarray]:
        """For each query the occupied buckets to visit; rows: the number of rows of each bucket."""
        at = self.place(self.aim(q), table)
        unit = WIDTH * self.spread[table] / max(self.target, 1e-3)
        edges = np.concatenate(([-np.inf], np.arange(1, CUTS), [np.inf]))
        below = _phi((edges[None, None, :] - at[:, :, None]) * unit[None, :, None])
        chance = np.log(np.maximum(np.diff(below, axis=2), 1e-12))  # (queries, k, CUTS)
        occupied = np.flatnonzero(rows)
        total = sum(chance[:, j, self.codes[occupied, j]] for j in range(self.codes.shape[1]))
        order = np.argsort(-total, axis=1, kind="stable")
        p = np.exp(np.take_along_axis(total, order, axis=1))
        enough = (np.cumsum(p, axis=1) >= mass * p.sum(axis=1, keepdims=True)) & (np.cumsum(rows[occupied][order], axis=1) >= least)
        stop = np.where(enough.any(axis=1), enough.argmax(axis=1), len(occupied) - 1)
        return [occupied[order[i, : stop[i] + 1]] for i in range(len(q))]


def _matrix(column: pa.Array, dtype: str, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, dimension).astype(np.float64)


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as bytes, dimension, norm) of the rows that take part."""
    dtype = "<f4" if rows.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            out: list = []
            for d in np.unique(sizes[sizes > 0]):
                some = np.flatnonzero((sizes == d) & ids.is_valid().to_numpy(zero_copy_only=False))
                taken = vectors.take(pa.array(some))
                x = taken.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(x).all(axis=1) & (norm > 0)
                raw = x[good].astype(dtype)
                out.append((ids.take(pa.array(some[good])), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(np.full(len(raw), d, np.int32)), pa.array(norm[good])))
            for columns in out:
                yield pa.record_batch(list(columns), names=["vec_id", "vector", "dimension", "norm"])

    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return given.mapInArrow(run, "vec_id long, vector binary, dimension int, norm double")


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, tables: int = TABLES, mass: float = MASS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``top`` rows with the largest inner products that were found."""
    spark = rows.sparkSession
    dtype = "<f4" if rows.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    given = stored(valid(rows, id_col, vector_col), "vectors")
    parts = []
    for d, n, largest in given.groupBy("dimension").agg(F.count("*"), F.max("norm")).orderBy("dimension").collect():
        own = given.where(F.col("dimension") == d)
        key = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
        sample = own.where(key < min(1.0, 2 * SAMPLE / n) * (1 << 30)).select("vector").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
        if not sample:
            sample = own.select("vector").limit(SAMPLE).collect()
        index = Index.fit(np.stack([np.frombuffer(r.vector, dtype).astype(np.float64) for r in sample]), largest, n, tables)
        parts.append(_search(own, own.where(is_query), index, d, dtype, top, mass))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(own: DataFrame, queries: DataFrame, index: Index, d: int, dtype: str, top: int, mass: float) -> DataFrame:
    spark = own.sparkSession
    n_tables, n_buckets = len(index.directions), len(index.codes)
    held = spark.sparkContext.broadcast(index)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each table and distinct vector of a batch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), dtype, d)
            _, first, of = np.unique(np.ascontiguousarray(x).view(f"V{8 * d}").ravel(), return_index=True, return_inverse=True)
            ids = batch.column("vec_id").to_numpy()
            order = np.lexsort((ids, of))
            ends = np.searchsorted(of[order], np.arange(len(first) + 1))
            few = [np.unique(ids[order[a:b]])[: top + 1] for a, b in zip(ends[:-1], ends[1:])]
            vectors, lists = batch.column("vector").take(pa.array(first)), pa.array(few, pa.list_(pa.int64()))
            for t in range(n_tables):
                cell = held.value.buckets(x[first], t)
                yield pa.record_batch([pa.array(t * n_buckets + cell), vectors, lists], names=["bucket", "vector", "ids"])

    indexed = own.select("vec_id", "vector").mapInArrow(entries, "bucket long, vector binary, ids array<bigint>")
    rows = np.zeros(n_tables * n_buckets, np.int64)
    for bucket, n in indexed.groupBy("bucket").count().collect():  # at most as many as buckets
        rows[bucket] = n
    # Shards: neighbouring buckets up to SHARD_ROWS rows; larger buckets over several shards of their own.
    splits = np.maximum(1, -(-rows // SHARD_ROWS))
    first_shard, shard, room = np.zeros(len(rows), np.int64), 0, SHARD_ROWS
    for b in np.flatnonzero(rows).tolist():
        if splits[b] > 1 or rows[b] > room:
            shard, room = shard + 1, SHARD_ROWS
        first_shard[b] = shard
        if splits[b] > 1:
            shard, room = shard + int(splits[b]), SHARD_ROWS
        else:
            room -= int(rows[b])
    directory = spark.sparkContext.broadcast((rows, splits, first_shard))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes to each shard that holds buckets on its way, with their list."""
        rows_, splits_, first_ = directory.value
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            q = _matrix(batch.column("vector"), dtype, d)
            to, who, visit = [], [], []
            for t in range(n_tables):
                base = t * n_buckets
                for i, cells in enumerate(held.value.probes(q, t, rows_[base : base + n_buckets], mass, 4 * top)):
                    cells = cells + base
                    for b in cells[splits_[cells] > 1].tolist():
                        for s in range(int(splits_[b])):
                            to.append(int(first_[b]) + s)
                            who.append(i)
                            visit.append(np.array([b], np.int64).tobytes())
                    cells = np.sort(cells[splits_[cells] == 1])
                    shards = first_[cells]
                    order = np.argsort(shards, kind="stable")
                    for some in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(cells) else ():
                        to.append(int(shards[some[0]]))
                        who.append(i)
                        visit.append(cells[some].tobytes())
            at = pa.array(who, pa.int64())
            yield pa.record_batch([pa.array(to, pa.int64()), batch.column("vec_id").take(at), batch.column("vector").take(at), pa.array(visit, pa.binary())], names=["shard", "query_id", "vector", "cells"])

    asked = stored(queries.select("vec_id", "vector").mapInArrow(send, "shard long, query_id long, vector binary, cells binary"), "asked")
    # A shard that more queries visit than a task should hold is copied: once for each ``QUERY_ROWS`` visits, not for each part of all queries.
    visits = np.zeros(int(first_shard.max(initial=0)) + int(splits.max(initial=1)) + 1, np.int64)
    for found, n in asked.groupBy("shard").count().collect():  # at most as many as shards
        visits[found] = n
    copies = spark.sparkContext.broadcast(np.maximum(1, -(-visits // QUERY_ROWS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, splits_, first_ = directory.value
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            salt = np.array([zlib.crc32(v) for v in batch.column("vector").to_pylist()], np.int64) if (splits_[bucket] > 1).any() else np.zeros(len(bucket), np.int64)
            shard = first_[bucket] + np.where(splits_[bucket] > 1, np.mod(salt, splits_[bucket]), 0)
            for part in range(int(copies.value[shard].max(initial=0))):
                some = pa.array(np.flatnonzero(copies.value[shard] > part))
                columns = [x.take(some) for x in (pa.array(shard), batch.column("bucket"), batch.column("vector"), batch.column("ids"))]
                yield pa.record_batch([columns[0], pa.array(np.full(len(some), part, np.int32)), *columns[1:]], names=["shard", "part", "bucket", "vector", "ids"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = words.mix(batch.column("query_id").to_numpy().astype(np.uint64)) % copies.value[batch.column("shard").to_numpy()].astype(np.uint64)
            yield pa.record_batch([batch.column("shard"), pa.array(to.astype(np.int32)), *batch.columns[1:]], names=["shard", "part", "query_id", "vector", "cells"])

    def scan(key: tuple, points: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not points.num_rows or not asked.num_rows:
            return empty
        bucket = points.column("bucket").to_numpy()
        x = _matrix(points.column("vector"), dtype, d)
        _, one, of = np.unique(np.ascontiguousarray(np.column_stack([x, bucket])).view(f"V{8 * d + 8}").ravel(), return_index=True, return_inverse=True)
        lists = points.column("ids").to_pylist()
        ids: list[set] = [set() for _ in one]
        for i, j in enumerate(of):
            ids[j].update(lists[i])
        order = np.argsort(bucket[one], kind="stable")
        x, bucket = np.ascontiguousarray(x[one][order]), bucket[one][order]
        ids = [np.array(sorted(ids[j])[: top + 1]) for j in order]
        cells = np.unique(bucket)
        begin, end = np.searchsorted(bucket, cells), np.searchsorted(bucket, cells, side="right")
        q_all, names = _matrix(asked.column("vector"), dtype, d), asked.column("query_id").to_numpy()
        visits = [np.frombuffer(v, np.int64) for v in asked.column("cells").to_pylist()]
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(names), 128):
            q = q_all[at : at + 128]
            scores = np.full((len(q), len(x)), -np.inf)
            of_query = np.repeat(np.arange(len(q)), [len(v) for v in visits[at : at + 128]])
            visited = np.concatenate(visits[at : at + 128])
            by = np.argsort(visited, kind="stable")
            low, high = np.searchsorted(visited[by], cells), np.searchsorted(visited[by], cells, side="right")
            for c in range(len(cells)):
                who = of_query[by[low[c] : high[c]]]
                scores[who, begin[c] : end[c]] = q[who] @ x[begin[c] : end[c]].T
            need = min(top + 1, len(x))
            limit = np.partition(scores, len(x) - need, axis=1)[:, len(x) - need]
            for i in range(len(q)):
                near = np.flatnonzero((scores[i] >= limit[i] - 1e-9 * abs(limit[i])) & (scores[i] > -np.inf))
                exact = (x[near] * q[i]).sum(axis=1)
                who = np.concatenate([ids[j] for j in near]) if len(near) else np.zeros(0, np.int64)
                score = np.repeat(exact, [len(ids[j]) for j in near])
                other = who != names[at + i]
                who, score = who[other], score[other]
                best = np.lexsort((who, -score))[:top]
                out_q.append(np.full(len(best), names[at + i]))
                out_v.append(who[best])
                out_s.append(score[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v).astype(np.int64), "score": np.concatenate(out_s)})

    left = indexed.mapInArrow(deal, "shard long, part int, bucket long, vector binary, ids array<bigint>")
    right = asked.mapInArrow(part, "shard long, part int, query_id long, vector binary, cells binary")
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's search over ``embeddings``: queries are the rows whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
