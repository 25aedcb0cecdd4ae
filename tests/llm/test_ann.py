from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import ann

KIND = "vec_id long, embedding array<float>, label int, score double, vector string"


def brute(rows, queries, top=20):
    """{query: [(vec_id, score)]}, nearest first."""
    out = {}
    for q, x in rows:
        if q in queries:
            found = sorted((-float((np.float64(x) * np.float64(y)).sum()), i) for i, y in rows if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in found[:top]]
    return out


def results(frame):
    got = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], 0, 0.0, "v") for i, x in rows], KIND)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    source = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = results(ann.op7_ann(spark, path))
    x, ids = np.stack([v for _, v in source]), np.array([i for i, _ in source])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        hits += len(set(best) & {i for i, _ in got[q]})
        total += len(best)
        for i, score in got[q]:
            assert score == pytest.approx(float(x[ids == i][0] @ x[ids == q][0]), rel=1e-12)
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.9 * total


def test_everything_visited_is_exact_with_copies_ties_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 8)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    rng = np.random.default_rng(0)
    base = rng.integers(-2, 3, size=(25, 4)).astype(np.float32)
    rows = [(i, base[rng.integers(25)]) for i in range(120)] + [(200 + i, base[0]) for i in range(80)] + [(1000 + i, rng.normal(size=3).astype(np.float32)) for i in range(7)]
    good = [(i, x) for i, x in rows if np.abs(x).sum() > 0]
    frame = table(spark, rows)
    queries = {i for i, _ in good if i % 20 == 0}
    got = results(ann.nearest(frame.unionByName(frame), F.col("vec_id") % 20 == 0, mass=1.0))
    want = brute(good, queries)
    assert got == want


def test_edge_cases(spark):
    rows = [(0, [1, 0]), (1, None), (2, []), (3, [0, 0]), (4, [float("nan"), 1]), (5, [None, 1]), (6, [float("inf"), 1]), (None, [1, 1]), (20, [3e38, 3e38]), (40, None), (7, [-1, 0.5])]
    got = results(ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {0: [20, 7], 20: [0, 7]}
    assert ann.nearest(table(spark, rows).where("false"), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(table(spark, rows), F.lit(False)).collect() == []
