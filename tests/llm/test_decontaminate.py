import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from panelyard.llm import decontaminate
from panelyard.session import shared_path
from tests.llm.fixtures import documents


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            b = words_of(t)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def case():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(9)] + ["é", "ünï", "A1"]
    draw = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(i, draw(rng.choice([13, 20, 40]))) for i in range(12)] + [(50, "w1 w2 w3"), (51, "A1"), (52, "..."), (None, draw(30)), (53, None), (50, "w1 w2 w3")]
    texts = [None, "", "!!"]
    for _ in range(60):
        parts = [draw(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            source = rng.choice(items)[1] or ""
            cut = source.split()
            low = rng.randrange(len(cut) + 1)
            parts += [" ".join(cut[low : low + rng.choice([8, 12, 13, 14, 60])]).upper() if rng.random() < 0.3 else " ".join(cut[low:]), draw(rng.randrange(20))]
        texts.append(" - ".join(parts))
    return texts, items


def test_hits_agree_with_brute_force_in_one_block_and_in_several(spark):
    texts, items = case()
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(i + 1, t) for i, t in enumerate(texts)], items)
    for most in (1 << 24, 500):
        got = decontaminate.contamination(docs, bench, most_bytes=most).collect()
        assert len(got) == len(texts)
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want


def test_a_large_block_is_indexed_in_seconds():
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"word{i}" for i in range(5000)])
    texts = [" ".join(vocabulary[rng.integers(0, 5000, 400)]) for _ in range(1200)]  # 4 MB
    passage = " ".join(vocabulary[:30])
    began = time.process_time()
    own = decontaminate.Benchmark([(str(i), f"{t} {passage}" if i % 3 == 0 else t) for i, t in enumerate(texts)])
    assert time.process_time() - began < 20
    n, hits = own.match(pa.array([f"x {passage.upper()} y", texts[7][:200], None]))
    assert n[2] == 0 and hits[0][0] == [[1, 31]] and len(hits[0][1]) == 400 and hits[1][1] == {"7"}


def test_runs_of_one_hash_are_compared_as_text(monkeypatch):
    monkeypatch.setattr(decontaminate.words, "grams", lambda h, n, *_: np.zeros(max(0, len(h) - n + 1), np.uint64))
    with pytest.raises(ValueError, match="share a hash"):
        decontaminate.Benchmark([("1", "a b c"), ("2", "d e f")])


def test_edge_cases(spark):
    texts, items = case()
    docs, bench = documents(spark, texts + ["w1 w2 w3 " * 30000]), spark.createDataFrame(items, "item_id long, text string")
    twice = docs.unionByName(docs)
    for most in (1 << 24, 500):
        assert decontaminate.contamination(twice, bench, most_bytes=most).count() == 2 * (len(texts) + 1)
    assert decontaminate.contamination(docs.where("false"), bench).collect() == []
    none = decontaminate.contamination(docs, bench.where("false")).collect()
    assert len(none) == len(texts) + 1 and not any(r.n_hit or r["items"] for r in none)


def test_rows_are_judged_by_their_own_text_in_one_block_and_in_several(spark):
    texts, items = case()
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    bad = {t for (n, hit, _), t in zip(brute(list(enumerate(texts)), items).values(), texts) if hit and 20 * hit >= n}
    want = sorted(str(t) for t in texts if t not in bad)
    assert bad and set(texts) - bad
    for ids in ("cast(null as long)", "7L", "if(doc_id % 2 = 0, null, doc_id % 5)"):
        odd = docs.selectExpr(f"{ids} as doc_id", *docs.columns[1:])
        for most in (1 << 24, 500):
            got = decontaminate.decontaminated(odd, bench, most_bytes=most)
            assert got.columns == docs.columns and sorted(str(r.text) for r in got.collect()) == want


def test_query(spark):
    texts, items = case()
    path = shared_path(spark, "case")
    documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = {r.doc_id: r for r in decontaminate.op5_decontamination(spark, path).collect()}
    for doc, (n, hit, found) in brute([(i + 1, t) for i, t in enumerate(texts)], items).items():
        assert (got[doc].n_words, got[doc].n_hit, got[doc].n_items) == (n, hit, len(found))
        assert got[doc].contaminated == (hit > 0 and 20 * hit >= n)
