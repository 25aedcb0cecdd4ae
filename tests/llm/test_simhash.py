import random

import xxhash

from panelyard.llm import simhash
from tests.llm.fixtures import SF, documents


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or [" ".join(found)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for n, i in enumerate(ids):
        for j, other in zip(ids[:n], fps):
            if (other ^ fps[n]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: root(i) for i in ids}


def test_documents_agree_with_brute_force(spark):
    rows = simhash.op3_simhash(spark, SF).collect()
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in source}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps and len(rows) == len(source)
    ids = sorted(fps)
    assert {r.doc_id: r.component_id for r in rows} == brute_components(ids, [fps[i] for i in ids])


def test_chains_of_links_and_both_sides_of_the_radius(spark):
    rng = random.Random(1)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(frame, len(signed))).collect()}
    want = brute_components(signed, [x % (1 << 64) for x in signed])
    assert {x: found.get(x, x) for x in signed} == want


def test_rounds_of_a_bucket_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(300)})
    import numpy as np

    x = np.array(fps, dtype=np.uint64)
    whole = [simhash._meet(x, b, 4, 2) for b in range(16)]
    monkeypatch.setattr(simhash, "AT_ONCE", 5000)
    for b, (p, q) in enumerate(whole):
        assert [sorted(map(tuple, np.stack(z).T.tolist())) for z in (simhash._meet(x, b, 4, 2), (p, q))][0] == sorted(zip(p.tolist(), q.tolist()))


def test_one_row_stays_of_each_group_where_ids_are_shared(spark):
    rng = random.Random(4)
    draw = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 9) for _ in range(60))
    a, b, c, d, e = (draw() for _ in range(5))
    # 7 leads the groups of a and b, is a member of c's, which 3 leads; 9 has two texts of one fingerprint; 8 repeats a row.
    rows = [(7, a), (7, b), (10, a), (11, b), (3, c), (7, c), (9, d), (9, d.upper()), (8, e), (8, e), (12, e)]
    docs = documents(spark, [t for _, t in rows]).drop("doc_id")
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").join(docs.dropDuplicates(["text"]), "text").select("doc_id", *docs.columns)
    assert len(brute_components(range(5), fps := [brute_fingerprint(t) for t in (a, b, c, d, e)])) == len(set(brute_components(range(5), fps).values())) == 5
    kept = simhash.keep_first(docs)
    first = min((d, d.upper()), key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(7, a), (7, b), (3, c), (9, first), (8, e)])


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "one", "ONE", "a b c", "a  b\tC", "long " * 20000, "Ünï ünï Ü x y"]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 4").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 11
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[None] == 4 and by[6] == by[7] == 6
    kept = simhash.keep_first(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "4", "6", "8", "9", "None"]) and kept[0].__fields__ == docs.columns
    assert simhash.near_duplicates(docs.where("false")).collect() == []
