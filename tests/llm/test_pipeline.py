import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from panelyard.llm import langid
from panelyard.session import shared_path
from tests.llm.fixtures import SF, documents
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, left = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in left.collect()}
        left = stage(spark, left, SF).cache()
        after = {r.doc_id: r for r in left.collect()}
        assert left.columns == columns and all(before[i] == r for i, r in after.items())
        kept.append((name, before, after))
    for name, before, after in kept:
        gone = set(before) - set(after)
        if name == "language_id":
            model = langid.train(docs, ~langid.held_out(F.col("doc_id"), 3, 1))
            mask = langid.accepted(model, pa.array([r.text for r in before.values()]))
            assert gone == {i for i, ok in zip(before, mask) if not ok}
            assert all(i in gone for i, r in before.items() if not any(c.isalpha() for c in r.text or ""))
        elif name == "toxicity":
            assert gone and len(gone) < 0.12 * len(before)
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            low = brute_components(ids, [brute_fingerprint(before[i].text) for i in ids])
            assert set(after) == set(low.values())
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hits = brute([(i, r.text) for i, r in before.items()], items)
            assert gone == {i for i, (n, hit, _) in hits.items() if hit and 20 * hit >= n}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept[-1][2])


def test_odd_rows_and_empty_tables(spark):
    path = shared_path(spark, "case")
    texts = [None, "", "12 34", "the of and a", "the of and a", "you idiot fool"]
    docs = documents(spark, texts).drop("fp", "root", "block")
    docs = docs.unionByName(docs).unionByName(docs.where("doc_id = 4").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "w x y"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(6, 1, 1), (4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    # Three labels are too few to mine a voter from, so nothing is toxic; 5 is a copy of 4.
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, path).collect()) == ["4", "6", "None"]
    empty = shared_path(spark, "case")
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
