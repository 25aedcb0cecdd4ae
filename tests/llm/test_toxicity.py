import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelyard.llm import toxicity
from tests.llm.fixtures import documents

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = toxicity.op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    # A tenth of the toxic labels here stand on texts without any sign.
    assert sum(r.predicted == 1 for r in got if r.toxic) >= 0.85 * sum(r.toxic for r in got)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.01 * len(got)


def case(n=4000, wrong=0.02):
    rng = np.random.default_rng(5)
    truth = rng.random(n) < 0.3
    rates = [(0.02, 0.7), (0.1, 0.6), (0.05, 0.5)]
    votes = np.stack([np.where(truth, rng.random(n) < hit, rng.random(n) < miss) for miss, hit in rates], axis=1).astype(float)
    return truth, np.column_stack([votes, votes[:, 2], votes[:, 2]]), np.where(rng.random(n) < wrong, ~truth, truth).astype(int), rates


def test_label_model_finds_accuracies_also_of_the_label_and_discounts_copies_of_a_voter():
    truth, votes, noisy, rates = case(wrong=0.1)
    p, found, weight = toxicity.posteriors(np.column_stack([votes, noisy]), noisy)
    assert np.abs(found[:, :3] - np.array(rates).T).max() < 0.12
    assert abs(found[0, 5] - 0.1) < 0.06 and abs(found[1, 5] - 0.9) < 0.06  # how often the label itself fires
    assert weight[0] > 0.8 and np.abs(weight[2:5] - 1 / 3).max() < 0.08
    assert ((p > 0.5) == truth).mean() > (noisy == truth).mean() + 0.01  # the voters mend labels


def test_posteriors_agree_with_plain_em():
    _, votes, noisy, _ = case(150)
    votes = np.column_stack([votes, noisy])
    n, m = votes.shape
    p, weight = [0.98 if y else 0.02 for y in noisy], [1.0] * m
    for turn in range(12):
        share = min(max(sum(p) / n, 1e-3), 1 - 1e-3)
        rates = [[min(max((sum(votes[i, j] * (q if k else 1 - q) for i, q in enumerate(p)) + 0.02) / (sum(q if k else 1 - q for q in p) + 1), 1e-4), 1 - 1e-4) for j in range(m)] for k in (0, 1)]
        if turn % 10 == 1:
            rest = [[votes[i, j] - p[i] * rates[1][j] - (1 - p[i]) * rates[0][j] for j in range(m)] for i in range(n)]
            dot = lambda a, b: sum(r[a] * r[b] for r in rest)  # noqa: B023, E731
            norm = [math.sqrt(dot(j, j)) + 1e-9 for j in range(m)]
            weight = [1 / max(1.0, sum((dot(a, b) / (norm[a] * norm[b])) ** 2 for b in range(m))) for a in range(m)]
        for i in range(n):
            odds = math.log(share / (1 - share))
            for j in range(m):
                odds += weight[j] * (math.log(rates[1][j] / rates[0][j]) if votes[i, j] else math.log((1 - rates[1][j]) / (1 - rates[0][j])))
            p[i] = 1 / (1 + math.exp(-min(max(odds, -40), 40)))
    got, found, weights = toxicity.posteriors(votes, noisy, 12)
    assert np.allclose(got, p, atol=1e-9) and np.allclose(found, rates) and np.allclose(weights, weight)


def test_the_label_model_departs_from_labels_without_any_sign(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    draw = lambda extra: " ".join([*rng.choice(words, 30), *extra])
    samples = [(draw(rng.choice(["vile", "rotten", "filthy"], 2)), 1) for _ in range(60)] + [(draw([]), 0) for _ in range(300)] + [(draw([]), 1) for _ in range(6)]
    report = {}
    model = toxicity.fit(samples, report)
    assert report["texts"] == 366 and report["voters"] > 6 and report["turned_clean"] == 6 and report["turned_toxic"] == 0
    assert (model.scores(pa.array(["a vile w1", "w1 w2", None])) >= 0.5).tolist() == [True, False, False]


def test_a_doc_id_with_several_texts_and_shared_ids(spark):
    docs = documents(spark, ["you idiot", "fine words"] * 20).withColumn("doc_id", F.ceil(F.col("doc_id") / 2).cast("long"))
    labels = docs.select("doc_id").distinct().select("doc_id", F.lit(1).alias("toxic"))
    rows = toxicity.sample(docs, labels, F.lit(True))
    assert len(rows) == 40 and {label for _, label in rows} == {1}  # every text of a labelled id, each with its label
    assert toxicity.classify(docs, toxicity.fit(rows)).count() == 40


def test_edge_cases(spark):
    texts = [None, "", "you idiot", "fine words"] * 10 + ["idiot " * 40000]
    docs = documents(spark, texts)
    labels = docs.select("doc_id", F.coalesce(F.col("text").contains("idiot"), F.lit(False)).cast("int").alias("toxic"), F.lit(1).alias("score"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, 1), (3, 0, 1)], labels.schema.simpleString()[7:-1].replace(":", " ")))
    model = toxicity.fit(toxicity.sample(docs, labels, F.lit(True)))
    rows = {r.doc_id: r.predicted for r in toxicity.classify(docs, model).collect()}
    assert all(rows[i + 1] == int("idiot" in (t or "")) for i, t in enumerate(texts))
    assert toxicity.classify(docs.where("false"), model).collect() == []
    assert toxicity.classify(docs.unionByName(docs), model).count() == 2 * len(texts)
    for none in (labels.where("false"), labels.where("toxic = 0")):
        model = toxicity.fit(toxicity.sample(docs, none, F.lit(True)))
        assert {r.predicted for r in toxicity.classify(docs, model).collect()} == {0}
    assert toxicity.fit([("a", 1)]).scores(pa.array(["b", None]))[0] > 0.5
