import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelyard.llm import langid
from tests.llm.fixtures import SF, documents


@pytest.mark.parametrize("segment", [1, 2, 3, 7])
def test_forward_backward_agrees_with_all_paths(segment):
    rng = np.random.default_rng(segment)
    first = np.array([0, 1, 6, 8, 13])
    scores, moves, start = rng.normal(size=(13, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.forward_backward(scores, first, moves, start, segment)[0]
    for a, b in zip(first[:-1], first[1:]):
        total, by_word = 0.0, np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(start[path[0]] + sum(scores[a + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                by_word[t, y] += w
        assert np.allclose(got[a:b], by_word / total)


def test_held_out_accuracy(spark):
    got = langid.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got)


def test_words_of_code_switched_text():
    de, fr = "der die und nicht mit ein zu von", "le la les des une dans pour que"
    model = langid.fit([(" ".join(np.random.default_rng(i).permutation((x + " ") .split() * 6)), y) for i in range(20) for x, y in ((de, "de"), (fr, "fr"))])
    langs, scores = langid._label(model, pa.array([f"{de} {de} {fr}", f"{de} {fr} {fr}", de, "12 %", None, "Ω"]))
    assert langs[:5] == ["de", "fr", "de", "und", "und"] and langs[5] in ("de", "fr")
    assert scores[0] == pytest.approx(2 / 3, abs=0.1) and scores[2] > 0.9 and scores[3:5] == [0, 0]


def test_edge_cases(spark):
    docs = documents(spark, [None, "", "...", "the of and", "THE Of", "x" * 5000, "the of " * 30000])
    model = langid.train(docs, F.lit(True))
    rows = {r.doc_id: r.lang_pred for r in langid.label(docs, model).collect()}
    assert [rows[i] for i in range(1, 8)] == ["und"] * 3 + ["en"] * 4
    assert langid.label(docs.where("false"), model).collect() == []
    assert {r.lang_pred for r in langid.label(docs, langid.train(docs, F.lit(False))).collect()} == {"und"}
    assert langid.label(docs.unionByName(docs), model).count() == 14


def plain_label(model, text):
    """The same field by a plain forward-backward, word by word, feature by feature."""
    found = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    if not found or not any(c.isalpha() for c in text):
        return "und", 0.0
    n = len(model.labels)
    rows = []
    for w in found:
        buf, s, e = np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])
        whole = langid.words.hashes(buf, s, e)
        row = sum(model.weights[i].astype(float) for i in langid.affixes(buf, s, e, whole)[0])
        grams, _ = langid.grams(buf, s, e)
        rows.append(row + sum(model.weights[i].astype(float) for i in grams) / math.sqrt(len(grams)))
    ahead = [[model.start[y] + rows[0][y] for y in range(n)]]
    for row in rows[1:]:
        ahead.append([np.logaddexp.reduce([ahead[-1][x] + model.moves[x, y] for x in range(n)]) + row[y] for y in range(n)])
    back = [[0.0] * n]
    for row in rows[:0:-1]:
        back.append([np.logaddexp.reduce([model.moves[x, y] + row[y] + back[-1][y] for y in range(n)]) for x in range(n)])
    total = np.logaddexp.reduce(ahead[-1])
    share = sum(np.exp(np.array(a) + np.array(b) - total) for a, b in zip(ahead, reversed(back))) / len(rows)
    return model.labels[int(share.argmax())], float(share.max())


def test_the_whole_query_agrees_with_a_plain_forward_backward(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id"), 3, 1))
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 12 = 0").collect()}
    rows = {r.doc_id: r for r in langid.op10_language_id(spark, SF).collect()}
    assert len(rows) == docs.count() and len(texts) > 50
    for doc, text in texts.items():
        lang, score = plain_label(model, text)
        assert rows[doc].lang_pred == lang and rows[doc].score == pytest.approx(score, abs=1e-3)


def test_rejected_are_texts_without_a_language_and_nothing_else(spark):
    rng = np.random.default_rng(0)
    texts = {"de": "der die und nicht mit ein zu von", "fr": "le la les des une dans pour que", "en": "the of and to in that with for", "es": "el los por una con del para como"}
    samples = [(" ".join(rng.permutation(x.split() * 6)), y) for _ in range(20) for y, x in texts.items()]
    model = langid.fit(samples)
    mixed = " ".join(" ".join([x] * 3) for x in texts.values())
    column = pa.array([*texts.values(), mixed, None, "", "12 %", f"{texts['en']} {texts['fr']}"])
    assert langid.accepted(model, column).tolist() == [True] * 4 + [langid._label(model, column)[1][4] >= 0.3] + [False] * 3 + [True]
    assert langid.accepted(model, column, 2.0).tolist() == [True] * 4 + [False] * 4 + [langid._label(model, column)[1][8] >= 0.5]
    docs = documents(spark, ["plain English words", None, "12", "more words"]).withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(docs, F.lit(True)) is None
    kept = langid.with_language(docs, None)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4}
