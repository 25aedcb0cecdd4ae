import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import lm
from tests.llm.fixtures import SF, documents

TEXTS = [None, "", "a b a b A", "a  b\tc", "zz a b", "a b c a b c", "é É", "w " * 9000, "a b c a b c", "b c zz a q", "a b a b A"]


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "</s>"]


class Plain:
    """The same automaton over tuples, in dictionaries."""

    def __init__(self, texts, order):
        self.order, counts = order, [Counter() for _ in range(order)]
        for w in texts:
            padded = ["<s>", *w]
            for i in range(1, len(padded)):
                for n in range(1, min(order, i + 1) + 1):
                    counts[n - 1][tuple(padded[i - n + 1 : i + 1])] += 1
        self.counts, self.n, self.types = counts, sum(counts[0].values()), [len(c) for c in counts]
        self.histories = Counter({h: c for level in counts[: order - 1] for h, c in level.items()})
        if order > 1:
            self.histories["<s>",] = len(texts)
        self.arcs = {(g[:-1], g[-1]): (math.log10(self.recursive(g[:-1], g[-1])), self.longest(g)) for level in counts for g in level}
        self.left = {h: math.log10(self.prior(h) / (c + self.prior(h))) for h, c in self.histories.items()}

    def prior(self, history):
        return self.types[len(history)] / self.types[len(history) - 1] if self.types[len(history) - 1] else 1.0

    def longest(self, gram):
        gram = gram[max(0, len(gram) - self.order + 1) :] if self.order > 1 else ()
        while gram and not self.histories[gram]:
            gram = gram[1:]
        return gram

    def recursive(self, history, w):
        if not history:
            return (self.counts[0][(w,)] + 1) / (self.n + self.types[0] + 1)
        if not self.histories[history]:
            return self.recursive(history[1:], w)
        k = self.prior(history)
        return (self.counts[len(history)][(*history, w)] + k * self.recursive(history[1:], w)) / (self.histories[history] + k)

    def walk(self, text):
        state, total = ("<s>",) if self.order > 1 and self.histories["<s>",] else (), 0.0
        for w in text:
            while state and (state, w) not in self.arcs:
                total += self.left[state]
                state = state[1:]
            weight, state = self.arcs.get((state, w), (math.log10(1 / (self.n + self.types[0] + 1)), ()))
            total += weight
        return total

    def defined(self, text):
        padded = ["<s>", *text]
        return sum(math.log10(self.recursive(tuple(padded[max(0, i - self.order + 1) : i]), padded[i])) for i in range(1, len(padded)))


def brute(docs, order):
    model = Plain([tokens_of(t) for _, t, train in docs if train], order)
    out = {}
    for doc, text, _ in docs:
        w = tokens_of(text)
        score = model.walk(w)
        assert score == pytest.approx(model.defined(w), abs=1e-6)
        base = sum(math.log10((model.counts[0][(t,)] + 1) / (model.n + model.types[0] + 1)) for t in w)
        out[doc] = (len(w), sum(model.counts[0][(t,)] > 0 for t in w), model.n, base, score)
    return out


def check(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-5) and r.score == pytest.approx(score, abs=1e-5)


def test_documents_agree_with_a_dictionary_automaton_and_the_definition(spark):
    source = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = lm.op4_lm_score(spark, SF).collect()
    check(rows, brute(source, lm.ORDER))
    assert {r.doc_id for r in rows if not r.held_out} == {d for d, _, tr in source if tr}
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || ['</s>'] w from documents),
t as (select doc_id, unnest(w) w from d), k as (select w, count(*) c from t where not list_contains(?, doc_id) group by w), n as (select sum(c) n, count(*) v from k)
select doc_id, count(*), count(c), any_value(n), sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) from t left join k using (w), n group by doc_id"""


def test_base_columns_agree_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = {r.doc_id: r for r in lm.op4_lm_score(spark, SF).collect()}
    for doc, n, known, total, base in con.execute(SQL, [[d for d, r in rows.items() if r.held_out]]).fetchall():
        r = rows.pop(doc)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, abs=1e-6)
    assert not rows


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_blocks_and_edge_cases(spark, order):
    docs = documents(spark, TEXTS)
    source = [(i + 1, t, i % 3 != 1) for i, t in enumerate(TEXTS)]
    for block_bytes in (700, 1 << 20):
        check(lm.score(docs, F.col("doc_id") % 3 != 2, order=order, block_bytes=block_bytes).collect(), brute(source, order))
    assert lm.score(docs.where("false"), F.lit(True), order=order).collect() == []
    none = lm.score(docs, F.lit(False), order=order).collect()
    assert len(none) == len(TEXTS) and all(r.n_known == r.train_tokens == 0 for r in none)


def test_repeated_rows_and_rows_without_id(spark):
    docs = documents(spark, TEXTS[:6])
    twice = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    texts = [t for t in TEXTS[:6]] * 3
    model = Plain([tokens_of(t) for t in texts], 3)
    rows = lm.score(twice, ~lm.held_out(F.lit(None).cast("long"), 7, 2), least_bytes=5).collect()
    assert sorted(round(r.score, 6) for r in rows) == sorted(round(model.walk(tokens_of(t)), 6) for t in texts)


def test_segments_carry_the_state_as_whole_texts_do(spark):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdef"), n)) for n in (0, 1, 2, 3, 40, 41, 333)]
    block = lm.Block(pa.table({"text": texts, "train": [True, False, True, True, True, False, True]}), 3)
    block.total = int(block.levels[0].here.sum())
    for n in (0, 1, 2):
        if n:
            block.grow()
        block.levels[n].shared[:] = True
        block.levels[n].types = int((block.levels[n].count > 0).sum())
    made, here = block.automaton(), block.levels[0].index.astype(np.int64)
    whole = made.walk(here, block.first, 1000)
    for segment in (1, 2, 3, 7, 40):
        assert np.allclose(made.walk(here, block.first, segment), whole, atol=1e-12)


def test_the_model_is_a_distribution(spark):
    # What the arcs and failure arcs of a state give to all words, and to one that was never seen, is all there is.
    model = Plain([tokens_of(t) for t in ("a b a c", "b b", "a", "a b a")], 3)
    for history in [(), ("<s>",), ("a",), ("a", "b"), ("<s>", "a"), ("b", "a")]:
        assert sum(model.recursive(history, w) for w in ("a", "b", "c", "</s>", "never")) == pytest.approx(1)


def test_documents_that_occur_twice_score_higher(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 80)) for _ in range(40)]
    docs = documents(spark, texts + texts[:20])
    rows = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs, F.lit(True)).collect()}
    assert min(rows[i + 1] for i in range(20)) > max(rows[i + 1] for i in range(20, 40))
