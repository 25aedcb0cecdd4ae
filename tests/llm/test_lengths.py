from collections import Counter

import public_tokenizers as P

from panelyard.llm import lengths
from tests.llm.fixtures import SF, documents
from tests.llm.test_bpe import LIBRARY, ODD, PATH


def check(rows, sizes):
    assert {r.n_tokens: r.docs for r in rows} == Counter(sizes) and len(rows) == len(set(sizes))
    for r in rows:
        assert r.docs_at_least == sum(n >= r.n_tokens for n in sizes) and r.tokens_at_least == sum(n for n in sizes if n >= r.n_tokens)
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in sizes) and r.quantile == sum(n <= r.n_tokens for n in sizes) / len(sizes)


def test_documents_agree_with_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(lengths.op6_token_counts(spark, SF).collect(), [len(LIBRARY.encode_ordinary(r.text or "")) for r in source])


def test_limits_quantiles_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(lengths, "RANGE", 3)
    docs = documents(spark, ODD)
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    sizes = [len(LIBRARY.encode_ordinary(r.text or "")) for r in docs.collect()]
    hist = lengths.histogram(docs, PATH, P.PATTERN).cache()
    check(lengths.suffix_sums(hist).collect(), sizes)
    for r in lengths.at_limits(hist, [0, 1, 7, 10**9]).collect():
        x = r.context_limit
        assert (r.tokens, r.truncated_docs, r.lost_tokens) == (sum(min(n, x) for n in sizes), sum(n > x for n in sizes), sum(max(0, n - x) for n in sizes))
    for r in lengths.quantiles(hist, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(n for n in sizes if sum(m <= n for m in sizes) >= r.share * len(sizes))
    empty = hist.where("false")
    assert lengths.suffix_sums(empty).collect() == [] and [r.tokens for r in lengths.at_limits(empty, [5]).collect()] == [0] and lengths.quantiles(empty, [0.5]).first().n_tokens is None
    assert lengths.histogram(docs.where("false"), PATH, P.PATTERN).collect() == []
