import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from panelyard.llm import bpe
from tests.llm.fixtures import SF, documents

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b\n\n c", "\t\tx", "don't we'll I'M", "x y   z", "　　a b", "a\x1cb \x1f c\x85d", "é   q",
    "日本語 テキスト 한국어", "😀 👩‍👩‍👧 x", "<|endoftext|> a", "1234 5 ½ Ⅷ ²", "ab" * 700, "é" * 300 + " x" * 300, " " * 400 + "a", "\r\n \r\n", "A_b-C+d=e/f", "x   y", "x​ y",
]


def want(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()


def test_documents_agree_with_the_library(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(spark, SF).collect()}
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == {r.doc_id: want(r.text) for r in source}


def test_odd_texts_and_edge_cases(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab  \n\t'é1. 日\x1c") for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    for i, text in enumerate(texts):
        assert got[i + 1] == want(text), text
    assert bpe.digests(docs.where("false"), PATH, P.PATTERN).collect() == []
    assert bpe.encode(docs.unionByName(docs), PATH, P.PATTERN).count() == 2 * len(texts)
    row = bpe.encode(docs.where("doc_id = 11"), PATH, P.PATTERN).first()
    assert bytes(row.decoded).decode() == texts[10] and np.frombuffer(row.ids, "<u4").tolist() == LIBRARY.encode_ordinary(texts[10])


def test_small_caches_and_queries_change_nothing(monkeypatch):
    own = bpe.Codec(open(PATH, "rb").read(), P.PATTERN)
    texts = [x or "" for x in ODD] * 2
    for name, value in (("CACHED", 7), ("AT_ONCE", 3), ("TOKENS", 5)):
        monkeypatch.setattr(bpe, name, value)
    coded = own.texts(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in coded] == [LIBRARY.encode_ordinary(x) for x in texts]
    assert own.decode(coded) == [x.encode() for x in texts] and own.decode([]) == []


def test_decoding_reads_ids_alone():
    own = bpe.Codec(open(PATH, "rb").read(), P.PATTERN)
    rng = np.random.default_rng(6)
    lists = [rng.integers(0, len(RANKS), n).astype("<u4") for n in (0, 1, 7, 500)]
    assert own.decode([x.tobytes() for x in lists]) == [LIBRARY.decode_bytes(x.tolist()) for x in lists]


def test_long_matches_are_contracted_as_by_the_recursion():
    own = bpe.Codec(open(PATH, "rb").read(), P.PATTERN)
    for piece in (b"ab" * 120, "é".encode() * 100, b"abcdefgh" * 31, b"zzzzzzz" * 30):
        tokens, sizes = own._contracted([piece])
        assert bpe.contract(piece, RANKS) == tokens.tolist() == LIBRARY._encode_single_piece(piece) and sizes.tolist() == [len(tokens)]
    for piece in (b"ab" * 700, "é".encode() * 300, b"abcdefgh" * 500):
        assert bpe.contract(piece, RANKS) == LIBRARY._encode_single_piece(piece)
