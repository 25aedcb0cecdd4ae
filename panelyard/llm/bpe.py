"""Byte-level BPE with a rank file, encoded and decoded by recursive DuckDB queries inside each partition.

A text falls into matches of the split pattern; each distinct match is encoded once. Its bytes become rows (word,
position, token). A recursive query joins neighbouring tokens to the merge table (every way to cut a token into two
tokens), takes each word's leftmost pair of the smallest rank, contracts it, and goes on with the words that changed, until none
does. Decoding knows nothing of the text: the ids of a document become rows (document, position, id), are joined to the vocabulary, and
its bytes are aggregated in the order of positions. As in public rank-file tokenizers, a match that is a token itself is that token.

Spark sees one pass without a shuffle. A task holds bounded caches of words that it has met, and hands DuckDB a bounded
number of words at a time, in memory. A match longer than ``LONG`` bytes (no natural word; one merge a round would take
quadratic time) is contracted by the same rule with a heap.

Defined cases: a null text is empty and has no tokens; special tokens are ordinary text; texts of any length are encoded whole;
rows that repeat each give a row; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import words

LONG = 256
#: Words in a query, codes that a worker keeps from one turn to the next, bytes of text at a time, tokens decoded in a query.
AT_ONCE, CACHED, PIECE, TOKENS = 10_000, 200_000, 1 << 21, 1 << 18

#: Rows come in the order of (word, position), and a step keeps the order of what it reads, so a neighbour is the next row;
#: the order of everything returned is verified.
ENCODE = """
with recursive step(round, word, pos, tok) as (
  select 0, word, pos, tok from start
  union all
  (with near as (
     select s.round, s.word, s.pos, s.tok, s.before, m.whole
     from (select *, case when lead(word) over () = word then (cast(tok as bigint) << 20) + lead(tok) over () end as pair,
             case when lag(word) over () = word then lag(pos) over () end as before from step) s
     left join merges m on m.pair = s.pair),
   least as (select word, min((cast(whole as bigint) << 20) + pos) as best from near where whole is not null group by word)
   select round + 1, n.word, n.pos, case when n.pos = best & 1048575 then cast(best >> 20 as integer) else n.tok end
   from near n join least l on l.word = n.word
   where n.before is distinct from best & 1048575)
)
select round, word, pos, tok from step
"""
#: The same with windows that sort, should an engine not keep the order.
SORTED = ENCODE.replace("over ()", "over (partition by word order by pos)") + " order by round, word, pos"
DECODE = """
select word, string_agg(v.hexed, '' order by pos) as decoded from start join vocabulary v on v.id = start.tok group by word
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def contract(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One long match by the same rule: a heap gives the smallest rank, leftmost first."""
    end = list(range(1, len(piece) + 1))
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    alive = [True] * len(piece)
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        if 0 <= i and (j := after[i]) < len(piece) and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(len(piece) - 1):
        push(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else len(piece)
        if j >= len(piece) or end[j] != to:
            continue
        alive[j], end[i], after[i] = False, to, after[j]
        if after[j] < len(piece):
            before[after[j]] = i
        push(i)
        push(before[i])
    return [ranks[piece[i : end[i]]] for i in range(len(piece)) if alive[i]]


class Codec:
    """Encodes and decodes words; lives in one Python worker."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = read_ranks(content)
        self.split = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        cuts = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        head, tail, whole = (np.array(x, dtype=np.int64) for x in zip(*cuts))
        merges = pa.table({"pair": (head << 20) + tail, "whole": whole.astype(np.int32)})
        vocabulary = pa.table({"id": np.array(list(self.ranks.values()), np.int32), "hexed": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")
        # Ids of matches and of segments by their text: those used since the last turn, and those used before it.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _run(self, sql: str, tokens: np.ndarray, sizes: np.ndarray) -> pa.Table:
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = pa.table({"word": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "tok": tokens.astype(np.int32)})
        self.db.register("start", start)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("start")

    def _contracted(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces at their fixpoints, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        for sql in (ENCODE, SORTED):
            got = self._run(sql, tokens, sizes)
            turn, word, pos, tok = (got.column(x).to_numpy().astype(np.int64) for x in ("round", "word", "pos", "tok"))
            if (np.diff((turn * len(pieces) + word) * (1 << 20) + pos) > 0).all():
                break
        last = np.zeros(len(pieces), np.int64)
        last[word] = turn  # rounds ascend, so the last one stays
        final = np.flatnonzero(turn == last[word])
        final = final[np.argsort(word[final], kind="stable")]
        return tok[final], np.bincount(word[final], minlength=len(pieces))

    def encode(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(match, ids as little-endian 32-bit numbers) of each match, in any order."""
        ranks, rest = self.ranks, []
        for p in pieces:
            if (whole := ranks.get(p)) is not None:
                yield p, whole.to_bytes(4, "little")
            elif len(p) > LONG:
                yield p, np.array(contract(p, ranks), "<u4").tobytes()
            else:
                rest.append(p)
        for at in range(0, len(rest), AT_ONCE):
            some = rest[at : at + AT_ONCE]
            tokens, sizes = self._contracted(some)
            ids, end = tokens.astype("<u4").tobytes(), 0
            for p, n in zip(some, (4 * sizes).tolist()):
                yield p, ids[end : end + n]
                end += n

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids; longer ones go through several queries."""
        parts = [(doc, ids[at : at + 4 * TOKENS]) for doc, ids in enumerate(coded) for at in range(0, len(ids), 4 * TOKENS)]
        out: list[list[bytes]] = [[] for _ in coded]
        at = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to][1]) <= 4 * TOKENS):
                size += len(parts[to][1])
                to += 1
            tokens = np.frombuffer(b"".join([ids for _, ids in parts[at:to]]), "<u4")
            got = self._run(DECODE, tokens, np.array([len(ids) // 4 for _, ids in parts[at:to]]))
            for word, hexed in zip(got.column("word").to_pylist(), got.column("decoded").to_pylist()):
                out[parts[at + word][0]].append((at + word, bytes.fromhex(hexed)))
            at = to
        return [x[0][1] if len(x) == 1 else b"".join([y for _, y in sorted(x)]) for x in out]

    def _learn(self, some: set[str]) -> None:
        """Brings the codes of segments, each a whole number of matches, into ``young``."""
        young, old, cut, new = self.young, self.old, {}, set()
        for x in some.difference(young):
            if (code := old.get(x)) is not None:
                young[x] = code
            elif x.isalpha() or x[1:].isalpha() and x[0] == " ":
                new.add(x)  # letters, perhaps after a space: one match
            else:
                cut[x] = self.split.findall(x)
        for parts in cut.values():
            for p in parts:
                if p not in young:
                    if (code := old.get(p)) is not None:
                        young[p] = code
                    else:
                        new.add(p)
        for p, ids in self.encode([p.encode() for p in new]):
            young[p.decode()] = ids
        for x, parts in cut.items():
            if len(parts) != 1:
                young[x] = b"".join([young[p] for p in parts])

    def texts(self, some: list[str]) -> list[bytes]:
        """The ids of whole texts."""
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        cut = [segments(x) for x in some]
        self._learn(set().union(*cut))
        young = self.young
        return [b"".join([young[s] for s in x]) for x in cut]


#: A single space between characters that are no white space under any definition begins a match in every text.
_SOLID = "!-~¡-ᙿ"
_ODD = re.compile(f" (?:(?![{_SOLID}])|(?<![{_SOLID}] ))")
_CUT = re.compile(f"(?<=[{_SOLID}])(?= [{_SOLID}])")


def segments(text: str) -> list[str]:
    """``text`` cut where matches of the pattern surely begin."""
    if not text:
        return []
    if _ODD.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


_codecs: dict[tuple, Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """The worker's codec of these ranks."""
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content, pattern)
    return _codecs[key]


def _map(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, row, decoded: bool = True) -> DataFrame:
    with open(path, "rb") as file:  # on the driver; executors get its content
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), pattern))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            for piece in words.pieces(batch, "text", PIECE):
                coded = own.texts([x or "" for x in piece.column("text").to_pylist()])
                found = [row(ids, text) for ids, text in zip(coded, own.decode(coded))] if decoded else [row(ids) for ids in coded]
                columns = [pa.array(x) for x in zip(*found)]
                yield pa.record_batch([piece.column("doc_id"), *columns], names=["doc_id", *names])
        words.give_back()

    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit numbers, and the bytes that they decode to."""
    return _map(docs, path, pattern, id_col, text_col, "ids binary, decoded binary", lambda ids, decoded: (ids, decoded))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), taken where the ids are made, so that they needn't be moved."""
    hexed = lambda x: hashlib.sha256(x).hexdigest()
    return _map(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded: (len(ids) // 4, hexed(ids), hexed(decoded)))


def lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens); nothing is decoded."""
    return _map(docs, path, pattern, id_col, text_col, "n_tokens long", lambda ids: (len(ids) // 4,), decoded=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of every whole text of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
