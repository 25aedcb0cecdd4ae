"""Language-model scoring by a weighted backoff automaton.

States are the histories of up to ``order - 1`` tokens that the training texts hold, the empty one and the beginning of a text among them.
An arc reads a token, adds its log10 probability and leads to the longest state that ends in it; a state without an arc for the next
token has a failure arc to its longest shorter history, whose weight is the log10 of the mass left to it. Each text is read once from left
to right: ``Automaton.walk`` carries the state, takes arcs and failure arcs and adds up their weights. Texts are cut into
segments that are walked side by side; a segment in the middle of a text first reads the ``order - 1`` tokens before it, after which the
state is the one that the whole text gives, because every part of a known n-gram is known.

Smoothing has a Dirichlet prior: P(w|h) = (c(hw) + K P(w|h')) / (c(h) + K), h' being h without its first token, so that K / (c(h) + K)
is the mass left to h'; K of an order is the number of distinct n-grams a distinct (n-1)-gram, over the whole training corpus. It ends in
P(w) = (c + 1) / (N + V + 1), where a token that was never seen is one more type.

The model grows with the corpus and is never in one place. Documents are dealt into blocks of bounded bytes. Each block
sends its distinct n-grams with their training counts, packed, to ranges of the hash space; a range adds up and answers each
block, and says which n-grams no other block has sent. The block builds its part of the automaton from the answers. An n-gram of three or more
tokens is only sent if other blocks hold both its first and its last n-1 tokens: else no other block can hold it, and its count here is its count.
A hot n-gram is sent once per block, so no range is hot. n-grams are known by 64-bit hashes. Ranges hold as much as ``RANGE_BLOCKS`` blocks send,
so messages number blocks x ranges, and their size is bounded from below by that of a plain shuffle's records only up to some 100,000 blocks (a TB).

Defined cases: a null or empty text is its end token alone; a row with a null doc_id isn't held out; rows that repeat each
count and each give a row; without training texts every token is unseen; no rows give no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import words

ORDER = 3
#: Bytes of text in a block; small inputs have smaller blocks, up to ``LEAST_BLOCKS``, so that there is work for all cores.
BLOCK_BYTES, LEAST_BYTES, LEAST_BLOCKS, RANGE_BLOCKS = 12 << 20, 1 << 20, 32, 3
SEGMENT = 512
END = np.uint64(0x5BF0A8B1457695E3)
#: History of a text's first token.
START = np.uint64(0x1D8E4E27C47D124F)
ASK = "part long, block int, grams binary, counts binary, kept long"
ANSWER = "part long, block int, counts binary, facts binary"


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and where each text begins."""
    found, sizes = [], []
    table = pa.table({"text": texts})
    for batch in table.to_batches():
        for piece in words.pieces(batch, "text"):
            buf, offsets = words.utf8(piece.column("text"))
            s, e, first = words.spans(buf, offsets, words.SPACED)
            found.append(np.insert(words.hashes(buf, s, e), first[1:], END))
            sizes.append(np.diff(first) + 1)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


class Automaton:
    """Arcs by (state, token), a failure arc for each state but the root, which is state 0 and reads any other token at ``unseen``."""

    def __init__(self, arcs: list[tuple[np.ndarray, ...]], failure: np.ndarray, left: np.ndarray, start: int, unseen: float, warm: int):
        """arcs: what ``sorted_arcs`` gives, for ascending ranges of states; ``left``: weights of failure arcs; ``warm``: tokens that settle the state."""
        self.keys, self.weight, self.target = (np.concatenate(x) for x in zip(*arcs))
        self.failure, self.left, self.start, self.unseen, self.warm = failure, left, start, unseen, warm

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading a token each, and the weights of all arcs taken."""
        state, weight = state.copy(), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) << 32 | token[todo]
            at = np.searchsorted(self.keys, key)
            hit = np.zeros(len(todo), bool)
            inside = at < len(self.keys)
            hit[inside] = self.keys[at[inside]] == key[inside]
            done, at = todo[hit], at[hit]
            weight[done] += self.weight[at]
            state[done] = self.target[at]
            todo = todo[~hit]
            root = state[todo] == 0
            weight[todo[root]] += self.unseen
            todo = todo[~root]
            weight[todo] += self.left[state[todo]]
            state[todo] = self.failure[state[todo]]
        return state, weight

    def walk(self, tokens: np.ndarray, first: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """The weight of each token of the texts that begin at ``first[:-1]``."""
        sizes = np.diff(first)
        parts = -(-sizes // segment)
        text = np.repeat(np.arange(len(sizes)), parts)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        counted = first[:-1][text] + rank * segment
        stop = np.minimum(counted + segment, first[1:][text])
        begin = np.maximum(counted - self.warm, first[:-1][text])
        order = np.argsort(begin - stop, kind="stable")  # the longest first
        begin, counted, length = begin[order], counted[order], (stop - begin)[order]
        state = np.where(begin == first[:-1][text[order]], self.start, 0).astype(np.int64)
        out = np.zeros(len(tokens))
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for t, n in enumerate(live):
            at = begin[:n] + t
            state[:n], weight = self.step(state[:n], tokens[at])
            own = at >= counted[:n]
            out[at[own]] = weight[own]
        return out


def sorted_arcs(state: np.ndarray, token: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    key = state.astype(np.int64) << 32 | token
    order = np.argsort(key)
    return key[order], weight[order], target[order].astype(np.int32)


class Level:
    """The n-grams of a block: ``hashes`` (sorted, distinct), of each position the one that ends there (``index``), a position of each (``at``),
    counts in the block's training texts; then, from the answers, counts in the corpus and whether other blocks hold them."""

    def __init__(self, hashed: np.ndarray, valid: np.ndarray, train: np.ndarray):
        where = np.flatnonzero(valid)
        h = hashed[where]
        order = np.argsort(h)
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        head = np.flatnonzero(new)
        self.hashes, self.at = h[head], where[order[head]].astype(np.int32)
        del h
        self.index = np.full(len(hashed), -1, np.int32)
        self.index[where[order]] = np.cumsum(new, dtype=np.int32) - 1
        self.here = np.add.reduceat(train[where][order].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        self.asked = np.ones(len(head), bool)
        self.count, self.shared = self.here.copy(), np.zeros(len(head), bool)
        self.types = 0


class Block:
    """The texts of a block as tokens and levels of n-grams."""

    def __init__(self, table: pa.Table, order: int):
        self.tokens, self.first = _tokens(table.column("text").combine_chunks())
        sizes = np.diff(self.first)
        self.train = np.repeat(table.column("train").to_numpy().astype(bool), sizes)
        self.since = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.first[:-1].astype(np.int32), sizes)  # tokens before, in the text
        self.order, self.levels = order, [Level(self.tokens, np.ones(len(self.tokens), bool), self.train)]
        self.hashed, self.column = self.tokens, self.tokens

    def grow(self) -> None:
        """The level of the next n. START stands before each text, once."""
        n = len(self.levels) + 1
        self.column = np.concatenate(([START], self.column[:-1]))
        self.column[self.since == 0] = START
        self.hashed = words.mix(self.hashed * np.uint64(0xD6E8FEB86659FD93) + self.column + np.uint64(n))
        level = Level(self.hashed, self.since >= n - 2, self.train)
        if n > 2:
            below = self.levels[-1]
            level.asked = below.shared[below.index[level.at - 1]] & below.shared[below.index[level.at]]
        self.levels.append(level)

    def absorb(self, answers: pa.Table) -> None:
        """Takes in the answers for all levels that they reach, growing them."""
        got: dict[int, list] = {}
        for part, counts, facts in zip(*(answers.column(x).to_pylist() for x in ("part", "counts", "facts"))):
            got.setdefault(part % self.order, []).append((part, counts, facts))
        for n in sorted(got):
            if n == len(self.levels):
                self.grow()
            level, mine = self.levels[n], sorted(got[n])
            found = np.concatenate([_numbers(c) for _, c, _ in mine])
            level.count[level.asked], level.shared[level.asked] = found >> 1, found & 1
            facts = sum(np.frombuffer(f, np.int64) for _, _, f in mine)
            self.total, level.types = (int(facts[0]) if n == 0 else self.total), int(facts[1])

    def ask(self, n: int, ranges: int) -> Iterator[tuple[int, bytes, bytes, int]]:
        """(part, n-grams, training counts, n-grams of training texts that aren't sent) for each range."""
        level = self.levels[n]
        hashed, counts = level.hashes[level.asked], level.here[level.asked]
        kept = int((level.here[~level.asked] > 0).sum())
        cuts = np.searchsorted(hashed, _bounds(ranges))
        for r in range(ranges):
            a, b = cuts[r], cuts[r + 1]
            yield r * self.order + n, _steps(hashed[a:b]), _small(counts[a:b]), kept if r == 0 else 0

    def automaton(self) -> Automaton:
        one = self.levels[0]
        n_words, texts = len(one.hashes), 0
        end = np.searchsorted(one.hashes, END)
        if end < n_words and one.hashes[end] == END:
            texts = int(one.count[end])  # they begin as often as they end
        self.hashed = self.column = None
        # State 0 is the root, state 1 the beginning of a text; then the known n-grams of each level but the last.
        states, n_states = [], 2
        for level in self.levels[: self.order - 1]:
            known = level.count > 0
            states.append(np.where(known, n_states + np.cumsum(known, dtype=np.int32) - 1, 0).astype(np.int32))
            n_states += int(known.sum())
        failure, left = np.zeros(n_states, np.int32), np.zeros(n_states)
        probability = (one.count + 1) / (self.total + one.types + 1)
        known = np.flatnonzero(one.count)
        arcs = [sorted_arcs(np.zeros(len(known), np.int64), known, np.log10(probability[known]), states[0][known] if states else np.zeros(len(known)))]
        for n in range(1, self.order):
            level, below = self.levels[n], self.levels[n - 1]
            prior = level.types / below.types if below.types else 1.0
            mass = lambda count: np.log10(prior / (count + prior))  # noqa: B023, E731
            some = np.flatnonzero(below.count)
            left[states[n - 1][some]] = mass(below.count[some])
            if n == 1:
                left[1] = mass(texts)
            else:
                failure[states[n - 1][some]] = states[n - 2][self.levels[n - 2].index[below.at[some]]]
            known = np.flatnonzero(level.count)
            at = level.at[known]
            history = below.index[at - 1]
            if n == 1:
                opens = self.since[at] == 0
                seen, from_ = np.where(opens, texts, below.count[history]), np.where(opens, 1, states[0][history])
            else:
                seen, from_ = below.count[history], states[n - 1][history]
            log = np.log10((level.count[known] + prior * probability[below.index[at]]) / (seen + prior))
            del history, seen
            if n < self.order - 1:
                probability = np.zeros(len(level.hashes))
                probability[known] = 10.0**log
            target = states[n][known] if n < self.order - 1 else states[n - 1][below.index[at]]
            arcs.append(sorted_arcs(from_, one.index[at], log, target))
        return Automaton(arcs, failure, left, 1 if self.order > 1 else 0, -np.log10(self.total + one.types + 1), self.order - 1)

    def scores(self) -> dict[str, np.ndarray]:
        one, here = self.levels[0], self.levels[0].index
        sums = lambda x: np.add.reduceat(x, self.first[:-1])
        base = np.log10((one.count + 1) / (self.total + one.types + 1))[here]
        weights = self.automaton().walk(here, self.first)
        n = len(self.first) - 1
        return {"n_tokens": np.diff(self.first), "n_known": sums((one.count[here] > 0).astype(np.int64)), "train_tokens": np.full(n, self.total, np.int64), "base_score": sums(base), "score": sums(weights)}


def _bounds(ranges: int) -> np.ndarray:
    return np.array([min(r * (1 << 64) // ranges, (1 << 64) - 1) for r in range(ranges + 1)], dtype=np.uint64)


def _packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, without the planes that are zero throughout, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _steps(sorted_: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return _packed(np.diff(sorted_, prepend=np.uint64(0)))


def _small(x: np.ndarray) -> bytes:
    return _packed(x)


def _numbers(data: bytes) -> np.ndarray:
    return _unpacked(data).astype(np.int64)


def _answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what all blocks send to a range. To each block, in the order of its n-grams: twice the count, plus one if another block has sent it."""
    asked = [row for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in ("block", "grams", "counts", "kept")))]
    keys = [np.cumsum(_unpacked(g), dtype=np.uint64) for _, g, _, _ in asked]
    sizes = [len(k) for k in keys]
    everything = np.concatenate(keys)
    del keys
    order = np.argsort(everything)
    everything = everything[order]
    new = np.ones(len(everything), bool)
    new[1:] = everything[1:] != everything[:-1]
    head = np.flatnonzero(new)
    del everything
    counts = np.concatenate([_numbers(c) for _, _, c, _ in asked])[order]
    total = np.add.reduceat(counts, head) if len(head) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(order)))
    facts = np.array([total.sum(), (total > 0).sum() + sum(k for *_, k in asked)], np.int64).tobytes()  # tokens, types
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(total << 1 | (times > 1), times)
    at = 0
    for (block, *_), size in zip(asked, sizes):
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int64()), pa.array([block], pa.int32()), pa.array([_small(back[at : at + size])], pa.binary()), pa.array([facts], pa.binary())], names=["part", "block", "counts", "facts"])
        at += size


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for each row; the model learns from rows where ``train`` holds."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes), min(LEAST_BLOCKS, -(-size // least_bytes)))
    ranges = max(1, -(-blocks // RANGE_BLOCKS))
    # The partition is in the hash so that rows that repeat don't all meet in one block.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def messages(block: Block, number: int, levels: range) -> pa.Table:
        out = [(part, number, grams, counts, kept) for n in levels for part, grams, counts, kept in block.ask(n, ranges)]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["part", "block", "grams", "counts", "kept"])

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, order)
        if order > 1:
            block.grow()
        return messages(block, key[0].as_py(), range(min(order, 2)))

    def ask_more(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, order)
        block.absorb(answers)
        block.grow()
        n = len(block.levels) - 1
        return messages(block, key[0].as_py(), range(n, n + 1))

    def traverse(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, order)
        block.absorb(answers)
        return pa.table({"doc_id": table.column("doc_id"), "train": table.column("train")} | {k: pa.array(v) for k, v in block.scores().items()})

    answered = dealt.groupBy("block").applyInArrow(ask, ASK).groupBy("part").applyInArrow(_answer, ANSWER)
    for _ in range(2, order):
        more = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(ask_more, ASK)
        answered = answered.unionByName(more.groupBy("part").applyInArrow(_answer, ANSWER))
    schema = f"doc_id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(traverse, schema)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores of all whole ``documents`` texts by a trigram automaton."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, ~held_out(F.col("doc_id"), 7, 2))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
