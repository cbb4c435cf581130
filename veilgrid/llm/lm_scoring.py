"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed trigram model.  Its states are the root, the words, and the bigrams seen at least ``MIN_CONTEXT``
times in training; a state has an arc for each word that followed it there, with the word's log-probability and the
state that comes next (the longest end of what has been read that is a state), and a failure arc to the state that is one
word shorter, with the weight of backing off.  A text is scored in one traversal from left to right that carries the
state: while the state has no arc for the next word the failure arcs are taken and their weights added, at last the root's arc.

Smoothing is Dirichlet's, as of MacKay and Peto: ``p(w | h) = (c(h, w) + m p(w | h')) / (c(h) + m)``, h' being h without its
first word, down to the add-one estimate of words alone.  All counts are exact, and each state's probabilities sum to 1.

No task holds the whole model.  Texts become blocks of token numbers with a block vocabulary.  Blocks learn the
training totals of their own words and bigrams, then of the trigrams that follow a bigram which is a state, through a
combining tree (``totals``); each compiles the automaton of its own n-grams and scores its pieces.  Rows and bytes that
travel grow with the number of blocks (times the levels of the tree), and what a task holds is about a block however frequent a word is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilgrid.llm.workspace import Workspace, slices

#: Counts that the shorter history's estimate weighs as, after a word and after a bigram.
MASS = (4.0, 1.0)
#: A bigram is a state if it was seen so often in training.
MIN_CONTEXT = 2
#: Tokens of a block; a longer text is cut into pieces of that length.
BLOCK = 3 << 18
#: Nodes that combine their counts at a time.
FAN = 256
#: Tokens that are scored one after the other; longer pieces are read in so many lanes.
LANE = 64
#: Texts that are split at a time.
TEXTS = 512
# Local numbers and hashes of the end of a text and of its beginning (a space is in no word).
END, BEGIN = 0, 1
MARKS = (b" end", b" begin")

_U64 = np.dtype("<u8")
_MARKS = np.array([xxh64_intdigest(m) for m in MARKS], _U64)


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, as many as the largest needs, their number last."""
    a = np.ascontiguousarray(numbers, _U64)
    count = -(-int(a.max()).bit_length() // 8) or 1 if len(a) else 1
    planes = np.empty(count * len(a) + 1, np.uint8)
    planes[-1] = count
    for k in range(count):
        planes[k * len(a) : (k + 1) * len(a)] = a.view(np.uint8)[k::8]
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    count = int(planes[-1])
    size = (len(planes) - 1) // count
    a = np.zeros(size, _U64)
    for k in range(count):
        a.view(np.uint8)[k::8] = planes[k * size : (k + 1) * size]
    return a


def pack_sorted(numbers: np.ndarray) -> bytes:
    """The same for an ascending sequence: differences have empty upper planes."""
    return pack(np.diff(numbers, prepend=_U64.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=_U64)


def order_of(numbers: np.ndarray) -> np.ndarray:
    """The stable order that sorts unsigned integers.

    Values with their places in the low bits are sorted, several times faster than places by value; values that
    differ only in bits for which no room is left may come out wrong, which is looked for.
    """
    a = np.ascontiguousarray(numbers, _U64)
    if not len(a):
        return np.zeros(0, np.int64)
    low, places = a.min(), len(a).bit_length()
    over = _U64.type(max(0, int(a.max() - low).bit_length() + places - 64))
    both = a - low
    both >>= over
    both <<= _U64.type(places)
    both |= np.arange(len(a), dtype=_U64)
    both.sort()
    both &= _U64.type((1 << places) - 1)
    order = both.view(np.int64)
    if over and ((ordered := a[order])[1:] < ordered[:-1]).any():
        return np.argsort(a, kind="stable")
    return order


def distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct unsigned integers, sorted; where each is first; and for each of ``numbers`` its place among them."""
    order = order_of(numbers)
    ordered = numbers[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(order), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], inverse


def is_held_out(doc_id: int | None, of: int, rest: int) -> bool:
    """Whether a document isn't learnt from; a null id is written as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of == rest


def ngram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its beginning and its last word."""
    x = first * _U64.type(0x9E3779B97F4A7C15) ^ second
    x = (x ^ (x >> _U64.type(32))) * _U64.type(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U64.type(29))) * _U64.type(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64.type(32))


@dataclass
class Block:
    """Pieces of texts as numbers of a vocabulary of their own.

    A piece begins with the tokens it only reads as context (``leads`` of them): the beginning of the text, or the last two of the piece before.
    """

    number: int
    rows: np.ndarray
    ids: list[int | None]
    lengths: np.ndarray
    leads: np.ndarray
    held: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray  # of the vocabulary

    def __post_init__(self) -> None:
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.lengths)
        self.scored = self.place >= np.repeat(self.leads, self.lengths)
        self.learnt = self.scored & ~np.repeat(self.held, self.lengths)

    def words(self) -> np.ndarray:
        """How often each word is learnt; for the beginning, the texts."""
        n = np.bincount(self.tokens[self.learnt], minlength=len(self.hashes))
        n[BEGIN] = int((~self.held & (self.leads == 1)).sum())
        return n

    def bigrams(self) -> Ngrams:
        at = np.flatnonzero(self.place >= 1).astype(np.int32)
        return Ngrams.of(self.tokens[at - 1], self.hashes, at, self)

    def trigrams(self, bigrams: Ngrams, state: np.ndarray) -> Ngrams:
        """Those after a bigram that is a state."""
        at = np.flatnonzero(self.scored & (self.place >= 2)).astype(np.int32)
        context = bigrams.number[at - 1]
        follows = state[context]
        return Ngrams.of(context[follows], bigrams.keys, at[follows], self)


@dataclass
class Ngrams:
    """Distinct n-grams of a block: their codes, sorted; their hashes; how often each is learnt; a token at which each ends; the number of that which ends at a token, or -1."""

    codes: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    ends: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, hashes: np.ndarray, at: np.ndarray, block: Block) -> Ngrams:
        """Those that end at the tokens ``at``; context: numbers of what is before these tokens, hashes: of all numbers."""
        every, first, inverse = distinct(context * np.int64(len(block.hashes)) + block.tokens[at])
        number = np.full(len(block.tokens), -1, np.int32)
        number[at] = inverse
        ends = at[first]
        keys = ngram_keys(hashes[context[first]], block.hashes[block.tokens[ends]])
        return cls(every, keys, np.bincount(inverse[block.learnt[at]], minlength=len(every)), ends, number)


def _hashed_tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its beginning, its words and its end."""
    split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    words = split.flatten()
    real = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty one, and so does an empty text
    sizes = np.add.reduceat(real.astype(np.int64), split.offsets.to_numpy()[:-1] - split.offsets[0].as_py())
    words = words.dictionary_encode()
    hashes = np.array([xxh64_intdigest(w) for w in words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)], _U64)
    ends = np.cumsum(sizes + 2)
    tokens = np.empty(int(ends[-1]), _U64)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = inner[ends - sizes - 2] = False
    tokens[ends - 1], tokens[ends - sizes - 2] = _MARKS[END], _MARKS[BEGIN]
    tokens[inner] = hashes[words.indices.to_numpy()[real]]
    for size, end in zip((sizes + 2).tolist(), ends.tolist(), strict=True):
        yield tokens[end - size : end]


_BLOCK = "block long, rows binary, ids array<long>, lengths binary, leads binary, held binary, tokens binary, hashes binary"


def _blocks(source: DataFrame, of: int, rest: int, block: int) -> DataFrame:
    kinds = pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("ids", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("lengths", "leads", "held", "tokens", "hashes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, row = TaskContext.get().partitionId() << 32, 0, TaskContext.get().partitionId() << 32
        rows, ids, leads, parts, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            words = pa.array(np.concatenate([_MARKS, *parts])).dictionary_encode()  # numbers in the order of appearance
            out = {
                "block": base + n, "rows": pack(np.array(rows)), "ids": ids, "lengths": pack(np.array([len(p) for p in parts])), "leads": pack(np.array(leads)),
                "held": pack(np.array([is_held_out(i, of, rest) for i in ids])), "tokens": pack(words.indices.to_numpy()[len(_MARKS) :]), "hashes": words.dictionary.to_numpy().tobytes(),
            }
            return pa.RecordBatch.from_pylist([out], schema=kinds)

        for batch in slices(batches, TEXTS):
            for i, found in zip(batch.column(0).to_pylist(), _hashed_tokens(batch.column(1)), strict=True):
                for at in range(1, len(found), block):  # a text of any length, so many tokens at a time
                    lead = 1 if at == 1 else 2
                    piece = found[at - lead : at + block]
                    if size and size + len(piece) > block:
                        yield flush()
                        n, rows, ids, leads, parts, size = n + 1, [], [], [], [], 0
                    rows.append(row)
                    ids.append(i)
                    leads.append(lead)
                    parts.append(piece)
                    size += len(piece)
                row += 1
        if size:
            yield flush()

    return source.mapInArrow(run, _BLOCK)


def _block_of(row: dict) -> Block:
    number = lambda c: unpack(row[c]).astype(np.int64)
    return Block(row["block"], number("rows"), row["ids"], number("lengths"), number("leads"), number("held").astype(bool), number("tokens"), np.frombuffer(row["hashes"], _U64))


# Totals of sparse counts by a combining tree.

_ASKED = "prefix long, node long, kind long, keys binary, counts binary"
_ANSWER = "prefix long, node long, kind long, range long, sums binary"
_SENT = "to_prefix long, to_node long, kind long, prefix long, node long, range long, keys binary, counts binary, sums binary"


def _asked(prefix: int, node: int, kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = order_of(keys)
    return pa.record_batch([[prefix], [node], [kind], [pack_sorted(keys[order])], [pack(counts[order])]], names=[c.split()[0] for c in _ASKED.split(", ")])


def totals(ws: Workspace, asked: DataFrame, nodes: int, fan: int = FAN, used: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sums over all nodes: ``(answers, stats)`` of ``asked`` (sorted hashes with counts of each node and kind).

    Each node's keys are cut into ranges; groups of about ``fan`` nodes combine their counts range by range; the groups'
    sums go the same way, until one group is left.  Totals come back along the same edges, in the order of the keys asked.
    A node sends ``fan`` rows at most whatever the number of nodes, levels are the logarithm of it, and a key that every
    node has is combined ``fan`` at a time.  answers: rows ``(prefix, node, kind, range, sums)``, to be put together by range;
    stats: ``(kind, types)``, distinct keys with a count in parts.  used: bits of the keys that nodes at this level share.
    """
    groups, bits = max(1, -(-nodes // fan)), max(0, min(nodes, fan) - 1).bit_length()
    names = [c.split()[0] for c in _SENT.split(", ")]
    kinds = pa.schema([(c, pa.binary() if c in ("keys", "counts", "sums") else pa.int64()) for c in names])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for r in batch.to_pylist():
                keys, counts = unpack_sorted(r["keys"]), unpack(r["counts"])
                part = (keys << _U64.type(used)) >> _U64.type(64 - bits) if bits else np.zeros(len(keys), _U64)
                at = np.searchsorted(part, np.arange((1 << bits) + 1, dtype=_U64))
                group = xxh64_intdigest(str(r["node"])) % groups
                out = [
                    {"to_prefix": r["prefix"] << bits | p, "to_node": group, "kind": r["kind"], "prefix": r["prefix"], "node": r["node"], "range": p, "keys": pack_sorted(keys[at[p] : at[p + 1]]), "counts": pack(counts[at[p] : at[p + 1]])}
                    for p in np.flatnonzero(np.diff(at)).tolist()
                ]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    def combined(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Each row's keys, all of them, and for each of the rows' keys its place among all."""
        keys = [unpack_sorted(r["keys"]) for r in rows]
        every, _, inverse = distinct(np.concatenate(keys))
        return keys, every, inverse

    def sums(rows: list[dict], every: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return np.bincount(inverse, weights=np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.float64), minlength=len(every)).astype(np.int64)

    def answer(rows: list[dict], keys: list[np.ndarray], inverse: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(k) for k in keys])
        sums = [pack(total[inverse[end - len(k) : end]]) for k, end in zip(keys, ends.tolist(), strict=True)]
        yield pa.record_batch([[r[c] for r in rows] for c in ("prefix", "node", "kind", "range")] + [sums], names=["prefix", "node", "kind", "range", "sums"])

    def up(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        _, every, inverse = combined(rows)
        yield _asked(rows[0]["to_prefix"], rows[0]["to_node"], rows[0]["kind"], every, sums(rows, every, inverse))

    def down(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = [r for r in rows if r["sums"] is None]
        keys, _, inverse = combined(own)
        yield from answer(own, keys, inverse, np.concatenate([unpack(r["sums"]).astype(np.int64) for r in rows if r["sums"] is not None]))

    def whole(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys, every, inverse = combined(rows)
        total = sums(rows, every, inverse)
        types = int(((total > 0) & (every != _MARKS[BEGIN])).sum())
        yield pa.record_batch([[-1], [-1], [rows[0]["kind"]], [types], [None]], schema=pa.schema([(c, pa.binary() if c == "sums" else pa.int64()) for c in ("prefix", "node", "kind", "range", "sums")]))
        yield from answer(rows, keys, inverse, total)

    def by_node(work, sent: DataFrame, schema: str) -> DataFrame:
        keys = ["to_prefix", "to_node", "kind"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            for batch in slices(batches):
                for row in batch.to_pylist():
                    if (now := tuple(row[c] for c in keys)) != key:
                        if held:
                            yield from work(held)
                        key, held = now, []
                    held.append(row)
            if held:
                yield from work(held)

        return sent.repartition(*keys).sortWithinPartitions(*keys, F.col("sums").isNotNull(), "node", "prefix", "range").mapInArrow(run, schema)

    sent = asked.mapInArrow(split, _SENT)
    if groups == 1:
        every = ws.table(by_node(whole, sent, _ANSWER), "answers")
        return every.where("node >= 0"), every.where("node < 0").select("kind", F.col("range").alias("types"))
    sent = ws.table(sent, "sent")
    higher, stats = totals(ws, ws.table(by_node(up, sent, _ASKED), "combined"), groups, fan, used + bits)
    back = higher.select(F.col("prefix").alias("to_prefix"), F.col("node").alias("to_node"), "kind", "range", "sums")
    return ws.table(by_node(down, sent.unionByName(back, allowMissingColumns=True).select(*names), _ANSWER), "answers"), stats


@dataclass
class Automaton:
    """States are numbers, 0 is the root, which has an arc for every word."""

    width: int  # words
    arcs: np.ndarray  # sorted state * width + word
    weights: np.ndarray
    targets: np.ndarray
    failure: np.ndarray  # weight by state
    back: np.ndarray  # state after a failure
    root: np.ndarray  # weight by word
    first: np.ndarray  # state after the root's arc by word

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word from each state: weights and next states."""
        gained, now, after = np.zeros(len(states)), states.copy(), np.empty_like(states)
        left = np.arange(len(states))
        while len(left):
            s, w = now[left], words[left]
            done = s == 0
            at = left[done]
            gained[at] += self.root[w[done]]
            after[at] = self.first[w[done]]
            left, s, w = left[~done], s[~done], w[~done]
            if not len(left):
                break
            keys = s * self.width + w
            order = order_of(keys)  # neighbours among the arcs are looked up one after the other
            left, s, keys = left[order], s[order], keys[order]
            place = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
            hit = self.arcs[place] == keys if len(self.arcs) else np.zeros(len(keys), bool)
            gained[left[hit]] += self.weights[place[hit]]
            after[left[hit]] = self.targets[place[hit]]
            left, s = left[~hit], s[~hit]
            gained[left] += self.failure[s]
            now[left] = self.back[s]
        return gained, after

    def scores(self, block: Block, lane: int = LANE) -> np.ndarray:
        """Log10 probability of every piece of a block, left to right, many pieces abreast.

        Long pieces go in lanes, each of which first reads the two tokens before it; these fix its state.
        """
        piece = np.repeat(np.arange(len(block.lengths)), np.maximum(1, -(-(block.lengths - block.leads) // lane)))
        turn = np.arange(len(piece)) - np.searchsorted(piece, piece)
        start = block.starts[piece] + block.leads[piece] + turn * lane
        steps = np.minimum(block.starts[piece] + block.lengths[piece] - start, lane)
        order = np.argsort(-steps, kind="stable")
        start, steps, piece, turn = start[order], steps[order], piece[order], turn[order]
        states = np.zeros(len(piece), np.int64)
        fresh = (turn == 0) & (block.leads[piece] == 1)
        states[fresh] = self.first[BEGIN]
        warm = np.flatnonzero(~fresh)
        for back in (2, 1):
            _, states[warm] = self.step(states[warm], block.tokens[start[warm] - back])
        total = np.zeros(len(piece))
        for k in range(int(steps[0]) if len(steps) else 0):
            n = int(np.searchsorted(-steps, -k))  # lanes with a word left
            gained, states[:n] = self.step(states[:n], block.tokens[start[:n] + k])
            total[:n] += gained
        return np.bincount(piece, weights=total, minlength=len(block.lengths))


def compile_automaton(words: np.ndarray, bigrams: Ngrams, pairs: np.ndarray, trigrams: Ngrams, triples: np.ndarray, n: int, v: int) -> Automaton:
    """words, pairs, triples: training totals of the block's words (of the beginning: texts), bigrams and trigrams."""
    width = len(words)
    p1 = (words + 1) / (n + v + 1)
    contexts = words.copy()
    contexts[END] = 0
    word_state = np.where(contexts > 0, np.arange(1, width + 1, dtype=np.int32), np.int32(0))
    a, b = bigrams.codes // width, bigrams.codes % width
    p2 = (pairs + MASS[0] * p1[b]) / (contexts[a] + MASS[0])
    own = is_state(bigrams, pairs, width)
    after = np.where(own, np.arange(1 + width, 1 + width + len(own), dtype=np.int32), word_state[b])  # state that a bigram leaves
    two = np.flatnonzero(pairs > 0)
    context, w = trigrams.codes // width, trigrams.codes % width
    last = bigrams.number[trigrams.ends]  # the bigram of the last two words is in the block too
    three = np.flatnonzero(triples > 0)
    weights3 = (triples[three] + MASS[1] * p2[last[three]]) / (pairs[context[three]] + MASS[1])
    arcs = np.concatenate([(1 + a[two]) * width + b[two], (1 + width + context[three]) * width + w[three]])
    failure, back = np.zeros(1 + width + len(own)), np.zeros(1 + width + len(own), np.int32)
    failure[1 : 1 + width] = np.log10(MASS[0] / (contexts + MASS[0]))
    failure[1 + width :] = np.log10(MASS[1] / (pairs + MASS[1]))
    back[1 + width :] = word_state[b]
    # both parts are sorted, and the second's states are higher
    return Automaton(width, arcs, np.log10(np.concatenate([p2[two], weights3])), np.concatenate([after[two], after[last[three]]]), failure, back, np.log10(p1), word_state)


def is_state(bigrams: Ngrams, pairs: np.ndarray, width: int) -> np.ndarray:
    """Which bigrams are states: learnt often enough, and not the end of a text."""
    return (pairs >= MIN_CONTEXT) & (bigrams.codes % width != END)


def _meet(blocks: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """``work(block, sums by kind)`` for every block with what it was answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got = None, {}

        def settle() -> Iterator[pa.RecordBatch]:
            yield from work(block, {k: np.concatenate(got.pop(k)).astype(np.int64) for k in list(got)})

        for batch in slices(batches):
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if block:
                        yield from settle()
                    block, got = _block_of(row), {}
                else:
                    got.setdefault(row["kind"], []).append(unpack(row["sums"]))
        if block:
            yield from settle()

    own = blocks.withColumns({"kind": F.lit(0).cast("long"), "range": F.lit(0).cast("long"), "sums": F.lit(None).cast("binary")})
    theirs = answers.select(F.col("node").alias("block"), "kind", "range", "sums")
    return own.unionByName(theirs, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "range").mapInArrow(run, schema)


def _ordered(keys: np.ndarray, sums: np.ndarray | None) -> np.ndarray:
    """Sums that came in the order of the sorted keys, in that of ``keys``."""
    out = np.zeros(len(keys), np.int64)
    if sums is not None:
        out[order_of(keys)] = sums
    return out


def _ask_words_and_bigrams(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                b = _block_of(row)
                yield _asked(0, b.number, 1, b.hashes, b.words())
                pairs = b.bigrams()
                yield _asked(0, b.number, 2, pairs.keys, pairs.counts)

    return blocks.mapInArrow(run, _ASKED)


def _ask_trigrams(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    def work(b: Block, got: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = b.bigrams()
        triples = b.trigrams(pairs, is_state(pairs, _ordered(pairs.keys, got.get(2)), len(b.hashes)))
        if len(triples.keys):
            yield _asked(0, b.number, 3, triples.keys, triples.counts)

    return _meet(blocks, answers.where("kind = 2"), work, _ASKED)


_SCORE = "row long, id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _automaton(b: Block, words: np.ndarray, got: dict[int, np.ndarray], n: int, v: int) -> Automaton:
    """That of a block; its n-grams and the sums (taken from ``got``) go when it is made."""
    bigrams = b.bigrams()
    pairs = _ordered(bigrams.keys, got.pop(2, None))
    trigrams = b.trigrams(bigrams, is_state(bigrams, pairs, len(words)))
    return compile_automaton(words, bigrams, pairs, trigrams, _ordered(trigrams.keys, got.pop(3, None)), n, v)


def _score(blocks: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """Scores of every piece of a text."""

    def work(b: Block, got: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = _ordered(b.hashes, got.pop(1, None))
        columns = [
            pa.array(b.rows), pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lengths - b.leads), pa.array(np.add.reduceat((b.scored & (words > 0)[b.tokens]).astype(np.int64), b.starts)), pa.array(np.full(len(b.rows), n)),
            pa.array(np.add.reduceat(np.where(b.scored, np.log10((words + 1) / (n + v + 1))[b.tokens], 0.0), b.starts)), pa.array(_automaton(b, words, got, n, v).scores(b)),
        ]
        yield pa.record_batch(columns, names=[c.split()[0] for c in _SCORE.split(", ")])

    return _meet(blocks, answers, work, _SCORE)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: int = 7, rest: int = 2, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Documents whose CRC-32 of the id modulo ``of`` is ``rest`` are held out: scored, not learnt from.
    Null and blank texts are one token, the end.  Rows with a null id are scored like others
    (their id counts as an empty text); repeated rows are learnt from and scored each; an
    empty table gives no rows.  Without any training text every token is unknown.  A text of more than a block is
    scored in pieces, each of which reads the two tokens before it.
    """
    ws = Workspace(docs.sparkSession, "lm")
    blocks = ws.table(_blocks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")), of, rest, block), "blocks")
    nodes, n = blocks.count(), int(_learnt(blocks).agg(F.sum("learnt")).first()[0] or 0)
    first, stats = totals(ws, _ask_words_and_bigrams(blocks), nodes, fan)
    v = int(stats.where("kind = 1").agg(F.sum("types")).first()[0] or 0)
    second, _ = totals(ws, ws.table(_ask_trigrams(blocks, first), "trigrams"), nodes, fan)
    pieces = ws.table(_score(blocks, first.union(second), n, v), "scores")
    whole = [F.sum(c).alias(c) for c in ("n_tokens", "n_known")] + [F.first("train_tokens").alias("train_tokens")] + [F.sum(c).alias(c) for c in ("base_score", "score")]
    return pieces.groupBy("row", "id", "held_out").agg(*whole).drop("row")


def _learnt(blocks: DataFrame) -> DataFrame:
    """Tokens of each block that are learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, leads, held = ([unpack(x.as_py()).astype(np.int64) for x in batch.column(k)] for k in range(3))
            yield pa.record_batch([pa.array([int((n - k)[h == 0].sum()) for n, k, h in zip(lengths, leads, held, strict=True)], pa.int64())], names=["learnt"])

    return blocks.select("lengths", "leads", "held").mapInArrow(run, "learnt long")
