"""Phrases whose words stand together more often than chance has it, by hash-filtered frequent n-grams.

Counting goes by length (Park, Chen and Yu).  A pass over the corpus counts the n-grams of one length exactly and, in the same
reading, the n-grams that are one word longer by hash bucket.  The next pass counts only those n-grams

* whose bucket holds ``least`` n-grams or more (the buckets' bitmap is broadcast), and
* whose two parts one word shorter are frequent (Apriori); a second bitmap holds the hashes of all frequent n-grams of that length.

Both bitmaps have a fixed size, whatever the corpus; a false hit costs work and never a wrong count, since the exact counts decide.
Buckets count up to ``least`` only, one byte each where that will do, so a task sends a fixed amount.

The text is split into words once, into blocks of words by number, with each block's own list of words.  Phrases leave a task as
strings with their count in a block, and Spark adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilgrid.llm.workspace import Workspace, slices

MOST_WORDS, LEAST_COUNT, TOP = 5, 100, 2000
#: Logarithms of the number of hash buckets that are counted (13 at least) and of the bits of the bitmap of frequent n-grams (6 at least).
BUCKET_BITS, FREQUENT_BITS = 22, 24
#: Words of a block, and the number of parts in which buckets are summed.
BLOCK, PARTS = 1 << 20, 1024
#: Parts in which a language's candidates are ranked before they meet.
LANES = 16

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Separators become line feeds, tabs become spaces.
_PLAIN = bytes.maketrans(_SEPARATORS + b"\t", b"\n" * len(_SEPARATORS) + b" ")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_PASS = "lang string, phrase string, h long, n long, part int, counts binary"


class _Numbers(dict):
    """Numbers of words in the order of their first use; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _tokens(text: bytes) -> list[bytes]:
    """Words and line feeds, which end pieces; empty ones among them."""
    return text.lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")  # bytes: A-Z only are lowered


def blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = BLOCK) -> DataFrame:
    """``(lang, words, ids)``: blocks of texts of one language; ids: 32-bit places in words, 0 at each end of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        held: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            numbers, parts = open_.pop(lang)
            del held[lang]
            words = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
            columns = [pa.array([lang]), pa.ListArray.from_arrays([0, len(words)], words), pa.array([np.concatenate(parts).tobytes()], pa.binary())]
            return pa.record_batch(columns, names=["lang", "words", "ids"])

        for batch in slices(batches):
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if lang not in open_:
                    open_[lang] = (_Numbers({b"\n": 0}), [])
                numbers, parts = open_[lang]
                tokens = _tokens(t.as_py() + b"\n")
                ids = np.array([numbers[w] for w in tokens if w], np.int32)
                parts.append(ids)
                held[lang] = held.get(lang, 0) + len(ids)
                if held[lang] >= size:
                    yield close(lang)
                elif sum(held.values()) >= 4 * size:  # many languages
                    yield close(max(held, key=held.get))
        for lang in list(open_):
            yield close(lang)

    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return source.mapInArrow(run, "lang string, words array<string>, ids binary")


def _joined(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their first part and last word."""
    x = (h ^ (h >> np.uint64(29))) * _MIX[1] + last * _MIX[0]
    return x ^ (x >> np.uint64(32))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class _Block:
    """One block's n-grams: hashes and places, one length after the other."""

    def __init__(self, lang: str, words: pa.Array, ids: bytes):
        self.words, self.ids = words, np.frombuffer(ids, np.int32)
        seed = xxh64_intdigest(lang.encode())
        one = np.fromiter((xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
        self.one = np.concatenate([np.zeros(1, np.uint64), one])[self.ids]
        self.length, self.h, self.whole = 1, self.one, self.ids > 0

    def longer(self) -> None:
        """n-grams of one word more: the first ones but for the last, the last word after each."""
        k = self.length
        self.h, self.whole = _joined(self.h[:-1], self.one[k:]), self.whole[:-1] & (self.ids[k:] > 0)
        self.length = k + 1

    def counted(self, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Phrases, hashes and counts of the n-grams at the places."""
        at = at[np.argsort(self.h[at], kind="stable")]
        rows = np.stack([self.ids[at + i] for i in range(self.length)])
        # where the words change, not where the hash does: n-grams of one hash may come in several rows, never in one
        first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])) if len(at) else at
        parts = [self.words.take(pa.array(r[first] - 1)) for r in rows]
        phrases = pc.binary_join_element_wise(*parts, " ") if self.length > 1 else parts[0]
        return phrases, self.h[at[first]], np.diff(np.append(first, len(at)))


def _pass(ws: Workspace, blocks: DataFrame, k: int, most: int, least: int, bits: tuple[int, int], shared: tuple | None) -> DataFrame:
    """Partial counts of the n-grams of k words that may be frequent, and sums of the buckets of those one word longer.

    shared: the broadcast bitmaps ``(buckets of k words, frequent n-grams of k - 1 words)``.
    """
    small = np.uint8 if least <= 255 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits[0], np.uint32) if k < most else None
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            for r in range(batch.num_rows):
                lang = batch.column(0)[r].as_py()
                b = _Block(lang, batch.column(1)[r].values, batch.column(2)[r].as_py())
                for _ in range(k - 2):
                    b.longer()
                if k == 1:
                    maybe = b.whole
                else:
                    before = b.h
                    b.longer()
                    at = np.flatnonzero(b.whole)
                    at = at[_has(shared[0].value, _bucket(b.h[at], bits[0]))]
                    at = at[_has(shared[1].value, _bucket(before[at], bits[1]))]
                    at = at[_has(shared[1].value, _bucket(before[at + 1], bits[1]))]  # the second part begins one place later
                    maybe = np.zeros(len(b.h), bool)
                    maybe[at] = True
                phrases, h, n = b.counted(np.flatnonzero(maybe))
                for a in range(0, len(phrases), 1 << 16):
                    z = min(len(phrases), a + (1 << 16))
                    none = pa.nulls(z - a)
                    yield pa.record_batch([pa.array([lang] * (z - a)), phrases.slice(a, z - a), pa.array(h[a:z].view(np.int64)), pa.array(n[a:z]), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
                if sums is not None and len(b.h) > 1:
                    b.longer()
                    both = b.whole & maybe[:-1] & maybe[1:]
                    np.add.at(sums, _bucket(b.h[both], bits[0]), 1)
        if sums is not None:
            for part, piece in enumerate(np.split(np.minimum(sums, least).astype(small), PARTS)):
                if piece.any():
                    yield pa.record_batch([pa.nulls(1).cast(f.type) if f.name not in ("part", "counts") else pa.array([part if f.name == "part" else piece.tobytes()], f.type) for f in schema], schema=schema)

    return ws.table(blocks.mapInArrow(run, _PASS), f"pass{k}")


def _bucket_bitmap(rows: DataFrame, bits: int, least: int, tasks: int) -> np.ndarray:
    """Bits of the buckets whose sum is ``least`` or more; a task adds up the parts that come to it one by one."""
    small = np.uint8 if least <= 255 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                piece = np.frombuffer(counts.as_py(), small).astype(np.uint32)
                sums[part] = np.minimum(sums[part] + piece, least) if part in sums else piece
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x >= least).tobytes() for x in sums.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8).reshape(PARTS, -1)
    parts = rows.where("part is not null").select("part", "counts").repartition(tasks, "part")
    found = parts.mapInArrow(run, "part int, bits binary").toArrow()  # PARTS rows at most, of fixed size in all
    for part, piece in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[part] = np.frombuffer(piece, np.uint8)
    return out.reshape(-1)


def _frequent_bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of ``frequent(h)``."""
    at = F.shiftrightunsigned("h", 64 - bits)
    words = frequent.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) % 64 as int))")).alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.toArrow()  # 2 ** (bits - 6) rows at most
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


def frequent_phrases(ws: Workspace, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST_COUNT, bits: tuple[int, int] = (BUCKET_BITS, FREQUENT_BITS)) -> tuple[list[DataFrame], DataFrame]:
    """Exact counts ``(lang, phrase, n)`` of all frequent n-grams, a table for each length, and ``(lang, n)`` of all words."""
    sc = ws.spark.sparkContext
    held = ws.table(blocks(docs, text_col, lang_col), "blocks")
    tasks = min(64, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    tables, totals, shared = [], None, None
    for k in range(1, most + 1):
        rows = _pass(ws, held, k, most, least, bits, shared)
        counts = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.min("h").alias("h"), F.sum("n").alias("n"))
        if k == 1:
            totals = ws.table(rows.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        tables.append(ws.table(counts.where(F.col("n") >= least), f"frequent{k}"))
        if k < most:
            old, shared = shared, (sc.broadcast(_bucket_bitmap(rows, bits[0], least, tasks)), sc.broadcast(_frequent_bitmap(tables[-1], bits[1])))
            for b in old or ():
                b.unpersist()
        ws.drop(rows)
    ws.drop(held)
    return [t.drop("h") for t in tables], totals


def _cut_scores(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, phrase, words, a, l, r, n, score)``: the cut of the least score of each candidate, the first on a tie."""
    w = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.col("words")), " ").alias("rest"))
    side = lambda phrase, n: counts.select("lang", F.col("phrase").alias(phrase), F.col("n").alias(n))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    # a language's total meets its candidates in parts
    cuts = cuts.withColumn("lane", F.pmod(F.hash("phrase"), F.lit(LANES)))
    cuts = cuts.join(totals.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))), ["lang", "lane"])
    # a <= l and n < 10^19: 1000 a n and l r have 38 digits at most
    score = F.expr("(cast(a as decimal(15,0)) * 1000 * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a", "n").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def _inside_longer(candidates: DataFrame, percent: int) -> DataFrame:
    """``(lang, phrase)`` of the candidates that stand inside a longer one of a count that is near enough.

    One word longer suffices: what lies between a candidate and a longer one is frequent too, and at least as often as that.
    """
    w, n = F.split("phrase", " "), F.col("words")
    parts = F.array(F.array_join(F.slice(w, F.lit(1), n - 1), " "), F.array_join(F.slice(w, F.lit(2), n - 1), " "))
    longer = candidates.where("words > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    return candidates.join(longer, ["lang", "phrase"]).where(100 * F.col("b") >= percent * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, percent: int = 100, bits: tuple[int, int] = (BUCKET_BITS, FREQUENT_BITS)) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    A is a phrase's count, l and r those of the two parts at the cut of the least score, n the language's words, and the
    score floor(1000 a n / (l r)).  Phrases inside a longer candidate with ``percent`` of their count go.  Letters A-Z are
    lowered, texts end pieces at ``.,;:!?`` and line ends, words at spaces and tabs.  Null texts have no words, a null language
    is ``und``; rows that repeat count as often; no candidate and an empty table give no rows; other columns aren't read.
    """
    ws = Workspace(docs.sparkSession, "collocations")
    tables, totals = frequent_phrases(ws, docs, text_col, lang_col, most, least, bits)
    counts, candidates = tables[0], None
    for k, t in enumerate(tables[1:], 2):
        own = t.select("lang", "phrase", F.lit(k).alias("words"), F.col("n").alias("a"))
        candidates = own if candidates is None else candidates.union(own)
        counts = counts.union(t) if k < most else counts
    candidates = ws.table(candidates, "candidates")
    counts = ws.table(counts, "counts")
    scored = _cut_scores(candidates.join(_inside_longer(candidates, percent), ["lang", "phrase"], "left_anti"), counts, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best are among the best of its parts
    some = scored.withColumn("lane", F.pmod(F.hash("phrase"), F.lit(LANES)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
