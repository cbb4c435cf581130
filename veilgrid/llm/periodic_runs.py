"""Periodic runs of words: stretches that repeat themselves with one period, found whole and exactly.

A run is a stretch of consecutive words whose smallest period is q, of ``exponent`` periods and ``min_length`` words at least,
that no neighbouring word extends with this period.  Every text is searched by itself, where it is read, in two steps:

* Repeated k-gram masking.  A run of length L and period q holds its first L - q words again q words later, so each of its
  words lies in a k-gram found twice in the text, k being the least L - q that a run may have (16 for 24 words and 3 periods).
  All other words can't join runs.  Grams are compared by hash here: chance agreement only leaves a word in.
* Main and Lorentz on the segments that are left.  A segment is halved again and again; at each middle and for each period, the
  common extension of the two places one period apart, to the right and to the left, gives the run across the middle.
  Extensions are read from tables of names of all stretches of 1, 2, 4, ... words, which are exact.  All middles of one depth are
  worked on together.

A segment of n words costs n log n extensions and 4 n log n bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.workspace import WORD, fresh, slices

MIN_LENGTH, EXPONENT = 24, 3

_BASE = 0x9E3779B97F4A7C15
_RUN = "array<struct<start: long, length: long, period: long>>"


def gram_length(min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> int:
    """The least overlap of a run with itself one period later; exponent is 2 at least."""
    return min(max(min_length, exponent * q) - q for q in range(1, max(2, min_length + 1)))


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k words from each place on, by doubling."""
    part, size, power = codes.astype(np.uint64), 1, _BASE
    out, have = None, 0
    while k:
        if k & 1:
            out = part if out is None else out[: len(part) - have] * np.uint64(power) + part[have:]
            have += size
        k >>= 1
        if k:
            part = part[:-size] * np.uint64(power) + part[size:]
            size, power = 2 * size, power * power % (1 << 64)
    return out


def repeated_grams(codes: np.ndarray, k: int) -> np.ndarray | None:
    """Marks of the words inside k-grams found twice or more; None if there is no such gram."""
    if len(codes) <= k:
        return None
    h = _gram_hashes(codes, k)
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return None
    counts = np.concatenate([[0], np.cumsum(np.isin(h, again))])
    at = np.arange(len(codes))
    return counts[np.minimum(at + 1, len(h))] > counts[np.maximum(at + 1 - k, 0)]


def _names(codes: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words: a number for the stretch from each place on, equal for equal stretches."""
    out, size = [codes.astype(np.int32)], 1
    while 2 * size <= len(codes):
        last = out[-1].astype(np.int64)
        pairs = last[:-size] * (int(last.max()) + 1) + last[size:]
        out.append(np.unique(pairs, return_inverse=True)[1].reshape(-1).astype(np.int32))
        size *= 2
    return out


def _extension(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words are equal from a and b on (a < b), or before them."""
    n, a, b = len(names[0]), a.copy(), b.copy()
    first = a.copy()
    for j in range(len(names) - 1, -1, -1):
        size = 1 << j
        i = np.flatnonzero(b + size <= n if ahead else a >= size)
        i = i[names[j][a[i]] == names[j][b[i]]] if ahead else i[names[j][a[i] - size] == names[j][b[i] - size]]
        a[i] += size if ahead else -size
        b[i] += size if ahead else -size
    return np.abs(a - first)


def main_lorentz(codes: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of small numbers, by start and period."""
    n, found = len(codes), []
    if n < min_length:
        return []
    names = _names(codes)
    # the equal words on one side of the middle are half of the least overlap at least
    j = min(len(names) - 1, max(0, ((gram_length(min_length, exponent) + 1) // 2).bit_length() - 1))
    half = 1 << j
    lo, hi = np.array([0]), np.array([n])
    while len(lo):
        mid, most = (lo + hi) // 2, (hi - lo) // exponent
        middle = np.repeat(mid, most)
        q = np.arange(len(middle)) - np.repeat(np.cumsum(most) - most, most) + 1
        for a, b, period in ((middle, middle + q, q), (middle - q, middle, q)):
            ahead, before = b + half <= n, a >= half
            near = np.zeros(len(a), bool)
            near[ahead] = names[j][a[ahead]] == names[j][b[ahead]]
            near[before] |= names[j][a[before] - half] == names[j][b[before] - half]
            a, b, period = a[near], b[near], period[near]
            back = _extension(names, a, b, False)
            length = back + _extension(names, a, b, True) + period
            long = length >= np.maximum(min_length, exponent * period)
            found.append(np.stack([a - back, length, period], 1)[long])
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        wide = hi - lo >= min_length
        lo, hi = lo[wide], hi[wide]
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    if len(rows):  # a stretch has one period, its smallest
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return [tuple(r) for r in rows.tolist()]


def word_runs(words: list, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a list of words, by start and period."""
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    inside = repeated_grams(codes, gram_length(min_length, exponent))
    if inside is None:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    found = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= min_length:
            number: dict = {}
            exact = np.array([number.setdefault(w, len(number)) for w in words[a:b]])
            found += [(a + s, n, q) for s, n, q in main_lorentz(exact, min_length, exponent)]
    return found


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``(id, runs, collapsed)`` for every row: all runs by start and period, and the text with one period of each run.

    Words are stretches without ASCII white space, compared as they are and joined by one space in ``collapsed``.  Null, empty
    and blank texts have no runs and an empty ``collapsed``; null ids and repeated rows stay; an empty table
    gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches):
            found, texts = [], []
            for t in batch.column(1).cast(pa.binary()):
                words = (t.as_py() or b"").split()  # bytes: ASCII white space only
                runs = word_runs(words, min_length, exponent)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(kept_words(words, runs) if runs else words))
            yield pa.record_batch([batch.column(0), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, f"id long, runs {_RUN}, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, a tenth of them made periodic from some word on, by the checksum of their id.

    Of a text with n > 0 words whose id's CRC-32 h is a multiple of 10, each word i >= a becomes the word a + (i - a) % p, where g = h div 10,
    a = g % n, p = 1 + (n - a) div (3 + g % 8).  Other texts, nulls among them, and those of null ids stay as they are.
    """
    words_at, h_at, a_at = fresh(docs, "words", "h", "a")
    h, w, a = F.col(h_at), F.col(words_at), F.col(a_at)
    g, n = F.floor(h / 10), F.size(w)
    marked = docs.withColumn(h_at, F.crc32(F.col(id_col).cast("string").cast("binary")))
    split = marked.withColumn(words_at, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))))
    begun = split.withColumn(a_at, F.when(n > 0, (g % n).cast("int")))
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return begun.withColumn(text_col, F.when(a.isNotNull(), text).otherwise(F.col(text_col))).drop(words_at, h_at, a_at)


def longest_repeat(runs: Column) -> Column:
    """The run of the greatest length in periods, the first on a tie; null without runs."""
    more = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of runs, the longest by periods, and digests of all runs and of the collapsed text, for every row."""
    rows = periodic_runs(docs, id_col, text_col).withColumn("best", longest_repeat(F.col("runs")))
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    return rows.select(
        F.col("id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
