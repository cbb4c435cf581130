"""Quality classifier by importance resampling.

Two generative models of hashed byte n-grams: one of the target (labelled documents that are good and not
toxic) and one of the raw text (all documents).  A document's log-weight is ``log p_target - log p_raw``
summed over every n-gram of its whole text.  Gumbel noise is added to the tempered log-weights and the k
largest are kept: a sample without replacement in proportion to a power of the weights.

Three choices make the sum tell a few bad words from a long text:

* The ratio of the typical n-gram is taken as 1.  Target text is a part of the raw text, so nearly every
  n-gram is a little more frequent in it; that constant factor for each n-gram says how long a text is, not how good.
* A log ratio counts by as much as it is beyond ``Z`` standard errors of its counts and beyond ``DEAD``, the
  ratio that mixed-in bad text can give to ordinary n-grams.
* The log-weight is divided by the square root of the number of n-grams before noise is added, which is how the
  sum of as many chance terms grows.

k is stated by the labels: half of the labelled documents are left out of the target model, the cut that tells
good from bad among them best is taken, and k is the number of documents at or above it (or ``keep`` times all
documents, where given).

Raw counts cover all documents; they are summed by bucket range in two steps, and what reaches the driver has
a fixed size.  Only labelled documents are bounded, by ``max_labelled`` (those with the smallest hash of their
id).  The k-th largest key is found by counting keys by their digits, 65,536 counts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilgrid.llm.workspace import Workspace, column, fresh, slices

#: Lengths of the n-grams in bytes, and the logarithm of the number of buckets of each.
ORDERS = (3, 6)
BITS = (20, 22)
#: Pseudo-counts that pull the ratio of rare n-grams to 1.
PRIOR = 2.0
#: Standard errors, and the least log ratio, beyond which a ratio counts.
Z, DEAD = 3.0, 1.5
#: Bytes worked on at a time; longer texts go in overlapping stretches.
STRETCH = 1 << 20
#: The sample is proportional to the scaled weights to the power 1 / TEMPERATURE: only documents near the cut are left to chance.
TEMPERATURE = 0.05
#: Buckets of a range that is summed by itself, and the number of sums of each range in the first step.
RANGE, LANES = 1 << 16, 16


def buckets(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h *= np.uint64(0x100000001B3)
        h += data[k : k + n]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def stretches(text: bytes, order: int) -> Iterator[np.ndarray]:
    """Parts of a text of bounded length that hold each n-gram once."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), STRETCH):
        yield data[at : at + STRETCH + order - 1]


@dataclass
class RatioModel:
    """Log ratios by bucket for each order, and the scaled weight at which documents are cut."""

    ratios: list[np.ndarray]
    cut: float = 0.0

    def log_weight(self, text: bytes) -> float:
        """Sum of the log ratios of all n-grams of a text."""
        total = 0.0
        for table, order, bits in zip(self.ratios, ORDERS, BITS, strict=True):
            for part in stretches(text, order):
                total += float(table[buckets(part, order, bits)].sum(dtype=np.float64))
        return total

    @staticmethod
    def scaled(log_weight: float, text: bytes) -> float:
        return log_weight / max(1, len(text)) ** 0.5

    def order_key(self, scaled: float, doc_id: int | None, text: bytes, seed: int) -> int:
        """Tempered weight plus Gumbel noise as a long that sorts alike; ties of the rounded sum go by a hash."""
        h = xxh64_intdigest(repr(doc_id).encode() + b"\0" + text, seed)
        u = ((h >> 11) + 0.5) / (1 << 53)
        key = scaled / TEMPERATURE - np.log(-np.log(u))
        return (int(np.floor(np.clip(key, -32000, 32000) * 65536)) << 31) | (h & 0x7FFFFFFF)


def fit_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target count over the count expected from raw, the typical n-gram's taken off, as far as it counts."""
    share = target.sum() / max(1, raw.sum())

    def parts(at) -> tuple[np.ndarray, np.ndarray]:
        return target[at] + PRIOR, raw[at] * share + PRIOR

    held, typical = np.flatnonzero(target), 0.0
    if len(held):
        t, e = parts(held)
        r = np.log(t / e)
        by = np.argsort(r, kind="stable")
        below = np.cumsum(target[held[by]])
        typical = r[by[np.searchsorted(below, below[-1] / 2)]]  # the median over the target's n-grams
    out = np.zeros(len(target), np.float32)
    for at in range(0, len(target), RANGE):  # the driver holds a few numbers beside the tables
        t, e = parts(slice(at, at + RANGE))
        r = np.log(t / e) - typical
        out[at : at + RANGE] = np.sign(r) * np.maximum(0, np.abs(r) - np.maximum(Z * np.sqrt(1 / t + 1 / e), DEAD))
    return out


def fit_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the largest difference between the shares of good and of bad documents at or above it; the lowest of equals."""
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order] > 0.5
    gap = np.append(s[:-1] > s[1:], True)  # after each distinct score
    better = np.where(gap, np.cumsum(g) / g.sum() - np.cumsum(~g) / (~g).sum(), -2.0)
    at = len(s) - 1 - int(np.argmax(better[::-1]))
    return float(s[at] if at + 1 == len(s) else (s[at] + s[at + 1]) / 2)


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """``(text, good, fold)`` of at most max_labelled labelled documents."""
    good = (F.min("quality") >= 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    # repeated labels of a document: bad if any says so
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("lid")).agg(good.alias("good"))
    sample = one.select("lid", "good", F.xxhash64("lid").alias("h")).orderBy("h", "lid").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    # at most max_labelled rows of three numbers
    return texts.join(F.broadcast(sample), F.col("id") == F.col("lid")).select("text", "good", F.pmod("h", F.lit(2)).alias("fold"))


_COUNTS = "k long, at long, lane long, places binary, counts binary"


def _sparse(tables: list[np.ndarray], lane: int) -> Iterator[pa.RecordBatch]:
    """Rows with the buckets of each range that have a count."""
    for k, table in enumerate(tables):
        for at in range(0, len(table), RANGE):
            places = np.flatnonzero(table[at : at + RANGE])
            if len(places):
                yield pa.record_batch([[k], [at], [lane], [places.astype("<u2").tobytes()], [table[at + places].astype("<i8").tobytes()]], names=["k", "at", "lane", "places", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of all texts of a task."""
    tables = [np.zeros(1 << b, np.int64) for b in BITS]
    held: list[list[np.ndarray]] = [[] for _ in ORDERS]
    size = 0

    def settle() -> None:
        for table, parts, bits in zip(tables, held, BITS, strict=True):
            if parts:
                table += np.bincount(np.concatenate(parts), minlength=1 << bits)  # once for many texts
                parts.clear()

    for batch in slices(batches):
        for t in batch.column(0).cast(pa.binary()):
            text = t.as_py() or b""
            for k, order in enumerate(ORDERS):
                for part in stretches(text, order):
                    held[k].append(buckets(part, order, BITS[k]))
                    size += len(part)
                    if size >= 1 << 23:
                        settle()
                        size = 0
    settle()
    yield from _sparse(tables, TaskContext.get().partitionId() % LANES)


def _add(rows: DataFrame) -> DataFrame:
    """Rows of equal ``(k, at, lane)`` summed."""
    kinds = pa.schema([("k", pa.int64()), ("at", pa.int64()), ("lane", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(RANGE, np.int64)

        def row() -> pa.RecordBatch:
            places = np.flatnonzero(total)
            return pa.RecordBatch.from_pylist([{"k": key[0], "at": key[1], "lane": key[2], "places": places.astype("<u2").tobytes(), "counts": total[places].astype("<i8").tobytes()}], schema=kinds)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["k"], r["at"], r["lane"]) != key:
                    if key:
                        yield row()
                    key = r["k"], r["at"], r["lane"]
                    total[:] = 0
                total[np.frombuffer(r["places"], "<u2")] += np.frombuffer(r["counts"], "<i8")
        if key:
            yield row()

    return rows.repartition("k", "at", "lane").sortWithinPartitions("k", "at", "lane").mapInArrow(run, _COUNTS)


def ngram_counts(texts: DataFrame) -> list[np.ndarray]:
    """Counts by bucket of each order over the only column of ``texts``, summed by range and lane, then by range."""
    out = [np.zeros(1 << b) for b in BITS]
    summed = _add(_add(texts.mapInArrow(_count, _COUNTS)).withColumn("lane", F.lit(0).cast("long")))
    for r in summed.toLocalIterator():  # one row for each range: a fixed number of fixed size
        out[r.k][r["at"] + np.frombuffer(r.places, "<u2").astype(np.int64)] += np.frombuffer(r.counts, "<i8")
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, tasks: int = 8) -> RatioModel | None:
    """The model, or None where the labelled documents don't have both kinds in both halves."""
    ws = Workspace(docs.sparkSession, "classifier-fit")
    sample = ws.table(labelled(docs, labels, max_labelled), "sample")
    kinds = {(r.fold, r.good) for r in sample.select("fold", "good").distinct().collect()}  # at most four
    if len(kinds) < 4:
        return None
    target = ngram_counts(sample.where("fold = 0 and good").select("text").repartition(tasks))
    raw = ngram_counts(docs.select(F.col("text").alias("t")))
    model = RatioModel([])
    while target:  # each table goes when it has been used
        model.ratios.append(fit_ratio(target.pop(0), raw.pop(0)))
    shared = docs.sparkSession.sparkContext.broadcast(model.ratios)  # 4 bytes for each bucket: 20 MiB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = RatioModel(shared.value)
        for batch in slices(batches):
            yield pa.record_batch([pa.array([m.scaled(m.log_weight(t.as_py()), t.as_py()) for t in batch.column(0)], pa.float64()), batch.column(1)], names=["s", "good"])

    got = sample.where("fold = 1").select("text", "good").repartition(tasks).mapInArrow(score, "s double, good boolean").collect()  # at most max_labelled pairs
    shared.destroy()  # the driver would hold a second copy beside the one that weighs all documents
    model.cut = fit_cut(np.array([r.s for r in got]), np.array([float(r.good) for r in got]))
    return model


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs in column ``o`` (None: k is 0 or above the number of rows).

    Four counts by 16 bits each; each brings at most 65,536 numbers to the driver.
    """
    if k <= 0:
        return None
    rest, prefix, left = keys.select(F.col("o").bitwiseXOR(F.lit(-(1 << 63))).alias("x")), 0, k  # unsigned order
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("x", shift).bitwiseAND(F.lit(0xFFFF)).cast("int")
        for d, n in sorted(((r.d, r["count"]) for r in rest.groupBy(digit.alias("d")).count().collect()), reverse=True):
            if n >= left:
                break
            left -= n
        else:
            return None
        prefix = (prefix << 16) | d
        rest = rest.where(digit == d)
    return (prefix ^ (1 << 63)) - (1 << 64) if (prefix ^ (1 << 63)) >= 1 << 63 else prefix ^ (1 << 63)


@dataclass
class Selection:
    """A fitted model, k, the smallest key that is kept (None: none is), and every row of the documents with its weights and key."""

    model: RatioModel | None
    k: int
    least: int | None
    rows: DataFrame
    weight: str
    score: str
    key: str


def select_documents(docs: DataFrame, labels: DataFrame, seed: int = 3, max_labelled: int = 20_000, keep: float | None = None, columns: list[str] | None = None) -> Selection:
    """Fits, weighs every document of ``docs(doc_id, text, ...)`` and finds the least key that is kept.

    Null texts count as empty, with log-weight 0.  Rows with a null id take part; rows that
    repeat both id and text have one key and share its verdict, so a tie at the k-th key can keep
    more than k rows.  Without usable labels everything is kept.  columns: those of docs that the rows have (default all).
    """
    spark = docs.sparkSession
    weight, score, key = fresh(docs, "log_weight", "scaled_weight", "order_key")
    own = docs.columns if columns is None else columns
    if (model := fit(docs, labels, max_labelled)) is None:
        return Selection(None, 0, None, docs.select(*[column(c) for c in own], F.lit(0.0).alias(weight), F.lit(0.0).alias(score), F.lit(0).cast("long").alias(key)), weight, score, key)
    source = docs.select(F.struct(*[column(c) for c in own]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(model.ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = RatioModel(shared.value)
        for batch in slices(batches):
            found: tuple[list, list, list] = ([], [], [])
            for i, t in zip(batch.column(1), batch.column(2), strict=True):
                text = t.as_py() or b""
                w = m.log_weight(text)
                s = m.scaled(w, text)
                for x, y in zip(found, (w, s, m.order_key(s, i.as_py(), text, seed)), strict=True):
                    x.append(y)
            yield pa.record_batch([batch.column(0), pa.array(found[0], pa.float64()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.int64())], names=["row", "w", "s", "o"])

    kinds = source.select("row", F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("o")).schema
    rows = Workspace(spark, "classifier").table(source.mapInArrow(run, kinds), "weighed")
    rows = rows.select("row.*", F.col("w").alias(weight), F.col("s").alias(score), F.col("o").alias(key))
    n, above = rows.agg(F.count("*"), F.count(F.when(F.col(score) >= model.cut, 1))).first()
    k = above if keep is None else round(keep * n)
    return Selection(model, k, kth_largest(rows.select(F.col(key).alias("o")), k), rows, weight, score, key)


def _kept(s: Selection):
    if s.model is None:
        return F.lit(True)
    return F.lit(False) if s.least is None else F.col(s.key) >= F.lit(s.least)


def classify_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, log_weight, scaled_weight, kept)`` for every row of ``docs``: the whole text's log ratio, the same over the root of its length, the verdict."""
    s = select_documents(docs.select("doc_id", "text"), labels, columns=["doc_id"], **options)
    return s.rows.select(F.col("doc_id").cast("long").alias("doc_id"), s.weight, s.score, _kept(s).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; documents are weighed once, into a table that is then filtered."""
    s = select_documents(docs, labels, **options)
    return s.rows.where(_kept(s)).select(*[column(c) for c in docs.columns])
