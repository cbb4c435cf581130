"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments with one table each.  By the pigeonhole principle two
fingerprints within the distance agree up to a small radius in one segment, so each
fingerprint looks up the Hamming ball of that radius around each of its segments (for distance
2 and two segments: 33 values of the first, 1 of the second), and every match of the tables is
verified over all 64 bits.  Work is done on distinct fingerprints: copies of a text are one
entry of the tables.

A table value that more than ``hot_bucket`` distinct fingerprints share isn't fetched, since its
pairs grow with the square of its size.  All fingerprints that would have fetched it are linked by
their balls of half the distance instead: two fingerprints are within distance 2 exactly if
the balls of radius 1 around them meet, and a meeting point has at most 65 fingerprints
around it.  So no link is lost and no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from veilgrid.llm.components import component_labels
from veilgrid.llm.workspace import Workspace, column, fresh, slices

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 without words."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxh64_digest(joined, seed)
    else:
        ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
        starts = [0] + [e + 1 for e in ends[: -shingle]]
        digests = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 1 << 15):  # bounded memory for texts of any length
        ones += np.unpackbits(rows[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(rows)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp)`` for every row: the id column and the signed 64-bit fingerprint of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py(), shingle, seed) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "id long, fp long")


def segment_radii(distance: int, segments: int) -> list[int]:
    """Radius of each segment's ball so that any two fingerprints within distance meet in one; -1: not needed."""
    a = distance // segments
    full = distance - segments * a + 1
    return [a if s < full else a - 1 for s in range(segments)]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _pick(part: DataFrame, width: int, shift: int, s: int, masks: list[int]) -> DataFrame:
    value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(_signed((1 << width) - 1)))
    if len(masks) == 1:
        return part.select("fp", F.lit(s).alias("s"), value.alias("v"))
    mask = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return part.select("fp", F.lit(s).alias("s"), value.alias("v0"), mask.alias("mask")).select("fp", "s", F.col("v0").bitwiseXOR(F.col("mask")).alias("v"))


def simhash_links(ws: Workspace, fps: DataFrame, distance: int = 2, segments: int = 2, hot_bucket: int = 64) -> DataFrame:
    """Links between distinct fingerprints ``fps(fp)``: ``(a, b)`` that connect all within the distance.

    Every returned pair is within the distance.  Outside hot buckets all pairs are returned;
    inside them enough pairs that the same fingerprints are reachable from each other.
    """
    bounds = [BITS * s // segments for s in range(segments + 1)]
    probes = index = None
    for s, radius in enumerate(segment_radii(distance, segments)):
        if radius < 0:
            continue
        width, shift = bounds[s + 1] - bounds[s], BITS - bounds[s + 1]
        p, i = _pick(fps, width, shift, s, _ball(width, radius)), _pick(fps, width, shift, s, [0])
        probes, index = (p, i) if probes is None else (probes.union(p), index.union(i))
    hot = ws.table(index.groupBy("s", "v").count().where(F.col("count") > hot_bucket).select("s", "v"), "hot")
    # a hot value is one marker row of the index: who fetches it is linked the other way
    entries = index.join(hot, ["s", "v"], "left_anti").select("s", "v", F.col("fp").alias("other"))
    entries = ws.table(entries.union(hot.select("s", "v", F.lit(None).cast("long"))), "index")
    # probes are 34 rows a fingerprint, by Spark's estimate one: never broadcast
    met = probes.hint("merge").join(entries, ["s", "v"]).where(F.col("other").isNull() | ((F.col("fp") < F.col("other")) & (_distance(F.col("fp"), F.col("other")) <= distance)))
    met = ws.table(met.select("fp", "other"), "matches")
    links = met.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()
    if hot.isEmpty():
        return links
    return links.union(_ball_links(met.where("other is null").select("fp").distinct(), distance))


def _ball_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints whose balls of half the distance (rounded up) meet."""
    radius = (distance + 1) // 2
    met = _pick(fps, BITS, 0, 0, _ball(BITS, radius)).groupBy("v").agg(F.sort_array(F.collect_list("fp")).alias("near")).where(F.size("near") > 1)
    if distance == 2 * radius:  # all around one point are within the distance of each other: a star does
        return met.select(F.col("near")[0].alias("a"), F.explode(F.slice("near", 2, 1 << 20)).alias("b")).distinct()
    pair = met.select("near", F.explode("near").alias("a")).select("a", F.explode("near").alias("b"))
    return pair.where((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= distance)).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3, segments: int = 2, hot_bucket: int = 64) -> DataFrame:
    """Near-duplicate groups: ``(id, fp, root, component_id)``, one row for each row of ``docs``.

    root is a fingerprint that names the group; component_id is the smallest id reachable through fingerprints within the distance.
    A null or blank text has fingerprint 0 and is linked like any other.  Rows with a null id are
    kept; a group of only such rows has a null component_id.  Repeated rows stay repeated.  An
    empty table gives no rows.  Other columns aren't read.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.table(fingerprints(docs, id_col, text_col, shingle), "rows")
    least = ws.table(rows.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("d")), "least")
    links = simhash_links(ws, least.select(F.col("node").alias("fp")), distance, segments, hot_bucket)
    known = component_labels(ws, least, links)
    return rows.join(known.hint("merge"), rows.fp == known.node).select("id", "fp", "root", "component_id")


def hex16(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed 64-bit integer."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each near-duplicate group: that with the smallest id.

    All columns of ``docs`` are kept.  Rows of one id with different fingerprints are told apart, so
    that each group has one row; of rows that repeat both, the least by text stays.  Rows with a null
    id can't be named and stay.
    """
    ws = Workspace(docs.sparkSession, "simhash-keep")
    groups = ws.table(simhash_components(docs, id_col, text_col, **options).where("id is not null"), "groups")
    keep, want, rank, own = fresh(docs, "keep", "want", "rank", "own")
    first = groups.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("k")).select(F.col("k.id").alias(keep), F.col("k.fp").alias(want))
    often = groups.groupBy("id").count().where("count > 1").select(F.col("id").alias("i"))
    first = ws.table(first.join(often, F.col(keep) == F.col("i"), "left"), "first")
    named = docs.where(column(id_col).isNotNull()).withColumn(own, column(id_col).cast("long"))
    columns = [column(c) for c in docs.columns]
    kept = named.join(first.where("i is null").select(keep).hint("merge"), F.col(own) == F.col(keep), "left_semi").select(*columns)
    more = first.where("i is not null").select(keep, want)
    if not more.isEmpty():
        shingle = options.get("shingle", 3)
        key = F.udf(lambda t: fingerprint(None if t is None else t.encode(), shingle), "long")
        again = named.join(more, F.col(own) == F.col(keep)).where(key(column(text_col)) == F.col(want))
        again = again.withColumn(rank, F.row_number().over(Window.partitionBy(keep, want).orderBy(column(text_col).asc_nulls_first())))
        kept = kept.unionByName(again.where(F.col(rank) == 1).select(*columns))
    return kept.unionByName(docs.where(column(id_col).isNull()))
