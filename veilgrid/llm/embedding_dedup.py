"""Near-duplicate embeddings by p-stable hashing in Euclidean space.

Vectors are normalised, so a cosine is a distance.  Each of several tables buckets them by
quantised projections on random Gaussian directions; vectors that share a bucket of any table
are compared by their exact cosine in double precision.  The number of projections grows with
the logarithm of the number of vectors, so that chance meetings stay rare, and the number of tables
follows from the recall wanted for pairs right at the threshold.

Equal vectors are one entry that counts its copies.  A bucket is cut into chunks, and each pair
of chunks is a task of its own, so a bucket of any size is spread.  A pair counts in the first
table where it meets.  Tasks return sums and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilgrid.llm.components import component_labels
from veilgrid.llm.workspace import Workspace

#: Width of the quantisation steps for unit vectors.
WIDTH = 2.0
#: Distance at which chance meetings are reckoned: that of unrelated unit vectors.
FAR = math.sqrt(2.0)


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees for two points at a distance."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def table_sizes(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Projections for each table and number of tables for n vectors."""
    k = max(8, math.ceil(math.log(max(n, 2)) / -math.log(collision(FAR))))
    p = collision(math.sqrt(max(1e-9, 2 - 2 * threshold))) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def unit(values: list[float | None] | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, zero or not wholly finite."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _entries(vectors: DataFrame) -> DataFrame:
    """``(vec_id, node, vector)``: node: hash of the unit vector (null: it can't be compared), vector: its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if x is None else (x + 0.0).tobytes() for x in map(unit, batch.column(1).to_pylist())]  # + 0.0: no negative zero
            yield pa.record_batch([batch.column(0), pa.array([d and _signed(xxh64_intdigest(d)) for d in data], pa.int64()), pa.array(data, pa.binary())], names=["vec_id", "node", "vector"])

    return vectors.mapInArrow(run, "vec_id long, node long, vector binary")


def signatures(x: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """64-bit bucket of each row of ``x`` in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], tables * k)), rng.random(tables * k) * WIDTH
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, k).astype(np.uint64)
    h = np.full((len(x), tables), x.shape[1], np.uint64)
    for i in range(k):
        h = (h ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _sign(entries: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [v.as_py() for v in batch.column(1)]
            out: list = [None] * len(raw)
            for size in {len(r) for r in raw}:  # vectors of one length at a time
                at = [i for i, r in enumerate(raw) if len(r) == size]
                sigs = signatures(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1), k, tables, seed)
                for i, s in zip(at, sigs, strict=True):
                    out[i] = s.tobytes()
            buckets = pa.array([np.frombuffer(s, np.int64).tolist() for s in out], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary()), buckets], names=["node", "vector", "copies", "sig", "buckets"])

    return entries.select("node", "vector", "copies").mapInArrow(run, "node long, vector binary, copies long, sig binary, buckets array<long>")


def _compare(tasks: DataFrame, threshold: float) -> DataFrame:
    """``(node, links, root)`` of every member of every task: links found there, and its tree of the forest they span."""

    def one(t: int, diagonal: bool, rows: list[dict]) -> pa.RecordBatch | None:
        out_n: dict[int, int] = {}
        parent = list(range(len(rows)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for size in {len(r["vector"]) for r in rows}:
            at = np.array([i for i, r in enumerate(rows) if len(r["vector"]) == size])
            x = np.frombuffer(b"".join(rows[i]["vector"] for i in at), np.float64).reshape(len(at), -1)
            sig = np.frombuffer(b"".join(rows[i]["sig"] for i in at), np.int64).reshape(len(at), -1)[:, :t]
            side = np.array([rows[i]["side"] for i in at])
            left, right = (np.arange(len(at)),) * 2 if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            a, b = left[a], right[b]
            if diagonal:
                a, b = a[a < b], b[a < b]
            first = ~(sig[a] == sig[b]).any(axis=1)  # didn't meet in an earlier table
            for i, j in zip(at[a[first]].tolist(), at[b[first]].tolist(), strict=True):
                out_n[i] = out_n.get(i, 0) + rows[j]["copies"]
                out_n[j] = out_n.get(j, 0) + rows[i]["copies"]
                if (p := find(i)) != (q := find(j)):
                    parent[max(p, q)] = min(p, q)
        if not out_n:
            return None
        return pa.record_batch([pa.array([rows[i]["node"] for i in out_n], pa.int64()), pa.array(list(out_n.values()), pa.int64()), pa.array([rows[find(i)]["node"] for i in out_n], pa.int64())], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (now := (row["t"], row["bucket"], row["i"], row["j"])) != key:
                    if held and (got := one(key[0], key[2] == key[3], held)) is not None:
                        yield got
                    key, held = now, []
                held.append(row)
        if held and (got := one(key[0], key[2] == key[3], held)) is not None:
            yield got

    keys = ["t", "bucket", "i", "j"]
    return tasks.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "node long, links long, root long")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.95, chunk: int = 128, seed: int = 7) -> DataFrame:
    """``(id, n_links, component_id)`` for every row of ``vectors``.

    n_links counts the other rows whose cosine with this one is at least threshold, component_id is
    the smallest id reachable by links.  Null, zero and not wholly finite vectors, and vectors of
    different length, don't link.  Rows with a null id are compared like others; repeated rows
    link with each other; an empty table gives no rows.
    """
    ws = Workspace(vectors.sparkSession, "embeddings")
    rows = ws.table(_entries(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))), "rows")
    valid = rows.where("node is not null")
    entries = ws.table(valid.groupBy("node").agg(F.min("vec_id").alias("d"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")), "entries")
    k, tables = table_sizes(entries.count(), threshold, recall)
    signed = ws.table(_sign(entries, k, tables, seed), "signed")
    met = ws.table(signed.select("node", F.posexplode("buckets").alias("t", "bucket")), "buckets")
    # buckets of one entry meet nobody; larger ones are cut into chunks
    sizes = met.groupBy("t", "bucket").agg(F.count("*").alias("m")).where("m > 1").select("t", "bucket", F.ceil(F.col("m") / chunk).cast("int").alias("chunks"))
    sizes = ws.table(sizes, "sizes")
    shared = ws.table(met.join(sizes, ["t", "bucket"]).withColumn("x", F.pmod(F.xxhash64("node", "t"), F.col("chunks")).cast("int")), "shared")
    y = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tasks = shared.select("node", "t", "bucket", "x", y.alias("y")).select("node", "t", "bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.when(F.col("x") <= F.col("y"), 0).otherwise(1).alias("side"))
    found = ws.table(_compare(tasks.join(signed.select("node", "vector", "copies", "sig"), "node"), threshold), "found")
    labels = component_labels(ws, entries.select("node", "d"), found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = ws.table(found.groupBy("node").agg(F.sum("links").alias("links")), "sums")
    known = entries.select("node", "copies").join(labels, "node").join(sums, "node", "left")
    known = ws.table(known.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "known")
    linked = valid.select("vec_id", "node").join(known, "node").select(F.col("vec_id").alias("id"), "n_links", "component_id")
    alone = rows.where("node is null").select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone)
