"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same fractional number of times, target / source size.
The whole copies are certain; the fractional parts are rounded dependently.  Two documents meet
and words are moved at random from one to the other, in either direction with the
probabilities that keep each document's expectation, until one of the two holds a whole
copy; the other goes on to the next meeting.  The sum of words never changes, so at most one
document of a source is left to an independent draw and the source's words are within one
document of its target.

Documents meet inside small cells first.  Each cell of a source hands one undecided document at
most to the next level, where cells meet by tens of them: a reduction tree whose depth
grows with the logarithm of the corpus.  Cells and draws depend on ids and a seed alone, so
reruns and other partitionings give the same mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.workspace import Workspace, column, fresh, word_count

#: Weights of the sources in the order of their code points, repeated as needed.
WEIGHTS = (3.0, 1.0, 2.0)


def ranked_sources(ws: Workspace, sources: DataFrame) -> DataFrame:
    """``sources(source, ...)`` with ``rank`` from 0 by code point, null last, without a single-task sort.

    A range partitioning gives each task one stretch of the order; stretches get their first
    rank from the sizes of those before, a table with one row for each task.
    """
    ordered = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source")
    held = ws.table(ordered.withColumn("task", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("task").agg(F.count("*").alias("n"))
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))  # a row a task
    within = F.row_number().over(Window.partitionBy("task").orderBy("last", "source")) - 1
    return held.withColumn("within", within).join(F.broadcast(before), "task").withColumn("rank", F.col("before") + F.col("within")).drop("task", "last", "within", "before")


def source_targets(ws: Workspace, sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources(source, source_size)`` -> the same with ``target``.

    The mix has share times all words.  Sources split it by weight; none gets more than most
    times its own words, and what is above is split among the others again until none is.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = ws.table(ranked_sources(ws, sources).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "weights")
    total = share * (held.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        capped, open_weight = held.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not open_weight:
            break
        higher = (total - capped) / open_weight
        if higher <= level:
            break
        level = higher
    return held.select("source", "source_size", F.when(F.col("cap") <= F.col("weight") * level, F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def meet(q: float, b: int, p: float, a: int, u: float) -> tuple[float, float]:
    """New fractions of two documents of b and a words after their meeting; u: uniform draw.

    One of the two results is 0 or 1, q b + p a stays, and so does each one's expectation.
    """
    up, down = min((1 - q) * b, p * a), min(q * b, (1 - p) * a)  # words that may move either way
    if u * (up + down) < down:
        return (1.0 if (1 - q) * b <= p * a else q + up / b), (0.0 if p * a <= (1 - q) * b else p - up / a)
    return (0.0 if q * b <= (1 - p) * a else q - down / b), (1.0 if (1 - p) * a <= q * b else p + down / a)


_COLUMNS = "id long, size long, source_size long, target double, base long, p double, sid long, h long, cell long, u double"


def _cells(rows: DataFrame) -> DataFrame:
    """Meetings inside each (source, cell): all rows again with new fractions, one fractional for a cell at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = schema = None
        for batch in batches:
            schema, out = batch.schema, []
            for row in batch.to_pylist():
                if (row["sid"], row["cell"]) != key:
                    key = row["sid"], row["cell"]
                    if held:
                        out.append(held)
                    held = row
                elif held is None:
                    held = row
                else:
                    held["p"], row["p"] = meet(held["p"], held["size"], row["p"], row["size"], row["u"])
                    both, held = (held, row), None
                    for x in both:
                        if 1e-12 < x["p"] < 1 - 1e-12:
                            held = x
                        else:
                            out.append(x | {"p": float(round(x["p"]))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    return rows.repartition("sid", "cell").sortWithinPartitions("sid", "cell", "h", "id", "size").mapInArrow(run, _COLUMNS)


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 11, cell: int = 128, fan_in: int = 32) -> DataFrame:
    """``(id, size, source_size, target, copies)`` for every row of ``docs``.

    size is the number of words, target that of the row's source, copies how often the mix
    takes the document (0, 1 or 2 with the default ``most``).  Documents without words are taken
    0 times.  Null sources form one source, ranked last.  Rows with a null id take part like
    others; repeated rows are rounded each for itself.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"))
    sized = ws.table(sized, "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    totals = ws.table(by_source, "sources")
    goal = source_targets(ws, totals.select("source", "source_size"), weights, share, most)
    goal = ws.table(goal.join(totals.select(F.col("source").alias("s2"), "docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")), "targets")
    g = goal.alias("g")
    rows = sized.join(g, F.col("g.source").eqNullSafe(sized["source"]))
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cells = F.greatest(F.lit(1), F.ceil(F.col("docs") / cell)).cast("long")
    rows = rows.select("id", "size", "source_size", "target", "sid", "h", ratio.alias("ratio"), F.floor(ratio + 1e-9).cast("long").alias("base"), F.pmod("h", cells).alias("cell"), cells.alias("cells"))
    rows = ws.table(rows.withColumn("p", F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0))).drop("ratio"), "fractions")
    kept = ["id", "size", "source_size", "target"]
    parts = [rows.where("p <= 1e-9").select(*kept, F.col("base").alias("copies"))]
    waiting, most_cells, width, level = rows.where("p > 1e-9").drop("cells"), rows.agg(F.max("cells")).first()[0] or 1, 1, 0
    draw = lambda *of: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))  # noqa: E731  uniform from a hash's upper bits
    while True:
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        met = ws.table(_cells(waiting.withColumn("u", draw(F.lit(level), "id", "h")).select(*names)), f"level{level}")
        fixed = (F.col("p") == 0) | (F.col("p") == 1)
        parts.append(met.where(fixed).select(*kept, (F.col("base") + F.col("p").cast("long")).alias("copies")))
        left = met.where(~fixed)
        if width >= most_cells:
            # one document of a source at most is left: an independent draw
            parts.append(left.select(*kept, (F.col("base") + F.when(draw(F.lit("last"), "id", "h") < F.col("p"), 1).otherwise(0)).alias("copies")))
            break
        width, level = width * fan_in, level + 1
        waiting = left.drop("u").withColumn("cell", F.floor(F.col("cell") / fan_in).cast("long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("id", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: every row as often as ``mix_copies`` takes it, all columns kept.

    Rows that repeat an id are taken as often as the sum for that id says, dealt out evenly.
    """
    ws = Workspace(docs.sparkSession, "mixed")
    copies = mix_copies(docs, id_col, text_col, source_col, **options)
    own, at, k, n, copy, place, mine = fresh(docs, "own", "at", "k", "n", "copy", "place", "mine")
    per_id = ws.table(copies.groupBy(F.col("id").alias(at)).agg(F.sum("copies").alias(k), F.count("*").alias(n)).where(F.col(k) > 0), "copies")
    names = [column(c) for c in docs.columns]
    held = docs.withColumn(own, column(id_col).cast("long"))
    once = held.join(per_id.where(F.col(n) == 1).hint("merge"), F.col(own).eqNullSafe(F.col(at)))
    out = once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(k)))).select(*names)
    again = per_id.where(F.col(n) > 1)
    if again.isEmpty():
        return out
    row = F.row_number().over(Window.partitionBy(at).orderBy(column(text_col).asc_nulls_first())) - 1
    rows = held.join(again, F.col(own).eqNullSafe(F.col(at))).withColumn(place, row)
    share = F.floor((F.col(place) + 1) * F.col(k) / F.col(n)) - F.floor(F.col(place) * F.col(k) / F.col(n))
    rows = rows.withColumn(mine, share).where(F.col(mine) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mine))))
    return out.unionByName(rows.select(*names))
