"""Which texts of a page hold which of its values: one automaton for many values, run over many texts.

Values of a page make an Aho-Corasick automaton, which reads each of the page's texts once, whatever their number. A page of very many
rows is dealt in squares of some values by some texts, so no task holds all of either. Pages follow one another in a task's
sorted rows; nothing is gathered but the values of the square at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.names import own_prefix

#: Values and texts of a square.
VALUES, TEXTS = 2_000, 10_000


def first_places(values: ahocorasick.Automaton, text: str) -> Iterator[tuple[str, int]]:
    """Each value that a text holds and its first place, from 1, in the order of the places' ends."""
    seen: set[str] = set()
    for end, value in values.iter(text):
        if value not in seen:
            seen.add(value)
            yield value, end - len(value) + 2


def automaton(values: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for v in values:
        out.add_word(v, v)
    out.make_automaton()
    return out


def value_hits(texts: DataFrame, values: DataFrame, keys: tuple[str, ...], node: str, text: str, item: str, value: str, sizes: tuple[int, int] = (VALUES, TEXTS)) -> DataFrame:
    """``(keys, node, item, at)``: each text of a page that holds a value of the page, and the first place, counted from 1.

    ``texts`` has the columns keys, node and text, ``values`` keys, item and value; of equal rows each counts. Null and empty texts and values,
    and null keys, hit nothing.
    """
    own = own_prefix(texts, values)
    p, q, side, said = (own + x for x in ("p", "q", "side", "text"))
    many = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    texts, values = texts.where(F.col(text) != "").select(*keys, node, text), values.where(F.col(value) != "").select(*keys, item, value)
    parts = many(values, sizes[0], p).join(many(texts, sizes[1], q), list(keys))
    deal = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kinds = {**dict(texts.dtypes), **dict(values.dtypes)}
    no = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    v = values.join(parts, list(keys)).withColumn(p, deal(p, item, value)).withColumn(q, every(q)).select(*keys, p, q, F.lit(0).alias(side), no(node), item, F.col(value).alias(said))
    t = texts.join(parts, list(keys)).withColumn(q, deal(q, node, text)).withColumn(p, every(p)).select(*keys, p, q, F.lit(1).alias(side), node, no(item), F.col(text).alias(said))
    square = [*keys, p, q]
    rows = v.unionByName(t).repartition(*square).sortWithinPartitions(*square, side)
    wide = len(square)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_key, items, machine = None, {}, None
        for batch in batches:
            columns = batch.columns
            at: list[int] = []
            found: list = []
            places: list[int] = []
            for r, (key, value_row, ref, said_) in enumerate(zip(zip(*[c.to_pylist() for c in columns[:wide]], strict=True), columns[wide].to_pylist(), columns[wide + 2].to_pylist(), columns[wide + 3].to_pylist(), strict=True)):
                if key != at_key:
                    at_key, items, machine = key, {}, None
                if value_row == 0:
                    items.setdefault(said_, []).append(ref)
                elif items:
                    machine = machine or automaton(list(items))
                    for hit, place in first_places(machine, said_):
                        at += [r] * len(items[hit])
                        found += items[hit]
                        places += [place] * len(items[hit])
            take = pa.array(at, pa.int64())
            yield pa.record_batch([*[c.take(take) for c in columns[: len(keys)]], columns[wide + 1].take(take), pa.array(found, columns[wide + 2].type), pa.array(places, pa.int32())], names=[*keys, node, item, "at"])

    schema = rows.select(*keys, node, item, F.lit(0).alias("at")).schema
    return rows.mapInArrow(run, schema)
