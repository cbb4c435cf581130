"""Redaction and masking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions import fixed, patterns
from veilgrid.functions.names import own_prefix
from veilgrid.functions.patterns import java
from veilgrid.operators.detect import digits_of, level_order
from veilgrid.operators.risk import lookup
from veilgrid.operators.spans import rebuilt, taken
from veilgrid.operators.values import value_hits


def placeholder(kind: Column, style: str = "category") -> Column:
    """``category``: from the table; ``type``: [TYPE]; ``redacted``: [TYPE_REDACTED]."""
    if style == "category":
        return lookup(kind, fixed.PLACEHOLDER, "[REDACTED]")
    return F.concat(F.lit("["), kind, F.lit("_REDACTED]" if style == "redacted" else "]"))


def _in_order(text: Column, entities: Column, style: str, order: str) -> Column:
    """The entities as structs ``(a, i, value, by)`` in the order in which they are replaced."""
    at = lambda e: F.when(F.instr(text, e["value"]) > 0, F.instr(text, e["value"])).otherwise(F.lit(2**31 - 1)) if order == "first" else -F.length(e["value"])
    return F.array_sort(F.transform(entities, lambda e, i: F.struct(at(e).alias("a"), i.alias("i"), e["value"].alias("value"), placeholder(e["type"], style).alias("by"))))


def redact_text(text: Column, entities: Column, style: str = "category", order: str = "longest") -> Column:
    """Every occurrence of every entity's value replaced by its placeholder, one after the other.

    entities: array of structs with type and value.  order ``longest`` goes by length, which can't strand the tail
    of a longer value; ``first`` goes by first occurrence, as the library form does.  Ties keep the array's order.
    For a few entities a text: the text is copied once for each. ``redact_documents`` has no such cost.
    """
    return F.aggregate(_in_order(text, entities, style, order), text, lambda acc, e: F.when(F.coalesce(e["value"], F.lit("")) != "", F.replace(acc, e["value"], e["by"])).otherwise(acc))


def _with_values(df: DataFrame, found: DataFrame, key: str, text_col: str, style: str, order: str) -> tuple[DataFrame, str]:
    """The documents with an array of their entities' structs in order (null without any), and the array's name."""
    own = own_prefix(df)
    mine = found.groupBy(F.col(key).alias(f"{own}key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type", "value"))), lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"))).alias(f"{own}e"))
    joined = df.join(mine, F.col(key) == F.col(f"{own}key"), "left").drop(f"{own}key")
    return joined.withColumn(f"{own}e", _in_order(F.col(text_col), F.col(f"{own}e"), style, order)), f"{own}e"


def redact_documents(df: DataFrame, found: DataFrame, key: str = "doc_id", text_col: str = "text", style: str = "category", order: str = "longest", out: str = "safe_text") -> DataFrame:
    """Adds the redacted text; equal to ``redact_text`` over a text's findings in their order.

    The places of all findings are found in one reading and the text is rebuilt once, so a text with thousands of findings stays
    cheap. Texts without findings don't leave the JVM.
    """

    @F.pandas_udf("string")
    def rebuild(text: pd.Series, values: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or any(v and b is None for v, b in zip(vs, bs, strict=True)) else rebuilt(t, [v or "" for v in vs], list(bs)) for t, vs, bs in zip(text, values, by, strict=True)], dtype=object)

    some, e = _with_values(df, found, key, text_col, style, order)
    each = F.transform(e, lambda x: x["value"]), F.transform(e, lambda x: x["by"])
    empty = F.array().cast("array<string>")
    mine = F.col(e).isNotNull()
    safe = rebuild(F.when(mine, F.col(text_col)), F.coalesce(each[0], empty), F.coalesce(each[1], empty))
    return some.withColumn(out, F.when(mine, safe).otherwise(F.col(text_col))).drop(e)


def redaction_spans(df: DataFrame, found: DataFrame, key: str = "doc_id", text_col: str = "text", style: str = "category", order: str = "longest") -> DataFrame:
    """``(key, start, end, value, placeholder)``: every place that redaction replaces, from 0 in characters, end exclusive.

    Values take places in the order of ``redact_documents``, none that an earlier value took. Null texts, keys without findings and empty
    values give no rows.
    """
    some, e = _with_values(df, found, key, text_col, style, order)
    rows = some.where(F.col(e).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.transform(e, lambda x: F.coalesce(x["value"], F.lit(""))).alias("values"), F.transform(e, lambda x: x["by"]).alias("by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found_ = [], []
            for r, (text, values, by) in enumerate(zip(*[batch.column(k) for k in (1, 2, 3)], strict=True)):
                values, by = values.as_py(), by.as_py()
                for a, z, k in taken(text.as_py(), values):
                    at.append(r)
                    found_.append((a, z, values[k], by[k]))
            columns = zip(*found_, strict=True) if found_ else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["key", "start", "end", "value", "placeholder"])

    schema = rows.select("key", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("value"), F.lit("").alias("placeholder")).schema
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def redaction_actions(scored: DataFrame, least: str = "HIGH", methods: dict[str, str] | None = None) -> DataFrame:
    """What is redacted: entities of at least a level, with method and the text put in their place."""
    method = lookup(F.col("type"), methods, "mask") if methods else F.lit("mask")
    return scored.where(level_order(F.col("level")) >= fixed.LEVELS.index(least)).withColumn("method", method).withColumn("redacted_value", placeholder(F.col("type"), "redacted"))


def mask(value: Column, kind: Column, style: str = "list") -> Column:
    """A value as shown to people; style ``panel`` has no form for 5 to 8 characters."""
    n, digits = F.length(value), digits_of(value)
    tail = lambda x, k: F.right(x, F.lit(k))
    name, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    out = (
        F.when(F.coalesce(value, F.lit("")) == "", "")
        .when(kind.isin("PASSWORD", "API_KEY", "AUTH_TOKEN"), F.when(n <= 8, "****").otherwise(F.concat(F.left(value, F.lit(4)), F.lit("****"), tail(value, 4))))
        .when((kind == "EMAIL") & (F.size(F.split(value, "@")) == 2), F.concat(F.left(name, F.when(F.length(name) <= 2, 1).otherwise(2)), F.lit("***@"), domain))
        .when((kind == "CREDIT_CARD") & (F.length(digits) >= 8), F.concat(F.lit("****-****-****-"), tail(digits, 4)))
        .when((kind == "PHONE") & (F.length(digits) >= 6), F.concat(F.lit("***-***-"), tail(digits, 4)))
        .when((kind == "GOVERNMENT_ID") & (n >= 6), F.concat(F.lit("***-"), tail(value, 4)))
        .when(n > 8, F.concat(F.left(value, F.lit(4)), F.lit("..."), tail(value, 2)))
    )
    if style == "list":
        out = out.when(n > 4, F.concat(F.left(value, F.lit(2)), F.lit("***"), tail(value, 1)))
    return out.otherwise("****")


def display_token(kind: Column) -> Column:
    return lookup(kind, fixed.DISPLAY_TOKEN, fixed.DEFAULT_TOKEN)


def numbered_tokens(found: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Adds ``token``: the category's label and the finding's number in its text, three digits, from 000."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in fixed.TOKEN_LABEL.items() for x in p]), F.col("type")), F.col("type"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    digits = n.cast("string")
    return found.withColumn("token", F.concat(label, F.lit("_"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)))


def redact_for_cloud(text: Column) -> Column:
    """Five patterns replaced one after the other before text may leave."""
    for pattern, label in patterns.CLOUD:
        text = F.regexp_replace(text, java(pattern), f"[{label}_REDACTED]")
    return text


def sanitize_log(data: Column) -> Column:
    """Values of telling keys hidden; only the top level of the map is looked at."""
    telling = lambda k: _any_part(F.lower(k))
    return F.transform_values(data, lambda k, v: F.when(telling(k), F.lit("[REDACTED]")).otherwise(v))


def _any_part(key: Column) -> Column:
    out = F.lit(False)
    for hint in fixed.LOG_HINTS:
        out = out | F.contains(key, F.lit(hint))
    return out


def scrub_url(url: Column) -> Column:
    """Origin and path without query and fragment; what isn't a URL is cut to 512 characters."""
    parsed = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    origin = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(/[^?#]*)", 1)
    return F.when(parsed, F.concat(origin, F.when(path == "/", "").otherwise(path))).otherwise(F.substring(F.coalesce(url, F.lit("")), 1, fixed.URL_CHARS))


def redact_elements(elements: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """Changes to a page's elements: ``(page, idx, field, before, after)`` where an entity is named by selector or equals a value or text.

    Inputs change their value, other elements the first occurrence in their text.  Entities are tried in order; the first decides.
    Selectors and whole values meet by equi-joins, values inside texts in the page's automata.
    """
    of = F.struct("pos", "type", "value").alias("__of")
    e = found.select(key, of, F.col("value").alias("__value"), F.col("dom_selector").alias("__selector"))
    v = elements.select(key, "idx", F.col("selector").alias("__selector"), F.col("text").alias("__text"), F.col("value").alias("__value"), "is_input")
    named = v.drop("__value").join(e, [key, "__selector"]).select(key, "idx", "__of")
    equal = v.where("__value != ''").join(e, [key, "__value"]).select(key, "idx", "__of")
    held = value_hits(v, e, (key,), "idx", "__text", "__of", "__value").select(key, "idx", "__of")
    first = named.union(equal).union(held).groupBy(key, "idx").agg(F.min("__of").alias("__of"))
    met = v.join(first, [key, "idx"])
    by, text, value = placeholder(F.col("__of.type")), F.col("__text"), F.col("__of.value")
    at = F.instr(text, value)
    swapped = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(value), F.length(text)))).otherwise(by)
    return met.select(key, "idx", F.when(F.col("is_input"), "value").otherwise("text").alias("field"), F.when(F.col("is_input"), F.col("__value")).otherwise(text).alias("before"), F.when(F.col("is_input"), by).otherwise(swapped).alias("after"))


def protected_only(shots: DataFrame) -> DataFrame:
    """Images that may be shown: redacted ones that exist and differ from the original."""
    return shots.where((F.coalesce(F.col("redacted"), F.lit("")) != "") & ~F.col("redacted").eqNullSafe(F.col("original")))
