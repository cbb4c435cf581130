"""Page types by rules that are rows of a table: their number changes no plan.

One pass over a page's texts with an automaton of all rules' words yields the numbers of the words that each text holds; these meet the rules
by an equi-join. A rule whose pattern is more than a word is known by the literal that its matches must hold, and is tried
on the pages where that was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions.names import own_prefix
from veilgrid.functions.patterns import java
from veilgrid.operators.block_rules import required_literal
from veilgrid.operators.classify import fallback_type
from veilgrid.operators.page_rules import ADDITIVE, WEIGHTED
from veilgrid.operators.values import automaton, first_places

RULE = "rule_id int, type string, rank int, part string, field string, pattern string, is_regex boolean, points double, cap double"
#: Characters of all words together that may be sent to every task.
MOST_CHARS = 4_000_000

_FREE = float("inf")
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789 _\n-/&'")


def _rows(rules: list[tuple]) -> list[tuple]:
    return [(k, kind, rank, part, field, p, not set(p) <= _PLAIN, float(points), float(cap)) for k, (kind, rank, part, field, p, points, cap) in enumerate(rules)]


def additive_rules(spark: SparkSession) -> DataFrame:
    """The additive classifier's rules as rows."""
    out = []
    for rank, (kind, urls, words, fields) in enumerate(ADDITIVE):
        for p in urls:
            out += [(kind, rank, "p", "url", p, 3, _FREE), (kind, rank, "p", "title", p, 2, _FREE)]
        for w in words:
            out += [(kind, rank, "p", "body", w, 1, _FREE), (kind, rank, "p", "title", w, 1, _FREE)]
        out += [(kind, rank, "p", "form", h, 2, _FREE) for h in fields]
    return spark.createDataFrame(_rows(out), RULE)


def weighted_rules(spark: SparkSession) -> DataFrame:
    """The weighted classifier's rules as rows: of the patterns of a part one counts, keywords up to a share."""
    out = []
    for rank, (kind, weight, urls, titles, signals, words) in enumerate(WEIGHTED):
        out += [(kind, rank, "url", "url", p, 0.4 * weight, 0.4 * weight) for p in urls] + [(kind, rank, "title", "title", p, 0.25 * weight, 0.25 * weight) for p in titles]
        out += [(kind, rank, "signal", where, {"input": f"\n{part}\n", "form": "\nform\n"}.get(where, part), value * 0.15 * weight, _FREE) for where, part, value in signals]
        out += [(kind, rank, "word", "body", w, 3 / len(words) * 0.2 * weight, 0.2 * weight) for w in words]
    return spark.createDataFrame(_rows(out), RULE)


def word_numbers(texts: DataFrame, key: str, fields: list[str], words: list[str]) -> DataFrame:
    """``(key, field, word)``: the numbers of the words that each field of a row holds, each once."""
    spread = texts.sparkSession.sparkContext.broadcast(words)  # MOST_CHARS characters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(spread.value)}
        machine = automaton(spread.value)
        for batch in batches:
            at: list[int] = []
            said: list[str] = []
            found: list[int] = []
            for name, column in zip(fields, batch.columns[1:], strict=True):
                for r, text in enumerate(column.to_pylist()):
                    for w, _ in first_places(machine, text) if text else ():
                        at.append(r)
                        said.append(name)
                        found.append(number[w])
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string()), pa.array(found, pa.int32())], names=[key, "field", "word"])

    rows = texts.select(key, *fields)
    return rows.mapInArrow(run, rows.select(key, F.lit("").alias("field"), F.lit(0).alias("word")).schema)


def matched_rules(texts: DataFrame, key: str, fields: list[str], rules: DataFrame) -> DataFrame:
    """``(key, rules' columns)`` for each rule that a field of a row holds; keys are unique and not null.

    Words of rules are matched as they are, so texts come in lower case. Rules without a word or literal, and rules whose words have more
    than MOST_CHARS characters together, are refused; null patterns match nothing.
    """
    spark = texts.sparkSession
    # edges of words are no text
    bare = F.regexp_replace(F.regexp_replace("pattern", r"\{[LRB]\}", ""), r"\{s\}", r"\\\\s")
    known = rules.where("pattern is not null").withColumn("literal", F.when(F.col("is_regex"), required_literal(bare)).otherwise(F.col("pattern"))).withColumn("pattern", _java())
    size, none = known.select("literal").distinct().agg(F.coalesce(F.sum(F.length("literal")), F.lit(0)), F.count_if(F.col("literal") == "")).first()
    if none or size > MOST_CHARS:
        raise ValueError(f"{none} rules without a literal; {size} characters of words, {MOST_CHARS} may be")
    words = sorted(r.literal for r in known.select("literal").distinct().collect())  # MOST_CHARS characters at most
    if not words:
        return texts.select(key).limit(0).join(rules.limit(0))
    numbers = spark.createDataFrame(list(enumerate(words)), "word int, literal string")
    met = word_numbers(texts, key, fields, words).join(known.join(numbers, "literal").drop("literal"), ["field", "word"]).drop("word")
    columns = [key, *rules.columns]
    plain = met.where("not is_regex").select(*columns)
    said = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])
    tried = met.where("is_regex").join(texts.select(key, said.alias("said")), key).where(F.call_function("rlike", F.element_at("said", F.col("field")), F.col("pattern")))
    return plain.union(tried.select(*columns))


def type_scores(matched: DataFrame, key: str) -> DataFrame:
    """``(key, scores, best, kind)``: the score of each type that has one, the highest, and the type of it, the first of equals."""
    parts = matched.groupBy(key, "type", "rank", "part").agg(F.least(F.sum("points"), F.min("cap")).alias("s"))
    kinds = parts.groupBy(key, "type", "rank").agg(F.round(F.sum("s"), 12).alias("s"))
    best = F.max(F.struct("s", (-F.col("rank")).alias("r"), "type")).alias("b")
    return kinds.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("type", "s"))).alias("scores"), best).select(key, "scores", F.col("b.s").alias("best"), F.col("b.type").alias("kind"))


def _scored(df: DataFrame, key: str, fields: dict[str, Column], rules: DataFrame) -> tuple[DataFrame, str]:
    own = own_prefix(df)
    texts = df.select(F.col(key).alias("key"), *[c.alias(n) for n, c in fields.items()])
    scores = type_scores(matched_rules(texts, "key", list(fields), rules), "key").select(F.col("key").alias(own + "key"), *[F.col(c).alias(own + c) for c in ("scores", "best", "kind")])
    return df.join(scores, F.col(key) == F.col(own + "key"), "left"), own


def classify_additive_by_table(df: DataFrame, rules: DataFrame | None = None, hints: Column | None = None, key: str = "page_id", out: str = "page_type") -> DataFrame:
    """``classify_additive`` with the rules as a table, by default its own; key names a page, once."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    fields = {"url": low(F.col("url")), "title": low(F.col("title")), "body": F.lower(F.substring(F.coalesce(F.col("visible_text"), F.lit("")), 1, 5000)), "form": low(hints) if hints is not None else F.lit("")}
    rows, own = _scored(df, key, fields, additive_rules(df.sparkSession) if rules is None else rules)
    return rows.withColumn(out, F.when(F.col(own + "best") > 0, F.col(own + "kind")).otherwise("unknown")).drop(*[own + c for c in ("key", "scores", "best", "kind")])


def classify_weighted_by_table(df: DataFrame, elements_col: str | None = None, rules: DataFrame | None = None, key: str = "page_id", out: str = "page_type") -> DataFrame:
    """``classify_weighted`` with the rules as a table, by default its own; key names a page, once."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    ascii_low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    said = {c: F.lit("") for c in ("class", "name", "input", "form")}
    if elements_col:
        low = lambda e, c: F.lower(F.coalesce(e[c], F.lit("")))
        each = lambda f: F.concat(F.lit("\n"), F.array_join(F.transform(F.coalesce(F.col(elements_col), F.array().cast(df.schema[elements_col].dataType)), f), "\n"), F.lit("\n"))
        kind = lambda e: F.when(low(e, "tag_name") == "input", F.lower(F.coalesce(e["input_type"], e["type"], F.lit("")))).otherwise("")
        said = {"class": each(lambda e: low(e, "class_name")), "name": each(lambda e: low(e, "name")), "input": each(kind), "form": each(lambda e: low(e, "tag_name"))}
    fields = {"url": ascii_low(blank("url")), "title": ascii_low(blank("title")), "body": F.lower(blank("visible_text")), **said}
    rows, own = _scored(df, key, fields, weighted_rules(df.sparkSession) if rules is None else rules)
    best, first, scores = F.coalesce(F.col(own + "best"), F.lit(0.0)), F.col(own + "kind"), F.col(own + "scores")
    checkout = (best > 0.3) & (first == "ecommerce") & (F.coalesce(F.try_element_at(scores, F.lit("payment")), F.lit(0.0)) > best * 0.8)
    found = F.when(best < 0.1, fallback_type(blank("url"), blank("title"), blank("visible_text"))).when(checkout, "payment").otherwise(first)
    return rows.withColumn(out, found).drop(*[own + c for c in ("key", "scores", "best", "kind")])


def _java() -> Column:
    """The pattern in Java's dialect; case is settled by the texts."""
    p = F.col("pattern")
    for part in ("{s}", "{L}", "{R}", "{B}"):
        p = F.replace(p, F.lit(part), F.lit(java(part)))
    return F.when(F.col("is_regex"), p).otherwise(F.col("pattern"))
