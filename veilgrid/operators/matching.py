"""Joins between entities, elements, words and risks; all of them meet on the page first."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions.names import own_prefix
from veilgrid.functions.patterns import java
from veilgrid.functions.text import agent_score, fuzzy_form, fuzzy_forms, iou, strip, trim
from veilgrid.operators.boxes import overlapping
from veilgrid.operators.values import value_hits
from veilgrid.sources.shared import cut

_WORD_EDGES = r"[{s}(),.\-]+"


def with_risk(entities: DataFrame, risks: DataFrame, key: str = "entity_id") -> DataFrame:
    """Adds the risk's level, the base risk where there is none."""
    own = own_prefix(entities)
    r = risks.select(key, F.col("level").alias(f"{own}level"))
    return entities.join(r, key, "left").withColumn("level", F.coalesce(f"{own}level", "risk")).drop(f"{own}level")


def sensitive_elements(elements: DataFrame, entities: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``(keys, idx, sensitive_fields)``: distinct types of the entities that an element has by selector, by text or value,
    or by overlapping over half, in the entities' order.

    Selectors meet by an equi-join, values by automata over the page's texts, boxes on grids: no way compares all pairs of a page.
    """
    of = F.struct(F.col("pos").alias("pos"), F.col("type").alias("type")).alias("__of")
    e = entities.select(*keys, of, F.col("value").alias("__value"), F.col("dom_selector").alias("__selector"), F.col("bbox").alias("__box"))
    v = elements.where("is_visible").select(*keys, "idx", "selector", "text", "value", "rect")
    named = v.where("selector != ''").withColumnRenamed("selector", "__selector").join(e, [*keys, "__selector"]).select(*keys, "idx", "__of")
    held = [value_hits(v.select(*keys, "idx", F.col(c).alias("__text")), e, keys, "idx", "__text", "__of", "__value").select(*keys, "idx", "__of") for c in ("text", "value")]
    over = overlapping(v.select(*keys, "idx", "rect"), e.select(*keys, "__of", "__box"), keys, "rect", "__box").select(*keys, "idx", "__of")
    met = named.union(held[0]).union(held[1]).union(over)
    first = met.groupBy(*keys, "idx", F.col("__of.type").alias("__type")).agg(F.min("__of.pos").alias("__pos"))
    return first.groupBy(*keys, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__type"))), lambda x: x["__type"]).alias("sensitive_fields"))


def candidate_pairs(dom: DataFrame, ocr: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pairs of entities of a page with equal type that are alike by value (over 0.8) or by box (over half)."""
    a = dom.select(*keys, "type", F.col("pos").alias("dom_pos"), fuzzy_form(F.col("value")).alias("dom_value"), F.col("bbox").alias("dom_box"))
    b = ocr.select(*keys, "type", F.col("pos").alias("ocr_pos"), fuzzy_form(F.col("value")).alias("ocr_value"), F.col("bbox").alias("ocr_box"))
    alike = fuzzy_forms(*[F.col(f"{side}_value.{form}") for side in ("dom", "ocr") for form in ("said", "bare")])
    box = F.when((F.col("dom_box.width") > 0) & (F.col("dom_box.height") > 0), iou(F.col("dom_box"), F.col("ocr_box"))).otherwise(0.0)
    met = a.join(b, [*keys, "type"]).withColumn("value_score", alike).withColumn("box_score", box)
    return met.where((F.col("value_score") > 0.8) | (F.col("box_score") > 0.5)).select(*keys, "type", "dom_pos", "ocr_pos", "value_score", "box_score")


#: Rounds of matching by joins; edges that are left then are settled one after the other.
ROUNDS = 12


def first_free(edges: DataFrame, keys: tuple[str, ...], a: str, b: str, rounds: int = ROUNDS) -> DataFrame:
    """The edges ``(keys, a, b)`` that are taken if all are tried by a, then b, and each end is taken once.

    In a round every edge that is the first of both its ends is taken, since no earlier edge can take them, and all edges at
    those ends drop. Each round takes an edge of every connected group that has one, and mostly nearly all; a long chain of edges that wait for one
    another takes as many rounds as it has edges, so what is left after ``rounds`` is settled in order, page by page. Rows that
    repeat count once; null ends and keys are left out.
    """
    spark, own = edges.sparkSession, own_prefix(edges)
    left = cut(edges.select(*keys, a, b).where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, a, b))).distinct())
    taken = []
    for _ in range(rounds):
        if left.isEmpty():
            break
        lowest = lambda end, other, name: left.groupBy(*keys, end).agg(F.min(other).alias(name))  # noqa: E731, B023
        firsts = left.join(lowest(a, b, f"{own}b"), [*keys, a]).join(lowest(b, a, f"{own}a"), [*keys, b]).where((F.col(b) == F.col(f"{own}b")) & (F.col(a) == F.col(f"{own}a")))
        firsts = cut(firsts.select(*keys, a, b))
        taken.append(firsts)
        left = cut(left.join(firsts.select(*keys, a), [*keys, a], "left_anti").join(firsts.select(*keys, b), [*keys, b], "left_anti").select(*keys, a, b))
    else:

        def settle(frame: pd.DataFrame) -> pd.DataFrame:
            used_a: set = set()
            used_b: set = set()
            keep = []
            for x, y in frame[[a, b]].itertuples(index=False):
                keep.append(x not in used_a and y not in used_b)
                if keep[-1]:
                    used_a.add(x)
                    used_b.add(y)
            return frame[keep]

        taken.append(left.groupBy(*keys).applyInPandas(lambda f: settle(f.sort_values([a, b])), left.schema))
    out = spark.createDataFrame([], left.schema)
    for t in taken:
        out = out.union(t)
    return out


def combine(dom: DataFrame, ocr: DataFrame, key: str = "page_id") -> DataFrame:
    """One list of entities from a page's structure and its picture.

    In the order of the first list each entity takes the first free partner among its candidates; a pair becomes one
    entity: that of the greater confidence (the first on a tie), source HYBRID if the sources differ.  The rest follow.
    Matching is greedy and depends on order; ``first_free`` finds the same pairs by rounds.
    """
    chosen = first_free(candidate_pairs(dom, ocr, (key,)), (key,), "dom_pos", "ocr_pos")
    o = ocr.select(key, F.col("pos").alias("ocr_pos"), F.struct("value", "confidence", "source", "bbox").alias("__o"))
    left = dom.select(key, F.col("pos").alias("dom_pos"), "type", "value", "confidence", "source", "bbox").join(chosen, [key, "dom_pos"], "left").join(o, [key, "ocr_pos"], "left")
    own = F.col("__o").isNull() | (F.col("confidence") >= F.col("__o.confidence"))
    pick = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"__o.{c}")).alias(c)
    source = F.when(F.col("__o").isNull() | (F.col("source") == F.col("__o.source")), F.col("source")).otherwise("HYBRID")
    merged = left.select(key, F.lit(0).alias("part"), F.col("dom_pos").alias("pos"), "type", pick("value"), F.greatest("confidence", "__o.confidence").alias("confidence"), source.alias("source"), pick("bbox"))
    rest = ocr.join(chosen.select(key, F.col("ocr_pos").alias("pos")), [key, "pos"], "left_anti").select(key, F.lit(1).alias("part"), "pos", "type", "value", "confidence", "source", "bbox")
    return merged.unionByName(rest)


def _bare(value: Column) -> Column:
    return F.lower(strip(value, _WORD_EDGES))


def word_boxes(entities: DataFrame, words: DataFrame, keys: tuple[str, ...] = ("page_id",), entity_key: str = "entity_id") -> DataFrame:
    """Boxes from a page's words: the equal word, else the one of the best ratio of lengths that holds or is held.

    ``words(keys, idx, text, bbox)``.  Shorter words are tried first, then the order of the page; the first best wins.
    A found word adds 0.05 to the confidence; without one the line that the context names gives the box.
    """
    own = own_prefix(entities, words)
    w = words.select(*keys, F.col("idx").alias(own + "idx"), F.length("text").alias(own + "n"), _bare(F.col("text")).alias(own + "w"), F.col("bbox").alias(own + "box")).where(F.col(own + "w") != "")
    e = entities.withColumn(own + "v", _bare(F.coalesce("value", F.lit(""))))
    ratio = F.least(F.length(own + "w"), F.length(own + "v")) / F.greatest(F.length(own + "w"), F.length(own + "v"))
    met = e.where(F.col(own + "v") != "").select(*keys, entity_key, own + "v").join(w, list(keys)).where(F.contains(F.col(own + "w"), F.col(own + "v")) | F.contains(F.col(own + "v"), F.col(own + "w")))
    best = met.groupBy(*keys, entity_key).agg(F.min_by(own + "box", F.struct((-ratio).alias("r"), F.col(own + "n"), F.col(own + "idx"))).alias(own + "best"))
    lines = text_lines(words, keys).select(*keys, "line", "line_text", F.col("bbox").alias(own + "line_box"))
    ctx = _bare(F.coalesce("context", F.lit("")))
    by_line = e.where(ctx != "").select(*keys, entity_key, ctx.alias(own + "c")).join(lines, list(keys)).where(F.contains("line_text", own + "c") | F.contains(F.col(own + "c"), F.regexp_replace("line_text", java("{s}+"), "")))
    by_line = by_line.where((F.col(own + "line_box.width") > 0) & (F.col(own + "line_box.height") > 0)).groupBy(*keys, entity_key).agg(F.min_by(own + "line_box", "line").alias(own + "line"))
    out = e.join(best, [*keys, entity_key], "left").join(by_line, [*keys, entity_key], "left")
    raised = F.least(F.lit(1.0), F.col("confidence") + F.when(F.col(own + "best").isNotNull(), 0.05).otherwise(0.0))
    return out.withColumn("bbox", F.coalesce(own + "best", own + "line", "bbox")).withColumn("confidence", F.round(raised, 6)).withColumn("source", F.lit("OCR")).drop(own + "v", own + "best", own + "line")


def text_lines(words: DataFrame, keys: tuple[str, ...] = ("page_id",), gap: float = 8.0) -> DataFrame:
    """Lines of a page's words in order: a new one begins where the top moves by more than the gap."""
    by = Window.partitionBy(*keys).orderBy("idx")
    moved = F.when(F.abs(F.col("bbox.y") - F.lag("bbox.y").over(by)) > gap, 1).otherwise(0)
    numbered = words.withColumn("__m", moved).withColumn("line", F.sum("__m").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    right, bottom = F.col("bbox.x") + F.col("bbox.width"), F.col("bbox.y") + F.col("bbox.height")
    half = lambda c: F.floor(c + 0.5).cast("double")
    lines = numbered.groupBy(*keys, "line").agg(
        F.min("bbox.x").alias("x0"), F.min("bbox.y").alias("y0"), F.max(right).alias("x1"), F.max(bottom).alias("y1"),
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"]), " ")).alias("line_text"), F.count("*").alias("n_words"),
    )
    box = F.struct(half(F.col("x0")).alias("x"), half(F.col("y0")).alias("y"), half(F.col("x1") - F.col("x0")).alias("width"), half(F.col("y1") - F.col("y0")).alias("height"))
    return lines.select(*keys, "line", "line_text", "n_words", box.alias("bbox"))


def ocr_boxes(words: DataFrame) -> DataFrame:
    """Corner pairs as boxes."""
    box = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    return words.withColumn("bbox", box).drop("x0", "y0", "x1", "y1")


def offset_boxes(words: DataFrame, x: Column, y: Column) -> DataFrame:
    """Boxes found in a region, in the places of the whole picture."""
    box = F.struct((F.col("bbox.x") + x).alias("x"), (F.col("bbox.y") + y).alias("y"), F.col("bbox.width").alias("width"), F.col("bbox.height").alias("height"))
    return words.withColumn("bbox", box)


def append_new(entities: DataFrame, more: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Entities and those of a second list whose type and value aren't there yet."""
    return entities.unionByName(more.join(entities.select(*keys, "type", "value").distinct(), [*keys, "type", "value"], "left_anti"), allowMissingColumns=True)


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    most = F.length(text) - n + 1
    return F.when(most > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _query_grams(text: Column) -> Column:
    """Runs of the words of a description of which an element that reaches over 0.2 has one.

    Some word is in the element's text then, or holds a word of it of at least 0.6 of its length: they share a run of three
    characters, or of two where a word has three, or the whole of a shorter word.
    """
    words = F.filter(F.split(F.lower(trim(text)), java("{s}+")), lambda w: w != "")
    of = lambda w: F.when(F.length(w) > 3, _grams(w, 3)).when(F.length(w) == 3, F.concat(F.array(w), _grams(w, 2))).otherwise(F.array(w))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def find_element(elements: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("page_id",), least: float = 0.25) -> DataFrame:
    """``queries(keys, query_id, description)`` -> the best safe element of the page for each, the first on a tie, none below the least score.

    Only elements that share a run of characters with a description are scored (all of the page where ``least`` is 0.2 or less,
    which scattered letters reach).
    """
    hay = F.concat_ws(" ", *[F.when(c != "", c) for c in (F.col("label"), F.col("role"), F.col("tag"), F.array_join("sensitive_fields", " "), F.col("selector"))])
    e = elements.select(*keys, "idx", "selector", hay.alias("__hay"))
    q = queries.select(*keys, "query_id", F.col("description").alias("__said"))
    met = element_pairs(e, q, keys) if least > 0.2 else e.join(q, list(keys))
    met = met.withColumn("score", F.round(agent_score(F.col("__hay"), F.col("__said")), 9))
    best = met.groupBy(*keys, "query_id").agg(F.max_by(F.struct("selector", "score"), F.struct("score", (-F.col("idx")).alias("i"))).alias("__best"))
    return best.select(*keys, "query_id", F.col("__best.selector").alias("selector"), F.col("__best.score").alias("score")).where(F.col("score") >= least)


def element_pairs(e: DataFrame, q: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The pairs of a page's elements and descriptions that ``find_element`` scores."""
    text = F.lower(trim(F.col("__hay")))
    cut = e.withColumn("__gram", F.explode(F.array_distinct(F.concat(*[_grams(text, n) for n in (1, 2, 3)]))))
    asked = q.withColumn("__gram", F.explode(_query_grams(F.col("__said"))))
    return cut.join(asked, [*keys, "__gram"]).drop("__gram").distinct()


def locate(entities: DataFrame, elements: DataFrame, key: str = "page_id", entity_key: str = "entity_id") -> DataFrame:
    """Adds ``boxes``: where a page's elements show an entity: by selector, by an input's value, then by text (ignoring case if need be).

    Values meet texts in the page's automata, selectors by an equi-join. Boxes nearly on an earlier one (corner within 2, size
    within 4) are dropped in order, which needs the list at hand: it is a fold over one entity's few boxes.
    """
    e = entities.select(key, F.col(entity_key).alias("__entity"), F.col("value").alias("__v"), F.lower("value").alias("__low"), F.col("dom_selector").alias("__selector"))
    v = elements.select(key, "idx", F.col("selector").alias("__selector"), "is_input", F.col("value").alias("__value"), F.col("text").alias("__text"), F.lower("text").alias("__lower"), "rect").where((F.col("rect.width") > 0) & (F.col("rect.height") > 0))
    named = v.where("__selector != ''").join(e, [key, "__selector"]).select(key, "idx", "__entity", F.lit(0).alias("__how"))
    held = lambda texts, text, value, how: value_hits(texts, e, (key,), "idx", text, "__entity", value).select(key, "idx", "__entity", F.lit(how).alias("__how"))
    ways = [named, held(v.where("is_input"), "__value", "__v", 1), held(v, "__text", "__v", 2), held(v, "__lower", "__low", 3)]
    met = functools.reduce(DataFrame.union, ways).groupBy(key, "idx", "__entity").agg(F.min("__how").alias("__how")).join(v.select(key, "idx", "rect"), [key, "idx"])
    lists = met.groupBy(key, "__entity").agg(F.array_sort(F.collect_list(F.struct("__how", "idx", "rect"))).alias("__l"))
    # text found ignoring case counts only where no exact text was found; a selector alone decides
    sure = F.exists("__l", lambda x: x["__how"] == 0)
    exact = F.exists("__l", lambda x: x["__how"] == 2)
    kept = F.filter("__l", lambda x: F.when(sure, x["__how"] == 0).otherwise((x["__how"] < 3) | ~exact))
    near = lambda a, b: (F.abs(a["x"] - b["x"]) < 2) & (F.abs(a["y"] - b["y"]) < 2) & (F.abs(a["width"] - b["width"]) < 4) & (F.abs(a["height"] - b["height"]) < 4)
    box = "array<struct<x:double,y:double,width:double,height:double>>"
    boxes = F.aggregate(F.transform(kept, lambda x: x["rect"]), F.array().cast(box), lambda acc, b: F.when(F.exists(acc, lambda a: near(a, b)), acc).otherwise(F.concat(acc, F.array(b)).cast(box)))
    found = lists.select(key, F.col("__entity").alias(entity_key), boxes.alias("boxes"))
    return entities.join(found, [key, entity_key], "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(box)))
