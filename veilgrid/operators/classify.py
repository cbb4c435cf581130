"""Page types by rules, as column expressions: every rule is a term of one projection, so no rows are multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.patterns import java
from veilgrid.operators.page_rules import ADDITIVE, WEIGHTED


def _some(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike(java("(?i)" + "|".join(patterns)))


def element_matches(element: Column, where: str, part: str) -> Column:
    """Whether an element (a struct) has a signal: part of its class or name, an input of a type, or a form."""
    low = lambda c: F.lower(F.coalesce(element[c], F.lit("")))
    if where == "class":
        return F.contains(low("class_name"), F.lit(part))
    if where == "name":
        return F.contains(low("name"), F.lit(part))
    if where == "input":
        return (low("tag_name") == "input") & (F.lower(F.coalesce(element["input_type"], element["type"], F.lit(""))) == part)
    return low("tag_name") == "form"


def _exists(elements: Column, where: str, part: str) -> Column:
    return F.exists(elements, lambda e: element_matches(e, where, part))


def weighted_scores(url: Column, title: Column, elements: Column | None, text: Column) -> dict[str, Column]:
    """Score of each type: 0.4 for the URL, 0.25 for the title, 0.15 of each signal's weight, up to 0.2 for keywords; all times the rule's weight."""
    low = F.lower(text)
    out = {}
    for kind, weight, urls, titles, signals, words in WEIGHTED:
        score = F.when(_some(url, urls), F.lit(0.4 * weight)).otherwise(0.0) + F.when(_some(title, titles), F.lit(0.25 * weight)).otherwise(0.0)
        for where, part, value in signals if elements is not None else ():
            score = score + F.when(_exists(elements, where, part), F.lit(value * 0.15 * weight)).otherwise(0.0)
        hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        out[kind] = score + F.least(hits / F.lit(float(len(words))) * 3, F.lit(1.0)) * 0.2 * weight
    return out


def fallback_type(url: Column, title: Column, text: Column) -> Column:
    """For pages that no rule knows."""
    both = F.lower(F.concat_ws(" ", url, title))
    return (
        F.when(both.rlike(r"\.gov\.|\.mil\."), "government").when(both.rlike(r"\.edu\."), "unknown").when(F.contains(text, F.lit("password")), "login")
        .when(both.rlike("checkout|payment|pay"), "payment").when(both.rlike("bank|account"), "banking").when(both.rlike("health|medical"), "healthcare").otherwise("unknown")
    )


def classify_weighted(df: DataFrame, elements_col: str | None = None, out: str = "page_type") -> DataFrame:
    """Adds the page type to ``df(url, title, visible_text, ...)``: the best score, the fallback below 0.1, and payment for a shop that is nearly as much a checkout."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    scores = weighted_scores(blank("url"), blank("title"), F.col(elements_col) if elements_col else None, blank("visible_text"))
    rows = df.withColumn("__s", F.struct(*[F.round(c, 12).alias(k) for k, c in scores.items()]))
    best = F.greatest(*[F.col(f"__s.{k}") for k in scores])
    first = F.coalesce(*[F.when(F.col(f"__s.{k}") == F.col("__best"), F.lit(k)) for k in scores])
    rows = rows.withColumn("__best", best).withColumn("__first", first)
    checkout = (F.col("__best") > 0.3) & (F.col("__first") == "ecommerce") & (F.col("__s.payment") > F.col("__best") * 0.8)
    kind = F.when(F.col("__best") < 0.1, fallback_type(blank("url"), blank("title"), blank("visible_text"))).when(checkout, "payment").otherwise(F.col("__first"))
    return rows.withColumn(out, kind).drop("__s", "__best", "__first")


def classify_additive(df: DataFrame, hints: Column | None = None, out: str = "page_type") -> DataFrame:
    """Adds the page type by counting: 3 for each URL pattern, 2 for it in the title, 1 for each keyword in the first 5000
    characters and in the title, 2 for each form hint."""
    blank = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    url, title, body = blank("url"), blank("title"), F.lower(F.substring(F.coalesce(F.col("visible_text"), F.lit("")), 1, 5000))
    form = F.lower(F.coalesce(hints, F.lit(""))) if hints is not None else F.lit("")
    one = lambda test, n: F.when(test, n).otherwise(0)
    scores = {}
    for kind, urls, words, fields in ADDITIVE:
        terms = [one(url.rlike(java("(?i)" + p)), 3) + one(title.rlike(java("(?i)" + p)), 2) for p in urls]
        terms += [one(F.contains(body, F.lit(w)), 1) + one(F.contains(title, F.lit(w)), 1) for w in words] + [one(F.contains(form, F.lit(h)), 2) for h in fields]
        scores[kind] = sum(terms[1:], terms[0])
    rows = df.withColumn("__s", F.struct(*[c.alias(k) for k, c in scores.items()]))
    rows = rows.withColumn("__best", F.greatest(*[F.col(f"__s.{k}") for k in scores]))
    first = F.coalesce(*[F.when(F.col(f"__s.{k}") == F.col("__best"), F.lit(k)) for k in scores])
    return rows.withColumn(out, F.when(F.col("__best") > 0, first).otherwise("unknown")).drop("__s", "__best")
