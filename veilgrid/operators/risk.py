"""Risk scores of entities and pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions import fixed
from veilgrid.functions.patterns import java
from veilgrid.operators.boxes import containing
from veilgrid.operators.detect import level_order


def lookup(key: Column, table: dict[str, float | str], default: float | str) -> Column:
    """The value of a key: one test for each different value, which keeps generated code small."""
    out = F.lit(default)
    for value in dict.fromkeys(table.values()):
        out = F.when(key.isin(*[k for k, v in table.items() if v == value]), F.lit(value)).otherwise(out)
    return out


def sensitivity(kind: Column) -> Column:
    return lookup(kind, fixed.SENSITIVITY, fixed.DEFAULT_SENSITIVITY)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def page_sensitivity(page_type: Column) -> Column:
    return lookup(page_type, fixed.PAGE_SENSITIVITY, fixed.DEFAULT_PAGE)


def semantic(text: Column, mode: str = "lib") -> Column:
    """0.5 without any term, else moved by high and low terms; terms count inside words unless the mode is strict."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def count(terms: tuple[str, ...]) -> Column:
        if mode == "strict":
            return sum((low.rlike(java("{L}" + t.replace(" ", "{s}+") + "{R}")).cast("int") for t in terms), F.lit(0))
        return F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)))

    high = count(fixed.RT_HIGH_TERMS if mode == "rt" else fixed.HIGH_TERMS)
    less = F.lit(0) if mode == "rt" else count(fixed.LOW_TERMS)
    return F.when((high == 0) & (less == 0), 0.5).otherwise(clamp(F.lit(0.5) + F.tanh((high - less) / 3.0) * 0.5))


def level_of(score: Column) -> Column:
    out = None
    for level, least in fixed.LEVEL_FROM.items():
        out = F.when(score >= least, level) if out is None else out.when(score >= least, level)
    return out.otherwise("LOW")


def weights(**changed: float) -> dict[str, float]:
    """The weights with changes, scaled to a sum of 1 if they are off by over 0.001."""
    new = fixed.WEIGHTS | changed
    total = sum(new.values())
    return {k: v / total for k, v in new.items()} if abs(total - 1) > 0.001 else new


def overall(parts: dict[str, Column], by: dict[str, float] | None = None) -> Column:
    """Weighted sum of the parts, added in their fixed order, clamped."""
    by, total = by or fixed.WEIGHTS, None
    for name in fixed.WEIGHTS:
        term = F.lit(by[name]) * parts[name]
        total = term if total is None else total + term
    return clamp(total)


def score(entities: DataFrame, page_type: Column, mode: str = "lib", dom: Column | None = None, fallback: Column | None = None, by: dict[str, float] | None = None) -> DataFrame:
    """Adds the five parts, ``overall`` and ``level`` to entities with type, confidence and context.

    dom is the element's score (a constant without elements); fallback is the page's text, whose first 500
    characters stand in for a missing context.
    """
    said = F.col("context") if fallback is None else F.coalesce(F.when(F.col("context") != "", F.col("context")), F.substring(fallback, 1, 500))
    parts = {
        "entity_sensitivity": sensitivity(F.col("type")), "model_confidence": clamp(F.col("confidence")), "dom_context": F.lit(fixed.DEFAULT_DOM) if dom is None else F.coalesce(dom, F.lit(fixed.DEFAULT_DOM)),
        "page_context": page_sensitivity(page_type), "semantic_context": semantic(said, mode),
    }
    out = entities.select("*", *[c.alias(n) for n, c in parts.items()])
    return out.withColumn("overall", overall({n: F.col(n) for n in parts}, by)).withColumn("level", level_of(F.col("overall")))


def element_score(element: Column) -> Column:
    """What an element (a struct) says about its content: password inputs, then words of its label, then autocomplete."""
    some = lambda c: F.when(element[c] != "", element[c])
    label = F.concat_ws(" ", *[some(c) for c in ("placeholder", "aria_label", "name", "id", "class_name", "text")])
    out = F.when(element["is_input"] & (element["input_type"] == "password"), 1.0)
    for words, value in fixed.ELEMENT_TIERS:
        out = out.when(label.rlike("(?i)" + "|".join(words)), value)
    for part, value in fixed.ELEMENT_AUTOCOMPLETE:
        out = out.when(F.contains(F.lower(some("autocomplete")), F.lit(part)), value)
    return out


def dom_context(entities: DataFrame, elements: DataFrame, keys: tuple[str, ...] = ("page_id",), entity_key: str = "entity_id", strict: bool = False) -> DataFrame:
    """Adds ``dom_context``: the score of the element with the entity's selector, else of the first element around its box.

    Selectors meet by an equi-join, boxes on grids, so a page's boxes aren't all compared.  strict leaves boxes without width
    out; otherwise they are points.
    """
    e = elements.select(*keys, F.col("idx").alias("__idx"), F.col("selector").alias("__selector"), F.col("rect").alias("__rect"), element_score(F.struct(*elements.columns)).alias("__score")).where("__score is not null")
    n = entities.select(*keys, F.col(entity_key).alias("__entity"), F.col("dom_selector").alias("__selector"), F.col("bbox").alias("__box"))
    # elements are tried by selector first; only the first element with the selector counts
    found = lambda df, later: df.select(*keys, "__entity", F.struct(F.lit(later).alias("later"), F.col("__idx").alias("idx"), F.col("__score").alias("score")).alias("__found"))
    named = found(n.where("__selector != ''").join(e, [*keys, "__selector"]), False)
    boxed = (n.where("__box.width > 0") if strict else n).select(*keys, "__entity", "__box")
    around = found(containing(boxed, e.select(*keys, "__idx", "__score", "__rect"), keys, "__box", "__rect"), True)
    best = named.union(around).groupBy(*keys, "__entity").agg(F.min("__found").alias("__found"))
    best = best.select(*keys, F.col("__entity").alias(entity_key), F.col("__found.score").alias("dom_context"))
    return entities.drop("dom_context").join(best, [*keys, entity_key], "left").withColumn("dom_context", F.coalesce("dom_context", F.lit(fixed.DEFAULT_DOM)))


def page_risk_mean(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Level of the mean of overall, weighted by sensitivity."""
    mean = F.sum(F.col("overall") * F.col("entity_sensitivity")) / F.sum("entity_sensitivity")
    return scored.groupBy(*keys).agg(mean.alias("mean")).select(*keys, F.round("mean", 9).alias("mean_risk"), level_of(F.round("mean", 12)).alias("overall_risk"))


def page_risk_max(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The highest level."""
    top = F.element_at(F.array(*[F.lit(x) for x in fixed.LEVELS]), F.max(level_order(F.col("level"))) + 1)
    return scored.groupBy(*keys).agg(top.alias("overall_risk"))


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
