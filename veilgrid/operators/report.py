"""Reports over entities, and the metrics of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions import fixed
from veilgrid.operators.detect import level_order


def _names(spark, names: tuple[str, ...], column: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def counts_by(found: DataFrame, column: str, names: tuple[str, ...], out: str = "n") -> DataFrame:
    """Counts of a column's values, 0 for those that don't occur; only the counts meet the list of names."""
    counts = found.groupBy(column).agg(F.count("*").alias("__n"))
    return _names(found.sparkSession, names, column).join(counts, column, "left").select(column, F.coalesce("__n", F.lit(0)).cast("long").alias(out))


def page_counts(found: DataFrame, keys: tuple[str, ...], categories: tuple[str, ...] = fixed.CATEGORIES) -> DataFrame:
    """A map of counts by category for each page, 0 for those that don't occur, and OTHER for names outside the list."""
    return found.groupBy(*keys).agg(_counts_of(categories).alias("counts"))


def _counts_of(categories: tuple[str, ...]) -> Column:
    one = lambda c: F.count(F.when(F.col("type") == c, 1))
    other = F.count(F.when(~F.col("type").isin(*categories), 1))
    pairs = [x for c in categories for x in (F.lit(c), one(c))] + [F.lit("OTHER"), other]
    return F.create_map(*pairs)


def safe_to_transmit(pages: DataFrame, scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Whether no entity of a page is HIGH or above; pages without entities are safe."""
    worst = scored.groupBy(*keys).agg(F.max(level_order(F.col("level"))).alias("__w"))
    return pages.select(*keys).join(worst, list(keys), "left").select(*keys, (F.coalesce("__w", F.lit(0)) < 2).alias("is_safe"))


def sources_of(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return found.groupBy(*keys).agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count_distinct("source").alias("n_sources"))


def privacy_report(found: DataFrame, scored: DataFrame, redactions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each page with entities: counts, highest level, redactions, and whether it may leave."""
    level_of = level_order(F.col("level"))
    none, no, yes = F.lit(None).cast("int"), F.lit(False), F.lit(True)
    # each frame fills its own columns, so that one aggregation does for all three
    row = lambda df, kind, level, entity, redaction: df.select(*keys, kind.cast("string").alias("type"), level.alias("__level"), entity.alias("__entity"), redaction.alias("__redaction"))
    if scored is found:
        rows = row(found, F.col("type"), level_of, yes, no)
    else:
        rows = row(found, F.col("type"), none, yes, no).unionByName(row(scored, F.lit(None), level_of, no, no))
    rows = rows.unionByName(row(redactions, F.lit(None), none, no, yes))
    total = rows.groupBy(*keys).agg(
        F.count_if("__entity").alias("entities"), _counts_of(fixed.CATEGORIES).alias("counts"), F.coalesce(F.max("__level"), F.lit(0)).alias("__worst"), F.count_if("__redaction").alias("redactions")
    )
    level = F.element_at(F.array(*[F.lit(x) for x in fixed.LEVELS]), F.col("__worst") + 1)
    return total.where("entities > 0").select(*keys, "entities", "counts", level.alias("overall_risk"), "redactions", (F.col("__worst") < 2).alias("is_safe"))


def popup_groups(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Totals of the summary's five groups."""
    n = lambda *kinds: F.count(F.when(F.col("type").isin(*kinds), 1))
    other = ("NAME", "ADDRESS", "USERNAME", "CREDIT_CARD", "BANK_ACCOUNT", "GOVERNMENT_ID", "MEDICAL_ID", "DATE_OF_BIRTH", "FINANCIAL_DATA", "OTHER")
    return found.groupBy(*keys).agg(n("EMAIL").alias("emails"), n("PHONE").alias("phones"), n("PASSWORD", "API_KEY").alias("passwords"), n("AUTH_TOKEN").alias("tokens"), n(*other).alias("others"))


def safety(total: Column, risk: Column) -> Column:
    return F.when((total > 5) | (risk == "CRITICAL"), "danger").when((total > 2) | (risk == "HIGH"), "warning").otherwise("safe")


def shares(counts: DataFrame) -> DataFrame:
    """``counts(type, n)`` that aren't 0 with percentage and the bar's class.

    The total is one number, taken as a scalar instead of a window over all rows.
    """
    some = counts.where("n > 0")
    total = some.agg(F.sum("n").alias("t")).select("t").scalar()
    pct = F.col("n") * 100.0 / total
    return some.withColumn("pct", F.round(pct, 6)).withColumn("bar", F.when(pct < 30, "safe").when(pct < 60, "warning").otherwise("danger"))


def gauge(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Fill of the gauge, (n - 1) / 30 within 0 and 1, and counts of the three upper levels."""
    n = lambda level: F.count(F.when(F.col("level") == level, 1))
    rows = scored.groupBy(*keys).agg(F.count("*").alias("n"), n("CRITICAL").alias("critical"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"))
    return rows.withColumn("ratio", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("n") - 1) / 30)), 9))


def top_entities(scored: DataFrame, n: int = 30, by_confidence: bool = False, ties: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """The n entities of the highest level (then confidence), ties in the given order."""
    order = [F.desc("__l"), *([F.desc("confidence")] if by_confidence else []), *ties]
    return scored.withColumn("__l", level_order(F.col("level"))).orderBy(*order).limit(n).drop("__l")


def top_by_page(scored: DataFrame, keys: tuple[str, ...], n: int, ties: tuple[str, ...] = ("pos",)) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(level_order(F.col("level"))), *ties))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def multilabel_counts(truth: DataFrame, predicted: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """``truth(id, label)``, ``predicted(id, type)`` -> tp, fp, fn, tn of each category, one against the rest.

    Counts come from grouped sums alone; no row for each sample and category is made.
    """
    p = predicted.select("id", "type").distinct()
    hits = p.join(truth, "id").groupBy(F.col("type").alias("category")).agg(F.count(F.when(F.col("type") == F.col("label"), 1)).alias("tp"), F.count("*").alias("marked"))
    support = truth.groupBy(F.col("label").alias("category")).agg(F.count("*").alias("support"))
    total = truth.agg(F.count("*").alias("n")).select("n").scalar()
    rows = _names(truth.sparkSession, categories, "category").join(support, "category", "left").join(hits, "category", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = rows.select("category", z("tp").alias("tp"), (z("marked") - z("tp")).alias("fp"), (z("support") - z("tp")).alias("fn"), z("support").alias("support"))
    return rows.withColumn("tn", (total - F.col("tp") - F.col("fp") - F.col("fn")).cast("long"))


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1, 0 where a divisor is 0."""
    rows = counts.withColumn("precision", _over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _over(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", _over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary_metrics(metrics: DataFrame, digits: int = 9) -> DataFrame:
    """Macro and weighted means of the classes' metrics."""
    w = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / F.greatest(F.sum("support"), F.lit(1)), digits)
    return metrics.agg(*[F.round(F.avg(c), digits).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[w(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def hit_rate(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of samples whose label is among the predicted types."""
    p = predicted.select("id", F.col("type").alias("label")).distinct().withColumn("__hit", F.lit(1))
    return truth.join(p, ["id", "label"], "left").agg(F.count("*").alias("samples"), F.count("__hit").alias("correct")).withColumn("accuracy", F.round(_over(F.col("correct"), F.col("samples")), 9))


def confusion(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``pairs(true, pred)`` -> a row for each true label with a column for each predicted one."""
    table = pairs.groupBy("true").pivot("pred", list(labels)).count()
    rows = _names(pairs.sparkSession, labels, "true").join(table, "true", "left")
    return rows.select("true", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("long").alias(x) for x in labels])


def agreement(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """``(key, label, score)`` of two implementations: rate of equal labels, largest and mean difference of scores."""
    j = a.select(key, F.col("label").alias("la"), F.col("score").alias("sa")).join(b.select(key, F.col("label").alias("lb"), F.col("score").alias("sb")), key)
    gap = F.abs(F.col("sa") - F.col("sb"))
    return j.agg(F.count("*").alias("n"), F.round(F.avg((F.col("la") == F.col("lb")).cast("double")), 9).alias("match_rate"), F.round(F.max(gap), 9).alias("max_gap"), F.round(F.avg(gap), 9).alias("mean_gap"))
