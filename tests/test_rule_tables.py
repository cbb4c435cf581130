"""Rules as rows, and the search for elements, against what is tried one by one."""

import random

import pytest
from pyspark.sql import functions as F

from veilgrid.functions.text import agent_score
from veilgrid.operators import classify, matching, rule_tables


def pages(spark, n=120):
    rng = random.Random(3)
    words = ["bank", "Account", "balance", "sign in", "login", "cart", "checkout", "pay", "Shop", "price", "add to cart", "onlinebanking", "create account", "gov.", "me", "user", "some", "text", "PASSPORT", "feed", "İnbox", "pan card", "register"]
    text = lambda k: rng.choice([None, "", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, k))) for _ in range(8)]])
    element = lambda: (rng.choice(["input", "form", "div", None]), rng.choice(["account_no", "CVV", "", None]), rng.choice(["Product-card", "cart price", None]), rng.choice(["password", "toggle", None]), rng.choice(["password", ""]))
    rows = [(i, f"https://{rng.choice(words)}.test/{text(2)}", text(3), text(12), [element() for _ in range(rng.randint(0, 4))], text(2)) for i in range(n)]
    return spark.createDataFrame(rows, "page_id int, url string, title string, visible_text string, elements array<struct<tag_name: string, name: string, class_name: string, input_type: string, type: string>>, form_hints string")


def kinds(df):
    return {r.page_id: r.page_type for r in df.select("page_id", "page_type").collect()}


def test_tables_classify_as_terms_do(spark):
    p = pages(spark)
    assert kinds(rule_tables.classify_additive_by_table(p, hints=F.col("form_hints"))) == kinds(classify.classify_additive(p, F.col("form_hints")))
    assert kinds(rule_tables.classify_weighted_by_table(p, "elements")) == kinds(classify.classify_weighted(p, "elements"))
    got = kinds(rule_tables.classify_weighted_by_table(p))
    assert got == kinds(classify.classify_weighted(p)) and len(set(got.values())) > 5
    assert rule_tables.classify_additive_by_table(p).columns == [*p.columns, "page_type"]
    assert rule_tables.classify_additive_by_table(p.limit(0)).count() == 0


def test_thousands_of_rules(spark):
    """The plan doesn't grow with the rules; each page finds its own."""
    rules = [(k, f"type{k}", k, "p", "body", f"word{k} " if k % 3 else f"word{k}[ ,]end", k % 3 == 0, 1.0, float("inf")) for k in range(3_000)]
    p = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("WORD"), F.col("id") * 7, F.lit(" end. ")).alias("visible_text"))
    few = rule_tables.classify_additive_by_table(p, spark.createDataFrame(rules[:10], rule_tables.RULE))
    df = rule_tables.classify_additive_by_table(p, spark.createDataFrame(rules, rule_tables.RULE))
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert size(df) < 2 * size(few)
    assert kinds(df) == {i: f"type{7 * i}" for i in range(300)}


def test_rules_that_can_not_be_found_are_refused(spark):
    for pattern, regex in (("a|b", True), ("", False)):
        rules = spark.createDataFrame([(1, "x", 0, "p", "body", pattern, regex, 1.0, 1.0)], rule_tables.RULE)
        with pytest.raises(ValueError, match="without a literal"):
            rule_tables.classify_additive_by_table(pages(spark, 5), rules)
    none = spark.createDataFrame([(1, "x", 0, "p", "body", None, False, 1.0, 1.0)], rule_tables.RULE)
    assert set(kinds(rule_tables.classify_additive_by_table(pages(spark, 5), none)).values()) == {"unknown"}


def found(df):
    return sorted((r.page_id, r.query_id, r.selector, round(r.score, 6)) for r in df.collect())


def every(e, q, least):
    hay = F.concat_ws(" ", *[F.when(c != "", c) for c in (F.col("label"), F.col("role"), F.col("tag"), F.array_join("sensitive_fields", " "), F.col("selector"))])
    met = q.join(e.withColumn("hay", hay), "page_id").withColumn("score", F.round(agent_score(F.col("hay"), F.col("description")), 9))
    best = met.groupBy("page_id", "query_id").agg(F.max_by(F.struct("selector", "score"), F.struct("score", (-F.col("idx")).alias("i"))).alias("b"))
    return best.select("page_id", "query_id", "b.selector", "b.score").where(F.col("score") >= least)


@pytest.mark.parametrize("least", [0.25, 0.21, 0.1])
def test_elements_are_found_as_if_all_were_scored(spark, least):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé1") for _ in range(rng.randint(1, 7)))
    said = lambda k: " ".join(word() for _ in range(rng.randint(0, k)))
    els = [(p, i, said(3), rng.choice(["button", ""]), rng.choice(["div", None]), rng.choice([[], ["EMAIL"]]), f"#{word()}") for p in range(12) for i in range(15)]
    e = spark.createDataFrame(els, "page_id int, idx int, label string, role string, tag string, sensitive_fields array<string>, selector string")
    q = spark.createDataFrame([(p, k, rng.choice([said(3), said(1).upper(), "", None])) for p in range(14) for k in range(12)], "page_id int, query_id int, description string")
    want = found(every(e, q, least))
    assert found(matching.find_element(e, q, least=least)) == want and len(want) > 10


def test_few_elements_are_scored(spark):
    e = spark.range(4_000).select((F.col("id") % 4).cast("int").alias("page_id"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("field "), F.md5(F.col("id").cast("string"))).alias("__hay"), F.lit("#x").alias("selector"))
    q = spark.range(40).select((F.col("id") % 4).cast("int").alias("page_id"), F.col("id").alias("query_id"), F.concat(F.lit("button "), F.substring(F.md5((F.col("id") * 100).cast("string")), 1, 12)).alias("__said"))
    assert matching.element_pairs(e, q, ("page_id",)).count() < 0.1 * 4_000 * 10
