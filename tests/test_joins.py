"""Joins inside pages: boxes on grids, values by automata, redaction by places, matching by rounds."""

import random

import pytest
from pyspark.sql import functions as F

from veilgrid.functions.text import contains_box, iou
from veilgrid.operators import boxes, matching, redact, risk, spans, values

BOX = "struct<x: double, y: double, width: double, height: double>"


def page(spark, rows, name):
    return spark.createDataFrame(rows, f"page int, {name} int, {name}_box {BOX}")


def drawn(rng, n, pages=2, places=40):
    size = lambda: rng.choice([0.0, 1.0, 2.0, 3.5, 8.0, 16.0, 15.9, 33.0, 1e-3, 700.0])
    at = lambda: rng.choice([rng.randint(-places, places), rng.uniform(-places, places)])
    box = lambda: rng.choice([None, *[(float(at()), float(at()), size(), size())] * 12, (None, 1.0, 2.0, 3.0), (1.0, 2.0, -3.0, 4.0)])
    return [(rng.randrange(pages), i, box()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_grids_find_what_all_pairs_find(spark, seed):
    rng = random.Random(seed)
    a, b = page(spark, drawn(rng, 300), "a"), page(spark, drawn(rng, 300), "b")
    pairs = lambda df: sorted((r.page, r.a, r.b) for r in df.select("page", "a", "b").collect())
    every = a.join(b, "page")
    p, q = F.col("a_box"), F.col("b_box")
    every = every.where(" AND ".join(f"{b}_box.{c} IS NOT NULL" for b in "ab" for c in "xy"))
    sized = (p["width"] > 0) & (p["height"] > 0) & (q["width"] > 0) & (q["height"] > 0)
    want = pairs(every.where(sized & (iou(p, q) > 0.5)))
    assert pairs(boxes.overlapping(a, b, ("page",), "a_box", "b_box")) == want and len(want) > 5
    real = (p["width"] >= 0) & (p["height"] >= 0) & (q["width"] >= 0) & (q["height"] >= 0)
    want = pairs(every.where(real & contains_box(q, p)))
    assert pairs(boxes.containing(a, b, ("page",), "a_box", "b_box")) == want and len(want) > 50


def test_pairs_of_a_page_grow_linearly(spark):
    """A page of 50,000 boxes in rows: what is compared follows their number, and lies in many tasks' keys."""

    def compared(n):
        at = F.struct((F.col("id") % 100 * 24.0).alias("x"), (F.floor(F.col("id") / 100) * 18.0).alias("y"), F.lit(20.0).alias("width"), F.lit(14.0).alias("height"))
        els = spark.range(n).select(F.lit(1).alias("page"), F.col("id").cast("int").alias("b"), at.alias("b_box"))
        ents = els.where("b % 5 = 0").select("page", F.col("b").alias("a"), F.struct((F.col("b_box.x") + 1).alias("x"), (F.col("b_box.y") + 1).alias("y"), F.lit(18.0).alias("width"), F.lit(12.0).alias("height")).alias("a_box"))
        near, around = (f(ents, els, ("page",), "a_box", "b_box").count() for f in (boxes.near_pairs, boxes.around_pairs))
        assert boxes.overlapping(ents, els, ("page",), "a_box", "b_box").count() == boxes.containing(ents, els, ("page",), "a_box", "b_box").count() == n // 5
        return near, around

    small, large = compared(10_000), compared(50_000)
    for x, y in zip(small, large, strict=True):
        assert y <= 5.5 * x and y < 50_000 * 10


def brute_hits(texts, vals):
    return sorted((p, n, i, t.index(v) + 1) for p, n, t in texts if t for q, i, v in vals if p == q and v and v in t)


@pytest.mark.parametrize("sizes", [(2000, 10_000), (3, 4), (1, 1)])
def test_values_in_texts(spark, sizes):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abé\U0001f600") for _ in range(k))
    texts = [(rng.randrange(4), i, rng.choice([word(rng.randint(0, 12)), None])) for i in range(120)] + [(9, 1, "alone")]
    vals = [(rng.randrange(4), i, rng.choice([word(rng.randint(0, 3)), None])) for i in range(60)] + [(8, 1, "alone")]
    t, v = spark.createDataFrame(texts, "page int, node int, text string"), spark.createDataFrame(vals, "page int, item int, value string")
    got = values.value_hits(t, v, ("page",), "node", "text", "item", "value", sizes)
    assert sorted(tuple(r) for r in got.collect()) == brute_hits(texts, vals)
    assert got.columns == ["page", "node", "item", "at"]
    assert values.value_hits(t.limit(0), v, ("page",), "node", "text", "item", "value").count() == 0


def test_values_of_several_keys_and_kinds(spark):
    t = spark.createDataFrame([("s", 1, "x", "abcab")], "site string, page int, node string, text string")
    v = spark.createDataFrame([("s", 1, (1, "A"), "ab"), ("s", 1, (2, "B"), "ab"), ("s", 2, (3, "C"), "ab"), (None, 1, (4, "D"), "ab")], "site string, page int, item struct<pos: int, type: string>, value string")
    got = values.value_hits(t, v, ("site", "page"), "node", "text", "item", "value").collect()
    assert sorted((r.node, r["item"].pos, r["item"].type, r["at"]) for r in got) == [("x", 1, "A", 1), ("x", 2, "B", 1)]


def one_after_another(edges):
    a, b, out = set(), set(), []
    for x, y in sorted(set(edges)):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            out.append((x, y))
    return out


@pytest.mark.parametrize("rounds", [1, 12])
def test_matching_by_rounds_is_that_in_order(spark, rounds):
    rng = random.Random(rounds)
    edges = {
        "random": [(rng.randrange(30), rng.randrange(30)) for _ in range(150)],
        "chain": [(i, j) for i in range(40) for j in (i, i + 1)],
        "all": [(i, j) for i in range(15) for j in range(15)],
        "one": [(3, 4), (3, 4)],
    }
    rows = [(k, *e) for k, es in edges.items() for e in es] + [(None, 1, 1), ("one", None, 1), ("one", 7, None)]
    df = spark.createDataFrame(rows, "page string, a int, b int").repartition(3)
    got = matching.first_free(df, ("page",), "a", "b", rounds).collect()
    for k, es in edges.items():
        assert sorted((r.a, r.b) for r in got if r.page == k) == one_after_another(es)
    assert {r.page for r in got} == set(edges)
    assert matching.first_free(df.limit(0), ("page",), "a", "b").count() == 0


def test_values_are_prepared_once_a_row(spark):
    """No pattern is replaced for each pair, let alone for each character of a pair."""
    rows = spark.createDataFrame([(1, "T", 0, "Oak-Street", (0.0, 0.0, 1.0, 1.0)), (1, "T", 1, "oak street", (9.0, 9.0, 1.0, 1.0)), (1, "T", 2, "elm", (20.0, 20.0, 1.0, 1.0))], "page_id int, type string, pos int, value string, bbox struct<x: double, y: double, width: double, height: double>")
    df = matching.candidate_pairs(rows, rows)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 8
    assert sorted((r.dom_pos, r.ocr_pos, r.value_score) for r in df.collect()) == [(0, 0, 1.0), (0, 1, 0.95), (1, 0, 0.95), (1, 1, 1.0), (2, 2, 1.0)]


def replaced(text, vals, by):
    for v, b in zip(vals, by, strict=True):
        text = text.replace(v, b) if v else text
    return text


def test_rebuilt_texts_are_those_of_replacing_in_order():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        vals = [rng.choice(["", *["".join(rng.choice("abc" if rng.random() < 0.97 else "[]R") for _ in range(rng.randint(1, 5)))] * 5]) for _ in range(rng.randint(0, 9))]
        by = [rng.choice(["[RED]", "[X]"]) for _ in vals]
        for order in (vals, sorted(vals, key=len, reverse=True)):
            assert spans.rebuilt(text, order, by) == replaced(text, order, by), (text, order)


def test_places_in_a_text():
    assert spans.taken("x1234y12", ["1234", "12"]) == [(1, 5, 0), (6, 8, 1)]
    assert spans.taken("aaaa", ["aa", "a"]) == [(0, 2, 0), (2, 4, 0)]
    assert spans.taken("abab\U0001f600ab", ["", "ab"]) == [(0, 2, 1), (2, 4, 1), (5, 7, 1)]
    assert spans.taken("", ["a"]) == spans.taken("a", []) == []


def test_many_findings_in_one_text(spark):
    """10,000 findings in a text of a megabyte: one pass, not one for each."""
    vals = [f"user{i:05d}@mail.test" for i in range(10_000)]
    text = " and ".join(vals) + "!"
    df = spark.createDataFrame([(1, text + " " + "filler " * 100_000), (2, None), (3, "nothing")], "doc_id long, text string")
    found = spark.createDataFrame([(1, k, "EMAIL", v) for k, v in enumerate(vals)] + [(2, 0, "EMAIL", "x")], "doc_id long, pos int, type string, value string")
    got = {r.doc_id: r.safe_text for r in redact.redact_documents(df, found, style="redacted").collect()}
    assert got[1].startswith("[EMAIL_REDACTED] and [EMAIL_REDACTED] and ") and got[1].count("[EMAIL_REDACTED]") == 10_000 and "@" not in got[1]
    assert got[2] is None and got[3] == "nothing"
    s = redact.redaction_spans(df, found, style="redacted").orderBy("start").collect()
    assert len(s) == 10_000 and all(text[r.start : r.end] == r.value for r in s[:500])


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.test now", 5, 6)], "doc_id long, text string, __e int, __key int")
    found = spark.createDataFrame([(1, 0, "EMAIL", "a@b.test")], "doc_id long, pos int, type string, value string")
    r = redact.redact_documents(df, found, style="type").first()
    assert (r.safe_text, r["__e"], r["__key"]) == ("mail [EMAIL] now", 5, 6)


ELEMENT = "page_id int, idx int, tag_name string, text string, type string, name string, placeholder string, value string, id string, class_name string, selector string, autocomplete string, aria_label string, input_type string, is_visible boolean, is_input boolean, is_button boolean, is_link boolean, rect " + BOX


def element(idx, text=None, value=None, selector=None, rect=None, is_input=False, name=None):
    return (1, idx, "input" if is_input else "div", text, None, name, None, value, None, None, selector, None, None, "text", True, is_input, False, False, rect)


def test_elements_and_entities_of_a_page(spark):
    els = spark.createDataFrame([
        element(0, text="Write to Ann@Post.test today", rect=(0.0, 0.0, 200.0, 20.0), name="email"), element(1, value="ann@post.test", selector="#mail", rect=(0.0, 30.0, 80.0, 20.0), is_input=True),
        element(2, text="call 555 or 5556", rect=(0.0, 60.0, 0.0, 0.0)), element(3, text="ann@post.test!", rect=(300.0, 0.0, 80.0, 20.0)), element(4, text="", selector="#none", rect=(0.0, 90.0, 80.0, 20.0), name="password"),
    ], ELEMENT)
    ents = spark.createDataFrame([
        (1, "e0", 0, "EMAIL", "ann@post.test", None, (1.0, 31.0, 78.0, 18.0)), (1, "e1", 1, "PHONE", "555", "#none", (500.0, 500.0, 5.0, 5.0)), (1, "e2", 2, "NAME", "absent", "", None), (1, "e3", 3, "PHONE", "5556", None, (2.0, 91.0, 10.0, 10.0)),
    ], f"page_id int, entity_id string, pos int, type string, value string, dom_selector string, bbox {BOX}").withColumn("confidence", F.lit(0.5))
    shown = {r.idx: r.sensitive_fields for r in matching.sensitive_elements(els, ents).collect()}
    assert shown == {1: ["EMAIL"], 2: ["PHONE"], 3: ["EMAIL"], 4: ["PHONE"]}
    places = {r.entity_id: [(b.x, b.y) for b in r.boxes] for r in matching.locate(ents, els).collect()}
    assert places == {"e0": [(0.0, 30.0), (300.0, 0.0)], "e1": [(0.0, 90.0)], "e2": [], "e3": []}
    changes = {r.idx: (r.field, r.after) for r in redact.redact_elements(els, ents).collect()}
    assert changes[1][0] == "value" and changes[2][1].startswith("call [PHONE") and changes[2][1].endswith("] or 5556") and set(changes) == {1, 2, 3, 4}
    context = {r.entity_id: r.dom_context for r in risk.dom_context(ents, els).collect()}
    scores = {r.idx: r.s for r in els.select("idx", risk.element_score(F.struct(*els.columns)).alias("s")).collect()}
    assert context["e1"] == scores[4] == context["e3"] != 0.4 and context["e2"] == 0.4
