"""Redaction, firewall, pages, models, pictures, stores and streams on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.functions import fixed
from veilgrid.operators import firewall, images, matching, models, redact, report
from veilgrid.plans import scan
from veilgrid.plans.q_pages import FORM_PAGES
from veilgrid.sources import generate, html, stores
from veilgrid.streaming import changes


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_redaction_leaves_no_value(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    s = scan.scan_texts(docs, mode="rt")
    safe = {r.doc_id: r.safe_text for r in s.safe.collect()}
    for r in s.entities.collect():
        assert r.value not in safe[r.doc_id]
    s.release()


def test_longest_first_doesnt_strand_a_tail(spark):
    e = F.array(F.struct(F.lit("PHONE").alias("type"), F.lit("12").alias("value")), F.struct(F.lit("EMAIL").alias("type"), F.lit("1234").alias("value")))
    assert one(spark, redact.redact_text(F.col("t"), e), t="x1234y12") == "x[EMAIL_REDACTED]y[PHONE_REDACTED]"
    assert one(spark, redact.redact_text(F.col("t"), e, "type", "first"), t="x1234y12") == "x[PHONE]34y[PHONE]"


@pytest.mark.parametrize(("kind", "value", "want"), [("PASSWORD", "short", "****"), ("API_KEY", "abcdefghij", "abcd****ghij"), ("EMAIL", "jo@x.de", "j***@x.de"), ("CREDIT_CARD", "4111 1111 1111 1111", "****-****-****-1111"), ("NAME", "Anna Li", "An***i"), ("NAME", "Ann", "****")])
def test_masks(spark, kind, value, want):
    assert one(spark, redact.mask(F.col("v"), F.col("k")), v=value, k=kind) == want


@pytest.mark.parametrize(("url", "want"), [("https://A.test/x/y?q=1#f", "https://a.test/x/y"), ("http://a.test/", "http://a.test"), ("not a url", "not a url"), (None, "")])
def test_scrubbed_url(spark, url, want):
    assert one(spark, redact.scrub_url(F.col("u")), u=url) == want


def test_firewall(spark):
    rows = [(1, "m", "ok", '{"n":"4111-1111-1111-1111"}'), (2, "m", "ok", '"Bearer abc123DEFxyz"'), (3, "m", "ok", '{"instruction":"click the submit button"}'), (4, "m", "bad.test", "{}"), (5, "m", "ok", '"x\\n123-45-6789"')]
    df = spark.createDataFrame(rows, "id long, type string, source string, data string")
    got = {r.id: (r.action, r.detected_fields) for r in firewall.check_outbound(df, ("bad.test",)).collect()}
    assert got[1] == ("REDACT", ["CREDIT_CARD"]) and got[2] == ("REDACT", ["AUTH_TOKEN"]) and got[3][0] == "ALLOW" and got[4][0] == "BLOCK"
    assert got[5] == ("ALLOW", [])  # the escape hides the line's start
    strict = {r.id: r.action for r in firewall.check_outbound(df, strict=True).collect()}
    assert strict[5] == "REDACT"


def test_plans(spark):
    fenced = '```json\n{"answer":"ok","actions":[{"action":"click","target":"#a"},{"action":"fly","target":"#b"},{"action":"type","target":"#p","value":"my password"}]}\n```'
    r = one(spark, firewall.parse_plan(F.col("a")), a=fenced)
    assert r.answer == "ok" and [(a.action, a.direction, a.amount) for a in r.actions] == [("click", "down", 500.0)]
    assert one(spark, firewall.parse_plan(F.col("a")), a="just prose").actions == []
    assert one(spark, firewall.offline_plan(F.col("a")), a="Please sign in") == "press"


def test_log_keys(spark):
    m = F.create_map(F.lit("password"), F.lit("a"), F.lit("url"), F.lit("b"), F.lit("shipping"), F.lit("c"))
    assert one(spark, redact.sanitize_log(m), x="") == {"password": "[REDACTED]", "url": "b", "shipping": "[REDACTED]"}


def test_html():
    login, checkout, contact = (html.page_context(html.parse(p)) for p in FORM_PAGES)
    assert login["title"] == "Sign in" and "secret" not in login["visible_text"] and login["visible_text"].endswith("Hello \n there")
    assert [(f["name"], f["type"], f["label"], f["value"], f["is_password"]) for f in login["form_fields"]] == [("username", "text", "User name", "jsmith88", False), ("pw", "password", "Password", "", True)]
    assert [f["name"] for f in checkout["form_fields"]] == ["card", "country", "note"]
    assert checkout["form_fields"][1]["value"] == "FR" and checkout["form_fields"][0]["label"] == "Card" and "Total $12,500.00" in checkout["visible_text"]
    kinds = [(e["tag_name"], e["type"], e["is_visible"]) for e in contact["elements"]]
    assert ("a", "anchor", False) in kinds and ("span", "role-button", True) in kinds
    assert contact["form_fields"][1]["label"] == "Phone" and contact["visible_text"].startswith("Home")
    assert login["elements"][0]["selector"] == "#u"
    assert html.page_context(html.parse("<p>a<p>b<br>c</div></x>"))["visible_text"] == "a \n b \n c"
    assert html.page_context(html.parse(None))["elements"] == []


def test_page_scans(spark):
    rows = spark.createDataFrame([(i, f"https://site.test/p{i}", h) for i, h in enumerate([*FORM_PAGES, None, ""])], "page_id long, url string, html string")
    for run in (scan.scan_pages_rt, scan.scan_pages_lib):
        s = run(rows)
        got = {(r.page_id, r.type, r.value) for r in s.entities.select("page_id", "type", "value").collect()}
        assert {(1, "CREDIT_CARD", "4111 1111 1111 1111"), (2, "EMAIL", "bob@postbox.net"), (2, "EMAIL", "ann@postbox.net")} <= got
        assert s.report.count() >= 2 and s.redactions.count() > 0
        s.release()
    context = {r.page_id: r for r in scan.sanitized_context(scan.scan_pages_rt(rows)).collect()}
    assert "bob@postbox.net" not in context[2].safe_text and context[0].safe_form_fields[1].type == "password"
    spark.catalog.clearCache()


def test_text_lines_and_word_boxes(spark):
    words = spark.createDataFrame([(1, 0, "Card", 1, 4, 30, 16), (1, 1, "4111111111111111", 31, 4, 130, 16), (1, 2, "call", 1, 20, 25, 32), (1, 3, "555-123-4567", 26, 20, 90, 32)], "page_id long, idx int, text string, x0 double, y0 double, x1 double, y1 double".replace("double", "long"))
    words = matching.ocr_boxes(words.select("page_id", "idx", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))
    e = spark.createDataFrame([(1, "a", 0, "CREDIT_CARD", "4111 1111 1111 1111", "", 0.95, "REGEX")], "page_id long, entity_id string, pos int, type string, value string, context string, confidence double, source string")
    e = e.withColumn("bbox", F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "width", "height")]))
    r = matching.word_boxes(e, words).first()
    assert tuple(r.bbox) == (31.0, 4.0, 99.0, 12.0) and r.source == "OCR" and r.confidence == 1.0
    assert [r.line_text for r in matching.text_lines(words).orderBy("line").collect()] == ["card 4111111111111111", "call 555-123-4567"]


def test_text_model(spark, tmp_path):
    s = generate.generate_samples(spark, 60).withColumn("split", generate.split_of(generate.value_key(F.col("text"), F.col("label"))))
    model = models.train_from(s, epochs=20)
    test = s.where("split = 'test'").collect()
    right = sum(a[0] == r.label for a, r in zip(model.classify([r.text for r in test]), test, strict=True))
    assert right / len(test) > 0.85
    again = models.TextModel.from_json(model.to_json())
    assert again.classify(["Bearer x"])[0][0] == model.classify(["Bearer x"])[0][0]
    rows = spark.createDataFrame([(1, test[0].text), (2, None)], "id long, text string").select("id", models.predict(spark, model, F.col("text")).alias("p"), models.predict_top(spark, model, F.col("text"), 2).alias("t")).collect()
    assert rows[0].p.label == model.classify([test[0].text])[0][0] and rows[1].p.label is None and len(rows[0].t) == 2
    keys = s.withColumn("k", generate.value_key(F.col("text"), F.col("label"))).groupBy("k").agg(F.count_distinct("split").alias("n"))
    assert keys.where("n > 1").count() == 0


def test_intents(spark):
    rows = generate.generate_intents(spark, 60).collect()
    model = models.train([r.text for r in rows], [r.label for r in rows], tuple(generate.INTENTS), epochs=15, length=32, intent=True)
    assert model.classify(["please click the menu"])[0][0] == "click"


def test_pictures(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (40, 60, 4), dtype=np.uint8)
    boxes = [{"x": 10.0, "y": 10.0, "width": 10.0, "height": 10.0, "method": m} for m in ("mask",)]
    out = np.frombuffer(images.redact_picture(image.tobytes(), 60, 40, boxes), np.uint8).reshape(40, 60, 4)
    assert not out[7:23, 7:23, :3].any() and (out[:7] == image[:7]).all() and (out[:, 23:] == image[:, 23:]).all()
    for method in ("blur", "pixelate", "tokenize", "replace"):
        changed = images.redact_picture(image.tobytes(), 60, 40, [boxes[0] | {"method": method}])
        assert changed != image.tobytes()
    assert images.redact_picture(image.tobytes(), 60, 40, [boxes[0] | {"width": 0.0}]) == image.tobytes()
    df = spark.createDataFrame([(1, 60, 40, image.tobytes(), [(10.0, 10.0, 10.0, 10.0, "mask")])], "id long, w int, h int, rgba binary, boxes array<struct<x:double,y:double,width:double,height:double,method:string>>")
    assert bytes(images.redact_pictures(df).first().redacted) == out.tobytes()


def test_network_against_loops():
    layers = images.random_network(1, 2)
    x = np.random.default_rng(2).random((1, 8, 8))
    w, b = layers[0]["w"], layers[0]["b"]
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    want = np.array([[[sum((padded[:, 2 * i : 2 * i + 3, 2 * j : 2 * j + 3] * w[o]).ravel()) + b[o] for j in range(4)] for i in range(4)] for o in range(2)])
    assert np.allclose(images._apply(layers[0], x), want)


def test_many_pictures_pass_the_network_at_once():
    layers = images.random_network(5, 3)
    x = np.random.default_rng(6).random((7, 1, 10, 12))
    want = []
    for one in x:
        for layer in layers[:-2]:
            one = images._apply(layer, one)
        want.append(1 / (1 + np.exp(-(one.mean(axis=(1, 2)) @ layers[-1]["w"] + layers[-1]["b"])[0])))
    assert np.allclose(images.run_networks(layers, x), want) and np.allclose([images.run_network(layers, one) for one in x], want)


def test_vision(spark):
    rows = generate.generate_crops(spark, 90).collect()
    crops = [np.frombuffer(r.pixels, np.uint8).reshape(48, 96).astype(np.float32) / 255 for r in rows]
    labels = [r.sensitive for r in rows]
    layers = images.fit_last(images.random_network(), crops[:60], labels[:60])
    right = sum((images.run_network(layers, c[None]) >= 0.5) == bool(y) for c, y in zip(crops[60:], labels[60:], strict=True))
    assert right >= 27


def test_settings():
    s = stores.Settings.merged(scan_interval_ms=1, redaction_methods={"EMAIL": "blur"}, nonsense=3, risk_threshold="?")
    assert s.scan_interval_ms == 500 and s.redaction_methods["EMAIL"] == "blur" and s.redaction_methods["PHONE"] == "mask" and s.risk_threshold == "HIGH"
    assert stores.Settings.from_json(s.to_json()) == s


def test_store_limits(spark):
    big = "x" * (fixed.SHOT_BYTES + 1)
    rows = [(str(i), "u", "t", None, i, None, 0, "o", None) for i in range(12)] + [("big", "u", "t", None, 99, None, 0, big, None), ("none", "u", "t", None, 99, None, 0, None, "r")]
    df = spark.createDataFrame(rows, "id string, url string, title string, page_type string, ts long, overall_risk string, entity_count int, original string, redacted string")
    kept = stores.accept_shots(df)
    assert kept.count() == 12 and {r.id for r in stores.prune_shots(kept).collect()} == {str(i) for i in range(2, 12)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("EMAIL", 1.0)], "category string, f1 double")
    stores.write_results(df, str(tmp_path / "j"))
    stores.write_results(df, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    assert stores.read_images(spark, str(tmp_path)).first().length == 4


def test_streams(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = changes.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    assert stream.isStreaming and len(schema) == 6
    changes.run_once(changes.debounce(stream, "user_id", "30 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = changes.debounce(spark.read.parquet(str(tmp_path / "in")), "user_id", "30 minutes")
    # the watermark holds back bursts that could still grow
    assert 0 < got.count() <= batch.count() and got.join(batch, ["user_id", "first_ts", "last_ts", "n"], "left_anti").count() == 0
    before = got.count()
    changes.run_once(changes.debounce(stream, "user_id", "30 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() >= before


def test_text_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "mail bob@postbox.net")], "doc_id long, text string").withColumn("ts", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    stream = changes.read_stream(spark, str(tmp_path / "in"), rows.schema)
    changes.run_once(changes.scan_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.type, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("EMAIL", "bob@postbox.net")]


def test_a_failing_classifier_gives_null(spark):
    class Moody:
        def classify(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [("EMAIL", float(len(t))) for t in texts]

    texts = ["a", "bad", None, "abc", "very bad", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).select("id", models.classify_with(Moody(), F.col("text")).alias("p")).orderBy("id").collect()
    assert [r.p.label for r in got] == ["EMAIL", None, None, "EMAIL", None, "EMAIL"]
    assert got[0].p.score == 1 and got[3].p.score == 3


def test_release_lets_all_go(spark):
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = kept()
    for run in (scan.scan_pages_rt, scan.scan_pages_lib):
        s = run(spark.createDataFrame([(1, "https://site.test/", FORM_PAGES[0])], "page_id long, url string, html string"))
        s.report.collect()
        assert kept() > before
        s.release()
        assert kept() == before


def test_report_of_separate_frames_is_that_of_one(spark, small):
    scored = scan.scan_documents(spark.read.parquet(f"{small}/documents.parquet"))
    red = redact.redaction_actions(scored)
    rows = lambda found: sorted(map(repr, report.privacy_report(found, scored, red, ("doc_id",)).collect()))
    assert rows(scored) == rows(scored.drop("level"))


@pytest.mark.parametrize("run", ["scan_pages_rt", "scan_pages_lib"])
def test_a_scan_never_broadcasts_its_pages(spark, small, run):
    """Spark reckons parsed pages by the size of the file; 900,000 of them went to the driver at its own threshold of 10 MB."""
    from veilgrid.plans.q_pages import form_pages

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        pages = form_pages(spark, small)
        result = getattr(scan, run)(pages)
        plan = result.entities._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.split("\n") if "Join" in x and "Inner" in x]
        assert joins and not any("Broadcast" in x for x in joins)
        result.release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert pages.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
