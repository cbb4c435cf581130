"""Streams that stop and go on, exports that fail, block lists as tables, and what SQL says pages show."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veilgrid.operators import block_rules, firewall
from veilgrid.plans.page_sql import PAGE_TEXT
from veilgrid.sources import export, html
from veilgrid.streaming import changes


def entries(spark, rows):
    return spark.createDataFrame(rows, "source string, ts long, id long, level string, message string").withColumn("ts", F.timestamp_seconds("ts"))


def ring(spark, tmp_path, keep):
    schema = entries(spark, []).schema
    with changes.with_rocksdb(spark):
        stream = changes.read_stream(spark, str(tmp_path / "in"), schema, 1)
        changes.run_merged(changes.audit_ring(stream, keep=keep), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    parts = changes.merged(spark, str(tmp_path / "out"))
    last = parts.groupBy(F.col("source").alias("s")).agg(F.max("batch").alias("b"))
    return {(r.source, r.id, r.message) for r in parts.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b"))).collect()}


def test_audit_ring_over_restarts(spark, tmp_path):
    """Late entries find their place; tabs and nulls stay as they are; equal times go by id."""
    rng, every = random.Random(1), []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for lot in range(3):
        rows = [(rng.choice(["a", "b", None]), rng.randrange(20), 100 * lot + k, "in\tfo", rng.choice([f"m\t{k}", None])) for k in range(40)]
        every += rows
        entries(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
        want = set()
        for s in ("a", "b", None):
            mine = sorted((r for r in every if r[0] == s), key=lambda r: (r[1], r[2]))
            want |= {(r[0], r[2], r[4]) for r in mine[-7:]}
        assert ring(spark, tmp_path, 7) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    rows, counted = spark.range(10).select(F.col("id").alias("v")), []

    def total(batch):
        counted.append(1)
        return batch.agg(F.sum("v").alias("total"))

    for lot in range(2):
        rows.where(F.col("v") % 2 == lot).write.mode("append").parquet(str(tmp_path / "in"))
        stream = changes.read_stream(spark, str(tmp_path / "in"), rows.schema)
        for again in (False, True, True):
            if again:
                changes.forget_last_commit(spark, str(tmp_path / "cp"))
            changes.run_merged(stream, total, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert len(counted) == 6
    parts = changes.merged(spark, str(tmp_path / "out"))
    assert parts.count() == 2 and parts.agg(F.sum("total")).first()[0] == 45


def test_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 100), (1, "a", 50), (2, "b", 60), (3, "c", 70)], "page int, value string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    known = spark.createDataFrame([(3, "c"), (3, "c")], "page int, value string")
    batch = changes.first_seen(rows, ("page", "value"), known).select("page", "value", F.unix_seconds("ts").alias("t"))
    assert sorted(tuple(r) for r in batch.collect()) == [(1, "a", 50), (2, "b", 60)]
    for lot in ((0, 1), (1, 2), (0, 1), (2, 4)):
        spark.createDataFrame(rows.collect()[slice(*lot)], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = changes.read_stream(spark, str(tmp_path / "in"), rows.schema)
        changes.run_once(changes.first_seen(stream, ("page", "value"), known, "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.page, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b")]


def test_exported_files_come_back(spark, tmp_path):
    rows = [("a/b.bin", b"\x00\xff"), ("c.txt", None), ("d.txt", b"d" * 100_000)]
    df = spark.createDataFrame(rows, "file string, content binary").repartition(3)
    path = str(tmp_path / "out")
    assert export.exported_files(spark, path).count() == 0
    export.export_files(df, path)
    export.export_files(spark.createDataFrame([("e.txt", b"e")], "file string, content binary"), path)
    export.export_files(df.limit(0), path)
    got = {r.file: bytes(r.content) for r in export.exported_files(spark, path).collect()}
    assert got == {"a/b.bin": b"\x00\xff", "d.txt": b"d" * 100_000, "e.txt": b"e"}


@pytest.mark.parametrize("bad", [None, "", "/etc/x", "a/../../x"])
def test_a_failed_export_lists_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    export.export_files(spark.createDataFrame([("first", b"1")], "file string, content binary"), path)
    rows = [(f"f{k}", b"x") for k in range(40)] + [(bad, b"y")]
    with pytest.raises(Exception, match="file's name"):
        export.export_files(spark.createDataFrame(rows, "file string, content binary").repartition(4), path)
    assert [r.file for r in export.exported_files(spark, path).collect()] == ["first"]
    export.remove_unlisted(spark, path)
    parts = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1 and [r.file for r in export.exported_files(spark, path).collect()] == ["first"]


def test_many_small_files_are_few_on_the_disk(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(3_000).select(F.concat(F.lit("a/"), F.col("id"), F.lit(".png")).alias("file"), F.when(F.col("id") > 0, F.col("id").cast("string")).cast("binary").alias("content")).repartition(3)
    export.export_files(rows, path, packed=True)
    export.export_files(spark.createDataFrame([("plain", b"p")], "file string, content binary"), path)
    got = {r.file: (r.length, bytes(r.content)) for r in export.exported_files(spark, path).collect()}
    assert got == {f"a/{k}.png": (len(str(k)), str(k).encode()) for k in range(1, 3_000)} | {"plain": (1, b"p")}
    assert sum(f.is_file() and not f.name.startswith(".") for f in (tmp_path / "out").rglob("*")) <= 3 + 1 + 2


LITERALS = {
    r"/private/": "/private/", r"^https?://a\.b/": "://a.b/", r"abc?def": "def", r"abcx*yz": "abc", r"ab+cd": "cd", r"a{2,3}bcd": "bcd", r"x(foo|bar)longer": "longer", r"account/?(?:over|bal)": "account", r"foo|bar": "", r"(?i)secret": "", r"[abc]defg[^x]h": "defg",
    r"\d+\.html$": ".html", r"\Qa.b\E": "", r"\x41bcd": "", r"": "", r"a|bcdefgh": "", r"(a(b)c)?token=\w+": "token=", r"([)])abc": "abc", r"\\path\\": "\\path\\", r"a\|bcd": "a|bcd", r"[[a-c]x]yzzy": "", "wo+rdé": "rdé", r".*": "", r"(abc": "", r"[]x]abcd": "abcd",
}


def test_required_literals(spark):
    df = spark.createDataFrame([(p,) for p in LITERALS] + [(None,)], "p string")
    got = {r.p: r.l for r in df.select("p", block_rules.required_literal(F.col("p")).alias("l")).collect()}
    assert {p: got[p] for p in LITERALS} == LITERALS and got[None] == ""


def rows_and_rules(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("abc/.") for _ in range(rng.randint(1, 8)))
    urls = [(i, rng.choice(["https://", "http://"]) + part() + "/" + part()) for i in range(150)] + [(900, None), (901, "")]
    plain = lambda: re.escape(part()) + rng.choice(["", "$", "[a-c]", "(a|b)", "x?", ".*c"])
    rules = [(i, rng.choice([plain(), plain(), "^" + plain(), "a|b/c", "", None])) for i in range(250)]
    return urls, rules


def test_rules_as_a_table(spark):
    urls, rules = rows_and_rules(spark)
    rows = spark.createDataFrame(urls, "id int, source string").withColumn("__piece", F.lit(1))
    df = block_rules.matching_rules(rows, spark.createDataFrame(rules, "rule_id int, pattern string"))
    got = sorted((r.id, r.rule_id) for r in df.collect())
    assert got == sorted((i, k) for i, u in urls for k, p in rules if u is not None and p is not None and re.search(p, u)) and len(got) > 200
    assert df.columns == ["id", "source", "__piece", "rule_id"]
    assert block_rules.matching_rules(rows, spark.createDataFrame([], "rule_id int, pattern string")).count() == 0


def test_many_rules_have_no_nested_loop(spark):
    rules = spark.range(20_000).select(F.col("id").alias("rule_id"), F.concat(F.lit("/shop/item-"), F.col("id"), F.lit("(/|$)")).alias("pattern"))
    rows = spark.range(2_000).select("id", F.concat(F.lit("https://a.test/shop/item-"), F.col("id") * 20).alias("source"))
    df = block_rules.matching_rules(rows, rules)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.id, r.rule_id) for r in df.collect()) == [(i, i * 20) for i in range(1_000)]


def test_too_many_patterns_without_a_literal_are_refused(spark):
    rules = spark.range(block_rules.MOST_OTHER + 1).select(F.col("id").alias("rule_id"), F.lit("a|b").alias("pattern"))
    with pytest.raises(ValueError, match="no literal"):
        block_rules.matching_rules(spark.createDataFrame([(1, "a")], "id int, source string"), rules)


def test_any_number_of_rules_without_a_literal(spark):
    """Rules of one pattern are tried as one, and a caller may have any number of patterns without a literal."""
    rows = spark.createDataFrame([(1, "t", "a1", "{}"), (2, "t", "q", "{}")], "id int, type string, source string, data string")
    rules = spark.range(block_rules.MOST_OTHER + 1).select(F.col("id").alias("rule_id"), F.lit("path").alias("kind"), F.lit("a|b").alias("value"))
    assert {r.id: r.action for r in block_rules.check_outbound_by_rules(rows, rules).collect()} == {1: "BLOCK", 2: "ALLOW"}
    own = rules.select("rule_id", F.concat(F.lit("a"), F.col("rule_id") % 4, F.lit("|b")).alias("pattern"))
    got = block_rules.matching_rules(rows.select("id", "source"), own, most_other=None)
    assert sorted((r.id, r.rule_id) for r in got.collect()) == [(1, k) for k in range(block_rules.MOST_OTHER + 1) if k % 4 == 1]


def test_check_by_rules_is_check_with_terms(spark):
    urls = [(0, "t", "evil.test", '{"v":"x"}'), (1, "t", "https://a.test/private/x", '{"v":"x"}'), (2, "t", "ok.test", '{"v":"mail me a.b@c.test"}'), (3, "t", None, "{}"), (4, "t", "evil.test/private/", "{}")]
    payloads = spark.createDataFrame(urls, "id int, type string, source string, data string")
    rules = spark.createDataFrame([(1, "domain", "evil.test"), (2, "path", "/private/"), (3, "path", "/priv"), (4, "domain", "evil.test")], "rule_id int, kind string, value string")
    rows = lambda df: sorted((r.id, r.action, r.reason) for r in df.collect())
    assert rows(block_rules.check_outbound_by_rules(payloads, rules)) == rows(firewall.check_outbound(payloads, ("evil.test",), ("/private/", "/priv")))


def test_sql_and_parser_read_the_same_text(small):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    said = {i: (t, v) for i, t, v in con.execute(PAGE_TEXT).fetchall()}
    rows = con.execute("select page_id, html from pages").fetchall()
    for i, h in rows:
        p = html.page_context(html.parse(h))
        assert said[i] == (p["title"], p["visible_text"])
    assert len(rows) == len(said) > 20
