"""Collocations against counts of every n-gram."""

import random
import re
from collections import Counter

import pytest

from veilgrid.llm import collocations as co
from veilgrid.llm.queries import QUERIES
from veilgrid.llm.workspace import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def every_phrase(rows, most=5):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def expected(rows, most=5, least=100, top=2000, percent=100):
    counts, totals = every_phrase(rows, most)
    frequent = {p: n for p, n in counts.items() if n >= least}
    out = {}
    for (lang, *w), a in frequent.items():
        inside = any(q[0] == lang and len(q) - 1 > len(w) and 100 * b >= percent * a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q))) for q, b in frequent.items())
        if len(w) < 2 or inside:
            continue
        n = totals[lang]
        score, k, left, right = min((1000 * a * n // (x * y), k, x, y) for k in range(1, len(w)) for x, y in [(counts[lang, *w[:k]], counts[lang, *w[k:]])])
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right, n))
    found = []
    for lang, rows_ in out.items():
        found += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y, n) in enumerate(sorted(rows_)[:top])]
    return sorted(found)


def table(spark, rows, schema="lang string, text string"):
    return spark.createDataFrame(rows, schema)


def drawn(seed, n=120):
    rng = random.Random(seed)
    words = ["aa", "b", "É", "c-c", "ſ", "\U0001f600", "z z", "e"]
    text = lambda: "".join(rng.choice(words[: rng.randint(2, 8)]) + rng.choice(["  ", " ", "\t", " ", ". ", "\n", ";", " ", " "]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "en", None, "und", "", "de"]), rng.choice([text(), text().upper(), "Aa B aa b Aa", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("seed,bits", [(1, (22, 24)), (2, (13, 6)), (3, (13, 24)), (4, (16, 6))])
def test_counts_at_any_number_of_buckets(spark, seed, bits):
    """Few buckets and bits only make the filters weak."""
    rows = drawn(seed)
    got = sorted(tuple(r) for r in co.collocations(table(spark, rows).repartition(3), least=12, bits=bits).collect())
    assert got == expected(rows, least=12) and len(got) > 10


def test_frequent_phrases_are_exact(spark):
    rows = drawn(5)
    tables, totals = co.frequent_phrases(Workspace(spark, "test"), table(spark, rows).repartition(4), least=9)
    counts, words = every_phrase(rows)
    for k, t in enumerate(tables, 1):
        assert {(r.lang, *r.phrase.split(" ")): r.n for r in t.collect()} == {p: n for p, n in counts.items() if len(p) == k + 1 and n >= 9}
    assert {r.lang: r.n for r in totals.collect()} == {lang: n for lang, n in words.items() if n}


def test_filters_drop_rare_phrases(spark):
    """Phrases of frequent words that are rare themselves don't leave the tasks."""
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(7)
    rows = [("en", " ".join(rng.choice(words) for _ in range(4000)) + " x y" * 200)]
    ws = Workspace(spark, "test")
    blocks = ws.table(co.blocks(table(spark, rows)), "blocks")
    first = co._pass(ws, blocks, 1, 5, 50, (22, 24), None)
    frequent = first.where("phrase is not null").groupBy("lang", "phrase").agg(co.F.min("h").alias("h"), co.F.sum("n").alias("n")).where("n >= 50")
    shared = tuple(spark.sparkContext.broadcast(x) for x in (co._bucket_bitmap(first, 22, 50, 3), co._frequent_bitmap(frequent, 24)))
    second = co._pass(ws, blocks, 2, 5, 50, (22, 24), shared).where("phrase is not null")
    assert {(r.phrase, r.n) for r in second.collect()} == {("x y", 200), ("y x", 199)}


def test_large_counts_in_small_buckets(spark):
    rows = [("en", "a b " * 700 + "c")] * 3
    for least in (100, 300, 2000):
        got = sorted(tuple(r) for r in co.collocations(table(spark, rows), least=least, bits=(13, 6)).collect())
        assert got == expected(rows, least=least) and got


def test_best_of_each_language(spark):
    rng = random.Random(3)
    rows = [(lang, " ".join(rng.choice("abcdefgh") for _ in range(900))) for lang in ("en", "de")]
    want = expected(rows, least=10, top=5)
    assert sorted(tuple(r) for r in co.collocations(table(spark, rows), least=10, top=5).collect()) == want and len(want) == 10


def test_nearly_as_often(spark):
    rows = [("en", "a b c. " * 95 + "a b. " * 5 + "d e. " * 3)]
    for percent in (100, 90):
        assert sorted(tuple(r) for r in co.collocations(table(spark, rows), least=50, percent=percent).collect()) == expected(rows, least=50, percent=percent)


def test_exact_beyond_64_bits(spark):
    """1000 a n passes 64 bits."""
    candidates = spark.createDataFrame([("x", "p q", 2, 3 * 10**9)], "lang string, phrase string, words int, a long")
    counts = spark.createDataFrame([("x", "p", 4 * 10**9 + 1), ("x", "q", 7 * 10**9 + 3)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("x", 10**13 + 7)], "lang string, n long")
    assert co._cut_scores(candidates, counts, totals).first().score == 1000 * 3 * 10**9 * (10**13 + 7) // ((4 * 10**9 + 1) * (7 * 10**9 + 3))


def test_edges(spark):
    assert co.collocations(table(spark, [])).count() == 0
    assert co.collocations(table(spark, [(None, None), ("en", ""), ("en", " .,\t")])).count() == 0
    rows = [(None, "a b"), ("und", "a b")] * 60 + [("long", "x y " * 100_000)]
    odd = table(spark, rows).selectExpr("*", "1 phrase", "2 n", "3 h", "4 words", "5 lane", "6 `rank`")
    assert sorted(tuple(r) for r in co.collocations(odd).collect()) == expected(rows)


def test_query_columns(spark, small):
    df = QUERIES["op13_collocations"](spark, small)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and dict(df.dtypes)["rank"] == dict(df.dtypes)["score"] == "bigint"
