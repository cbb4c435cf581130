"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilgrid.llm import periodic_runs as pr
from veilgrid.llm.queries import QUERIES


def every_run(words, min_length=24, exponent=3):
    """By definition: each period's maximal stretches, the smallest period of each stretch."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = every_run(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_least_overlap():
    assert pr.gram_length() == 16
    assert pr.gram_length(4, 2) == 2
    for least, times in ((24, 3), (10, 2), (7, 4), (1, 2)):
        assert pr.gram_length(least, times) == min(max(least, times * q) - q for q in range(1, 200))


@pytest.mark.parametrize("least,times", [(24, 3), (10, 2), (4, 3), (12, 4)])
def test_runs_by_definition(least, times):
    rng = random.Random(least)
    for _ in range(400):
        words = []
        for _ in range(rng.randint(1, 5)):
            base = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 13))]
            words += (base * 90)[: rng.randint(1, 90)]
        assert pr.word_runs(words, least, times) == every_run(words, least, times)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=120))
def test_two_words(words):
    assert pr.word_runs(words, 8, 3) == every_run(words, 8, 3)


def test_fibonacci_words_have_nested_runs():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert pr.word_runs(list(b), 6, 3) == every_run(list(b), 6, 3)


def test_long_texts():
    for words, want in ((["x"] * 300_000, (0, 300_000, 1)), ([f"w{i % 1000}" for i in range(200_000)], (0, 200_000, 1000))):
        assert pr.word_runs(words) == [want]
    assert pr.word_runs([f"w{i}" for i in range(200_000)]) == []


def test_masked_words_can_not_join_runs():
    words = [f"u{i}" for i in range(50)] + ["a", "b"] * 12 + [f"v{i}" for i in range(50)]
    inside = pr.repeated_grams(pr.np.fromiter(map(hash, words), pr.np.int64, len(words)), 16)
    assert inside.nonzero()[0].tolist() == list(range(50, 74))
    assert pr.repeated_grams(pr.np.arange(100), 16) is None


def test_query(spark, small):
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in rows}
    assert sum(r[1] > 0 for r in got.values()) >= len(got) // 20


def test_edges(spark):
    tenth = [i for i in range(-200, 200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n ", 3), (None, "a b " * 20, 4), (4, "a b " * 12, 5), (4, "a b " * 12, 6), (5, " x\u0085 " * 30, 7)]
    rows += [(i, t, 0) for i, t in zip(tenth, (None, "", "one", " ".join(f"w{k}" for k in range(200)), "x " * 50, "a b c " * 100), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int").withColumnRenamed("words", "Words")
    assert pr.with_planted_runs(docs).columns == docs.columns
    got = sorted((tuple(r) for r in pr.run_digest(pr.with_planted_runs(docs)).collect()), key=repr)
    want = sorted((expected(i, t) if i is not None else (None, *expected(4, t)[1:]) for i, t, _ in rows), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want] and got == want
    assert pr.run_digest(docs.limit(0)).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "start " + "la la di " * 10 + "end")], "doc_id long, text string")
    row = pr.periodic_runs(docs).first()
    assert row.collapsed == "start la la di end"
    assert [tuple(r) for r in row.runs] == [(1, 30, 3)]
