"""Toxicity: terms against edit distances, contexts, and the scores of documents that weren't learned from."""

import random
import zlib

import numpy as np
import pytest

from veilgrid.llm import toxicity as tx
from veilgrid.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def nearest(word, terms):
    found = []
    for k, (term, whole) in enumerate(terms):
        if whole and distance(word, term) <= tx.edits_for(term, whole):
            found.append((distance(word, term), k))
        if not whole and word.startswith(term):
            found.append((0, k))
    return min(found, default=None)


def changed(rng, word):
    for _ in range(rng.randint(0, 3)):
        i = rng.randint(0, len(word))
        word = rng.choice([word[:i] + rng.choice("abcdé") + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice("abcdé") + word[i + 1 :]])
    return word


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_what_edit_distance_finds(seed):
    rng = random.Random(seed)
    draw = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(3, 12)))
    terms = list(dict.fromkeys((draw(), rng.random() < 0.7) for _ in range(rng.randint(1, 60))))
    a = tx.TermAutomaton(terms)
    for _ in range(1500):
        word = changed(rng, rng.choice(terms)[0]) if rng.random() < 0.8 else draw()
        assert a.match(word) == nearest(word, terms), word


def test_states_are_bounded():
    rng = random.Random(1)
    terms = [("".join(rng.choice("abcdefgh") for _ in range(9)), True) for _ in range(30)]
    a = tx.TermAutomaton(terms)
    a.MOST_STATES = 50
    for _ in range(600):
        word = changed(rng, rng.choice(terms)[0])
        assert a.match(word) == nearest(word, terms)
        assert len(a.steps) < 120


def test_edits_by_length():
    assert [tx.edits_for("x" * n, True) for n in (1, 4, 5, 8, 9, 20)] == [0, 0, 1, 1, 2, 2]
    assert tx.edits_for("x" * 20, False) == 0


def test_quotations():
    model = tx.ToxicityModel([("idiot", True, 5.0), ("blockhead", True, 4.0)])
    hits = lambda t: [(h.at, h.edits, h.quoted) for h in model.hits(*tx.words_of(t))]
    assert hits('He said "you IDIOT" and left') == [(3, 0, True)]
    assert hits("you idiot, „so ein Idiot“ «idiot» “an idiiot” idiot") == [(1, 0, False), (4, 0, True), (5, 0, True), (7, 1, True), (8, 0, False)]
    assert hits('"never closed idiot') == [(2, 0, False)]
    assert hits('"' + "w " * 70 + 'idiot" here') == [(70, 0, False)]
    assert hits("what a blokheed, blockheed!") == [(2, 2, False), (3, 1, False)]
    x = model.features(model.hits(*tx.words_of('"idiot" idiot')), 2)
    assert x[0] == pytest.approx(np.log1p(1)) and x[5] == pytest.approx(np.log1p(1))
    assert model.features([], 0) == [0.0] * tx.FEATURES


def test_ordinary_words_are_not_misspellings():
    model = tx.ToxicityModel([("moron", True, 5.0)], frozenset(["oron", "moron"]))
    assert [h.at for h in model.hits(*tx.words_of("oron moron morn"))] == [1, 2]


def test_one_term_of_a_family():
    from types import SimpleNamespace as Row

    rows = [Row(term=t, whole=w, g=g, odds=3.0) for t, w, g in (("scum", True, 90.0), ("scumb", False, 20.0), ("lowei", False, 80.0), ("lowe", False, 80.0), ("loweient", True, 30.0), ("los", True, 10.0), ("lose", False, 40.0), ("loser", True, 41.0))]
    chosen = [(t, w) for t, w, _ in tx._choose(rows, 10)]
    assert chosen == [("scum", True), ("lowei", False), ("loser", True), ("scumb", False)]
    assert len(tx._choose(rows, 2)) == 2


def test_logistic_regression():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(1 - 2 * x[:, 0]))).astype(float)
    mean, scale, beta = tx.fit_logistic(x, y, 1e-3)
    assert beta[0] == pytest.approx(-1, abs=0.2) and beta[1] == pytest.approx(2, abs=0.2) and abs(beta[2]) < 0.15


def trained(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def corpus(spark, seed=1, n=600):
    """Insults are open in toxic documents and quoted in clean ones; one family of words comes in many forms."""
    rng = random.Random(seed)
    plain = ["the", "a", "river", "stone", "walks", "house", "green", "under", "light", "seven", "merry", "path"]
    bad = lambda: rng.choice(["dimwit", "halfwit", "grubbel" + rng.choice(["on", "ig", "ast", "te"])])
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        kind = i % 5
        if kind == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), bad())
        elif kind == 1:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), f'"{bad()}"')
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(kind == 0)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_and_new_spellings(spark):
    rows, labels = corpus(spark)
    more = [(10_000 + k, t, "en", "s") for k, t in enumerate(["the river dimwiit under a dimvit halfwitt green dimwiit house", 'the green "dimwit" river said a house "halfwit" light', "the river stone walks", "grubbelfrx and grubbelxx and dimwit"])]
    docs, lab = frames(spark, rows + more, labels)
    got = {r.doc_id: r for r in tx.toxicity(docs, lab).collect()}
    truth = {i: x for i, _, x in labels}
    assert {i for i, r in got.items() if r.held_out} == {i for i in got if not trained(i)}
    assert all(r.predicted == truth[i] for i, r in got.items() if i in truth)
    assert [got[10_000 + k].predicted for k in range(4)] == [1, 0, 0, 1]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    rows, labels = corpus(spark, 2, 300)
    docs, lab = frames(spark, rows, labels)
    other = [(i, 0, x if trained(i) else 1 - x) for i, _, x in labels]
    docs2, lab2 = frames(spark, [(i, t, "xx", str(i)) for i, t, *_ in rows], other)
    scores = lambda d, w: sorted((r.doc_id, round(r.score, 9)) for r in tx.toxicity(d, w).collect())
    assert scores(docs, lab) == scores(docs2, lab2)


def test_edges(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "some dimwit text", "en", "a"), (3, "x " * 200_000, "en", "a"), (3, "y", "en", "a"), (3, "y", "en", "a")]
    for labels in ([], [(1, None, None), (2, 1, 0)], [(None, 1, 1), (3, 1, 1)], [(k, 1, 0) for k in range(4)]):
        docs, lab = frames(spark, rows, labels)
        got = tx.toxicity(docs.selectExpr("*", "1 id", "2 t", "3 score", "4 hits", "5 lid"), lab).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(0 <= r.score <= 1 for r in got)
    assert tx.toxicity(docs.limit(0), lab).count() == 0
    rows, labels = corpus(spark, 3, 200)
    twice = labels + [(i, 1, 0) for i, _, x in labels if x] + [(i, 1, None) for i, *_ in labels]
    docs, lab = frames(spark, rows, twice)
    assert sum(r.predicted for r in tx.toxicity(docs, lab).collect()) == 40


def test_query(spark):
    """Over the labelled documents of the table that weren't learned from."""
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op11_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    found = sum(r.predicted for r in held if truth[r.doc_id]) / sum(truth[r.doc_id] for r in held)
    wrong = sum(r.predicted for r in held if not truth[r.doc_id]) / sum(not truth[r.doc_id] for r in held)
    assert len(held) > 50 and found >= 0.9 and wrong <= 0.05
