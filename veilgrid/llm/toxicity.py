"""Toxicity by learned terms, found in spite of misspelling and weighed by what stands around them.

* Terms. From labelled documents: words, and stems of four letters or more, that toxic documents hold far more often than others do.
  Of a word and its stems only the most telling is a term.
* Levenshtein automata intersected with the terms' trie. A state is the set of trie nodes that the letters read so far may have
  reached, each with its least number of edits; states are made when a word first needs them and kept, so a word costs one step a
  letter. A term of 5 letters may have one edit, of 9 letters two; stems have none. Words that clean labelled documents hold are never
  taken for misspelled terms.
* Context windows. A hit inside quotation marks is a quotation and is counted apart; each other hit gets the mean log-odds of the
  words around it, as learned from hits in toxic and in clean documents.

A logistic regression of a document's counts gives the score. Its inputs for a labelled document come from terms and contexts that were
learned without that document (two folds); the final model has the terms and contexts of both.

Labelled documents are bounded by ``max_labelled`` (those with the smallest hash of their id), terms by ``max_terms``. Nothing else
is: every text is scored whole, where it is read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.workspace import Workspace, slices

MAX_LABELLED, MAX_TERMS = 30_000, 2_000
#: Lengths of stems, and what a term must reach: toxic documents, their share of all toxic ones (a group of copies is no term), log-odds
#: and the log-likelihood ratio statistic.
STEMS = range(4, 11)
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, LEAST_G = 3, 0.01, 1.4, 24.0
#: Words on either side of a hit; words between quotation marks at most; words of the context table and its pseudo-counts.
WINDOW, QUOTE_WORDS, CONTEXT_WORDS, CONTEXT_PRIOR = 5, 60, 5_000, 5.0
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3
FEATURES = 7

_EDGES = string.punctuation + "“”„«»‹›‘’‚…–—¿¡·"
#: The second kind opens, or closes what is open.
_OPEN, _EITHER, _CLOSE = "„«‹", '"“', "”»›"


def words_of(text: str) -> tuple[list[str], list[str]]:
    """Lower-case words as they stand, and the same without punctuation around them."""
    raw = text.lower().split()
    return raw, [w.strip(_EDGES) for w in raw]


def edits_for(term: str, whole: bool) -> int:
    """Edits that a term may have: none below 5 letters and for stems, then one, from 9 letters on two."""
    return 0 if not whole or len(term) < 5 else 1 if len(term) < 9 else 2


class TermAutomaton:
    """The trie of terms intersected with the Levenshtein automaton of the word that is read, made deterministic as it is used."""

    MOST_STATES = 200_000

    def __init__(self, terms: list[tuple[str, bool]]):
        self.kids: list[dict[str, int]] = [{}]
        self.stem, self.word, self.room = [-1], [-1], [0]
        self.edits = [edits_for(t, whole) for t, whole in terms]
        for k, (term, whole) in enumerate(terms):
            at = 0
            self.room[0] = max(self.room[0], self.edits[k])
            for c in term:
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.stem.append(-1)
                    self.word.append(-1)
                    self.room.append(0)
                at = self.kids[at][c]
                self.room[at] = max(self.room[at], self.edits[k])  # no term below has more edits
            (self.word if whole else self.stem)[at] = k
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.nodes: list[dict[int, int]] = []
        self.hits: list[tuple[tuple[int, int] | None, tuple[int, int] | None]] = []
        self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of the state; -1 if no node is left. Letters of a term that the word lacks are edits too."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            if reached[node] == e:
                for child in self.kids[node].values():
                    if e + 1 <= self.room[child] and e + 1 < reached.get(child, 9):
                        reached[child] = e + 1
                        todo.append((child, e + 1))
        if not reached:
            return -1
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.steps)
            self.steps.append({})
            self.nodes.append(reached)
            best = [min(((e, k) for n, e in reached.items() if (k := of[n]) >= 0 and e <= self.edits[k]), default=None) for of in (self.stem, self.word)]
            self.hits.append((best[0], best[1]))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.room[node] and e < reached.get(node, 9):
                reached[node] = e

        for node, e in self.nodes[state].items():
            reach(node, e + 1)
            for letter, child in self.kids[node].items():
                reach(child, e if letter == c else e + 1)
        self.steps[state][c] = to = self._state(reached)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """``(edits, term)`` of the nearest term, the first of equals; None if none is near enough."""
        if len(self.steps) > self.MOST_STATES:
            self._begin()
        at, best = 0, None
        for c in word:
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                return best
            if (hit := self.hits[at][0]) and (best is None or hit < best):
                best = hit
        hit = self.hits[at][1]
        return hit if hit and (best is None or hit < best) else best


class _Matches(dict):
    """Match of each word that was met, for words that aren't ordinary."""

    MOST = 1 << 20

    def __init__(self, automaton: TermAutomaton, ordinary: frozenset[str]):
        super().__init__()
        self.automaton, self.ordinary = automaton, ordinary

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) > self.MOST:
            self.clear()
        m = self.automaton.match(word)
        self[word] = m = None if m and m[0] and word in self.ordinary else m
        return m


@dataclass
class Hit:
    """A term in a text: place of the word, term, edits, whether it is quoted, and the mean log-odds of the words around."""

    at: int
    term: int
    edits: int
    quoted: bool
    context: float


def quoted_places(raw: list[str]) -> list[tuple[int, int]]:
    """Stretches of words from an opening to the next closing quotation mark, of QUOTE_WORDS words at most."""
    out, begun = [], None
    for i, w in enumerate(raw):
        for c in w:
            if c in _OPEN or (c in _EITHER and begun is None):
                begun = i
            elif c in _CLOSE + _EITHER and begun is not None:
                if i - begun < QUOTE_WORDS:
                    out.append((begun, i))
                begun = None
    return out


@dataclass
class ToxicityModel:
    """Terms ``(text, whole, log-odds)``, words never taken for misspelled terms, log-odds of context words, and the regression."""

    terms: list[tuple[str, bool, float]]
    ordinary: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None
    prior: float = 0.0
    _matches: _Matches | None = field(default=None, init=False)

    def fields(self) -> dict:
        """Plain values that make the same model anew."""
        return {k: v for k, v in self.__dict__.items() if k != "_matches"}

    def hits(self, raw: list[str], words: list[str]) -> list[Hit]:
        """All terms of a text in order."""
        if self._matches is None:
            self._matches = _Matches(TermAutomaton([t[:2] for t in self.terms]), self.ordinary)
        m = self._matches
        found = [(i, x) for i, w in enumerate(words) if (x := m[w])]
        if not found:
            return []
        quotes, out, q = quoted_places(raw), [], 0
        for i, (edits, term) in found:
            while q < len(quotes) and quotes[q][1] < i:
                q += 1
            near = [self.context.get(w, 0.0) for w in around(words, i)]
            out.append(Hit(i, term, edits, q < len(quotes) and quotes[q][0] <= i, sum(near) / max(1, len(near))))
        return out

    def features(self, hits: list[Hit], n_words: int) -> list[float]:
        """Counts of hits, open ones by their weight and density too, and the mean context of the open ones."""
        open_ = [h for h in hits if not h.quoted]
        if not hits:
            return [0.0] * FEATURES
        weight = sum(self.terms[h.term][2] / (1 + h.edits / 4) for h in open_)
        return [
            np.log1p(len(open_)), np.log1p(weight), np.log1p(1000 * len(open_) / n_words), np.log1p(len({h.term for h in open_})),
            np.log1p(sum(h.edits > 0 for h in open_)), np.log1p(len(hits) - len(open_)), sum(h.context for h in open_) / max(1, len(open_)),
        ]

    def score(self, features: list[float]) -> float:
        """Chance that a document with these features is toxic; the share of toxic labels where there was nothing to learn from."""
        if self.beta is None:
            return self.prior
        z = self.beta[0] + float(((np.array(features) - self.mean) / self.scale) @ self.beta[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def around(words: list[str], i: int) -> list[str]:
    """Words of the window around a place, without the place."""
    return words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]


def trains(doc_id: Column) -> Column:
    """Whether labels of an id may be learned from: CRC-32 of the id as text isn't 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text_col: str) -> DataFrame:
    """``(text, toxic, fold)`` of the labelled documents that may be learned from, at most max_labelled."""
    # repeated labels of a document: toxic if any says so
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("lid")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(trains(F.col("lid")))
    sample = one.select("lid", "toxic", F.xxhash64("lid").alias("h")).orderBy("h", "lid").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # at most max_labelled rows of three numbers
    return texts.join(F.broadcast(sample), F.col("id") == F.col("lid")).select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("fold"))


def _word_counts(sample: DataFrame) -> DataFrame:
    """``(w, n00, n01, n10, n11)``: labelled documents with each word, by fold and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {(f, x): Counter() for f in (0, 1) for x in (0, 1)}
        for batch in slices(batches):
            for t, x, f in zip(*batch.columns, strict=True):
                counts[f.as_py(), x.as_py()].update({w for w in words_of(t.as_py())[1] if w})
        for (f, x), c in counts.items():
            yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([2 * f + x] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["w", "kind", "n"])

    rows = sample.mapInArrow(run, "w string, kind int, n long")
    return rows.groupBy("w").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k >> 1}{k & 1}") for k in range(4)])


def _evidence(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> tuple[Column, Column]:
    """Log-odds and log-likelihood ratio of a term's counts."""
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    share = n_toxic / max(1, n_toxic + n_clean)
    part = lambda seen, p: F.when(seen > 0, seen * F.log(seen / ((clean + toxic) * p))).otherwise(0.0)
    return odds, 2 * (part(toxic, max(share, 1e-9)) + part(clean, max(1 - share, 1e-9)))


def _choose(rows: list, most: int) -> list[tuple[str, bool, float]]:
    """Terms by their evidence, without those that are stems or members of a chosen one."""
    chosen, heads = [], set()
    taken: set[str] = set()
    for r in sorted(rows, key=lambda r: (-r.g, -len(r.term), not r.whole, r.term)):
        starts = [r.term[:k] for k in STEMS if k < len(r.term) + (not r.whole)]
        if r.term in heads or any(s in taken for s in starts) or len(chosen) == most:
            continue
        chosen.append((r.term, r.whole, r.odds))
        heads.update(r.term[:k] for k in range(1, len(r.term) + 1))
        if not r.whole:
            taken.add(r.term)
    return chosen


def _terms(words: DataFrame, sizes: dict[tuple[int, int], int], folds: tuple[int, ...], most: int) -> list[tuple[str, bool, float]]:
    """The terms that the documents of some folds teach."""
    clean, toxic = (sum((F.col(f"n{f}{x}") for f in folds), F.lit(0)) for x in (0, 1))
    n_clean, n_toxic = (sum(sizes.get((f, x), 0) for f in folds) for x in (0, 1))
    if not n_clean or not n_toxic:
        return []
    counted = words.select("w", clean.alias("c"), toxic.alias("t"))
    stems = F.transform(F.sequence(F.lit(STEMS.start), F.least(F.length("w") - 1, F.lit(STEMS.stop - 1))), lambda k: F.struct(F.substring(F.col("w"), F.lit(1), k).alias("term"), F.lit(False).alias("whole")))
    every = F.concat(F.array(F.struct(F.col("w").alias("term"), F.lit(True).alias("whole"))), F.when(F.length("w") > STEMS.start, stems).otherwise(F.array().cast("array<struct<term: string, whole: boolean>>")))
    each = counted.select(F.explode(every).alias("e"), "c", "t").select("e.term", "e.whole", "c", "t").groupBy("term", "whole").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    odds, g = _evidence(F.col("c"), F.col("t"), n_clean, n_toxic)
    told = each.where((F.col("t") >= max(LEAST_DOCS, LEAST_SHARE * n_toxic)) & (F.length("term") >= 3)).select("term", "whole", odds.alias("odds"), g.alias("g")).where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G))
    return _choose(told.orderBy(F.desc("g"), "term", "whole").limit(10 * most).collect(), most)  # 10 * max_terms rows at most


def _ordinary(words: DataFrame, terms: list[tuple[str, bool, float]], most: int = 100_000) -> frozenset[str]:
    """Words of clean documents that the automaton would take for misspelled terms, the most frequent ones."""
    if not any(edits_for(t, whole) for t, whole, _ in terms):
        return frozenset()
    names = [t[:2] for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = TermAutomaton(names)
        for batch in batches:
            near = [bool((m := a.match(w)) and m[0]) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    clean = F.col("n00") + F.col("n10")
    found = words.where(clean > 0).select("w", clean.alias("c")).mapInArrow(run, "w string, c long")
    return frozenset(r.w for r in found.orderBy(F.desc("c"), "w").limit(most).collect())


def _contexts(sample: DataFrame, models: list[ToxicityModel]) -> list[dict[str, float]]:
    """Log-odds of the words around hits of each fold, and of both; a fold's hits are those of ``models[fold]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {(f, x): Counter() for f in (0, 1) for x in (0, 1)}
        for batch in slices(batches):
            for t, x, f in zip(*batch.columns, strict=True):
                raw, words = words_of(t.as_py())
                for h in models[f.as_py()].hits(raw, words):
                    counts[f.as_py(), x.as_py()].update(["", *around(words, h.at)])  # "" counts hits
        for (f, x), c in counts.items():
            yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([2 * f + x] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["w", "kind", "n"])

    rows = sample.mapInArrow(run, "w string, kind int, n long").groupBy("w").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    most = rows.orderBy(F.desc(F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")), "w").limit(CONTEXT_WORDS).collect()  # a fixed number
    seen = {r.w: (r.n0, r.n1, r.n2, r.n3) for r in most}
    out = []
    for folds in ((0,), (1,), (0, 1)):
        pick = lambda n, x: sum(n[2 * f + x] for f in folds)  # noqa: E731, B023
        clean, toxic = (pick(seen.get("", (0,) * 4), x) for x in (0, 1))
        p = CONTEXT_PRIOR
        share = (toxic + 1) / (clean + toxic + 2)
        odds = {w: np.log((pick(n, 1) + 2 * p * share) / (pick(n, 0) + 2 * p * (1 - share)) * (1 - share) / share) for w, n in seen.items() if w}
        out.append({w: float(np.clip(v, -2, 2)) for w, v in odds.items()})
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the columns, and the coefficients (the first is the constant) by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, beta


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from ``labels(doc_id, toxic)`` of documents that may be learned from.

    Null labels and ids aren't labels; a document with several is toxic if any says so. Without documents of both kinds in both
    folds the model knows no term, and scores every text by the share of toxic labels.
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    sample = ws.table(labelled_texts(docs, labels, max_labelled, id_col, text_col), "sample")
    sizes = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}  # at most four
    total = sum(sizes.values())
    prior = sum(n for (_, x), n in sizes.items() if x) / (total + 1)
    if len(sizes) < 4:
        return ToxicityModel([], prior=prior)
    words = ws.table(_word_counts(sample), "words")
    # a fold is looked at with what the other one teaches
    first, second, both = (_terms(words, sizes, folds, max_terms) for folds in ((1,), (0,), (0, 1)))
    ordinary = _ordinary(words, both)
    models = [ToxicityModel(terms, ordinary) for terms in (first, second)]
    of0, of1, context = _contexts(sample, models)
    models[0].context, models[1].context = of1, of0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t, f in zip(batch.column(0), batch.column(2), strict=True):
                raw, own = words_of(t.as_py())
                m = models[f.as_py()]
                rows.append(m.features(m.hits(raw, own), len(own)))
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = sample.mapInArrow(run, "x array<double>, y int").collect()  # at most max_labelled rows of a few numbers
    ws.drop(sample, words)
    mean, scale, beta = fit_logistic(np.array([r.x for r in got]), np.array([float(r.y) for r in got]))
    return ToxicityModel(both, ordinary, context, mean, scale, beta, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, hits)`` for every row; hits: array of ``(at, term, edits, quoted)`` by place of the word.

    Null and empty texts have no hits and the score of such texts; null ids and repeated rows stay; an empty table gives
    no rows; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"fields": model.fields()})  # max_terms terms, CONTEXT_WORDS words
    kind = pa.list_(pa.struct([("at", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # one for all tasks of a Python worker, and with it the automaton's states made so far
        m = held.setdefault("model", ToxicityModel(**held["fields"]))
        shown = [t + ("" if whole else "*") for t, whole, _ in m.terms]
        for batch in slices(batches):
            scores, found = [], []
            for t in batch.column(1):
                raw, words = words_of(t.as_py() or "")
                hits = m.hits(raw, words) if m.terms else []
                scores.append(m.score(m.features(hits, len(words))))
                found.append([{"at": h.at, "term": shown[h.term], "edits": h.edits, "quoted": h.quoted} for h in hits])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["id", "score", "hits"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "id long, score double, hits array<struct<at: long, term: string, edits: int, quoted: boolean>>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_hits)`` for every row of ``docs``.

    held_out: labels of this id weren't learned from (a null id has no labels and is held out).
    """
    rows = score_toxicity(docs, learn_toxicity(docs, labels, id_col=id_col, text_col=text_col, **options), id_col, text_col)
    out = F.coalesce(~trains(F.col("id")), F.lit(True))
    return rows.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("hits").cast("long").alias("n_hits"))
