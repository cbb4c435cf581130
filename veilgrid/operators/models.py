"""Learned classifiers of short texts: training, inference and how their findings join those of the rules.

A text's tokens (words, and characters behind a hash sign) are embedded and averaged, padding left out, then pass two
dense layers.  Weights travel to the executors once; inference is a batch at a time.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions import fixed
from veilgrid.functions.text import model_chunks, trim
from veilgrid.operators.detect import base_risk

PAD, UNKNOWN = 0, 1


class Classifier(Protocol):
    """Anything that names the category of a text."""

    def classify(self, texts: list[str]) -> list[tuple[str, float]]: ...


def tokenize(text: str) -> list[str]:
    return [t for w in text.split() for t in (w, *("#" + c for c in w))]


def tokenize_intent(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class TextModel:
    """Embedding, two dense layers, labels and vocabulary."""

    labels: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]
    length: int = 64
    intent: bool = False

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.length), np.int64)
        for i, t in enumerate(texts):
            ids = [self.vocabulary.get(x, UNKNOWN) for x in (tokenize_intent(t) if self.intent else tokenize(t))[: self.length]]
            out[i, : len(ids)] = ids
        return out

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        w = self.weights
        used = (ids != PAD)[:, :, None]
        pooled = (w["embedding"][ids] * used).sum(1) / np.maximum(used.sum(1), 1)
        z = np.maximum(pooled @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def classify(self, texts: list[str]) -> list[tuple[str, float]]:
        """The best label (the first on a tie) and its probability."""
        if not texts:
            return []
        p = self.probabilities(self.encode(texts))
        return [(self.labels[k], float(p[i, k])) for i, k in enumerate(p.argmax(1))]

    def top(self, texts: list[str], k: int) -> list[list[tuple[str, float]]]:
        p = self.probabilities(self.encode(texts))
        return [[(self.labels[j], float(row[j])) for j in np.argsort(-row, kind="stable")[:k]] for row in p]

    def to_json(self) -> str:
        return json.dumps({"labels": self.labels, "vocabulary": self.vocabulary, "length": self.length, "intent": self.intent, "weights": {k: v.tolist() for k, v in self.weights.items()}})

    @classmethod
    def from_json(cls, text: str) -> TextModel:
        d = json.loads(text)
        return cls(tuple(d["labels"]), d["vocabulary"], {k: np.array(v, np.float32) for k, v in d["weights"].items()}, d["length"], d["intent"])


def train(texts: list[str], labels: list[str], names: tuple[str, ...], validate: tuple[list[str], list[str]] | None = None, size: int = 48, hidden: int = 64, epochs: int = 40, patience: int = 10, rate: float = 0.01, dropout: float = 0.2, batch: int = 64, length: int = 64, most: int = 10_000, intent: bool = False, seed: int = 5) -> TextModel:
    """Adam with a cosine schedule, dropout on the hidden layer, and an early stop on the validation accuracy.

    Labelled samples are few and short, so training runs on the driver; the caller bounds them.
    """
    rng = np.random.default_rng(seed)
    cut = tokenize_intent if intent else tokenize
    counts = Counter(t for x in texts for t in cut(x))
    vocabulary = {t: i + 2 for i, (t, _) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:most])}
    w = {
        "embedding": rng.normal(0, 0.1, (len(vocabulary) + 2, size)).astype(np.float32), "w1": rng.normal(0, (2 / size) ** 0.5, (size, hidden)).astype(np.float32), "b1": np.zeros(hidden, np.float32),
        "w2": rng.normal(0, (2 / hidden) ** 0.5, (hidden, len(names))).astype(np.float32), "b2": np.zeros(len(names), np.float32),
    }
    model = TextModel(names, vocabulary, w, length, intent)
    ids, y = model.encode(texts), np.array([names.index(x) for x in labels])
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    steps, t, best, stale, kept = epochs * -(-len(y) // batch), 0, -1.0, 0, dict(w)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows, t = order[at : at + batch], t + 1
            x, used = ids[rows], (ids[rows] != PAD)[:, :, None]
            n = np.maximum(used.sum(1), 1)
            pooled = (w["embedding"][x] * used).sum(1) / n
            keep = (rng.random((len(rows), hidden)) >= dropout) / (1 - dropout)
            pre = pooled @ w["w1"] + w["b1"]
            h = np.maximum(pre, 0) * keep
            z = h @ w["w2"] + w["b2"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            d = p / len(rows)
            dh = d @ w["w2"].T * keep * (pre > 0)
            de = np.zeros_like(w["embedding"])
            np.add.at(de, x, ((dh @ w["w1"].T) / n)[:, None, :] * used)
            grads = {"embedding": de, "w1": pooled.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": d.sum(0)}
            lr = rate * 0.5 * (1 + np.cos(np.pi * t / steps))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = (w[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        if validate:
            score = float(np.mean([a[0] == b for a, b in zip(model.classify(validate[0]), validate[1], strict=True)]))
            if score > best:
                best, stale, kept = score, 0, {k: a.copy() for k, a in w.items()}
            elif (stale := stale + 1) >= patience:
                break
    if validate:
        model.weights = kept
    return model


def train_from(samples: DataFrame, names: tuple[str, ...] = fixed.MODEL_LABELS, most: int = 20_000, **options) -> TextModel:
    """Trains on ``samples(text, label, split)``; ``most`` bounds what comes to the driver."""
    rows = samples.where("split in ('train', 'val')").orderBy(F.xxhash64("text"), "text").limit(most).collect()
    part = lambda s: ([r.text for r in rows if r.split == s], [r.label for r in rows if r.split == s])
    texts, labels = part("train")
    held = part("val")
    return train(texts, labels, names, held if held[0] else None, **options)


def answers(classifier: Classifier, texts: list[str]) -> list[tuple[str | None, float | None]]:
    """An answer for each text; where a batch fails it is asked in halves, so only the texts that fail have none."""
    try:
        return list(classifier.classify(texts))
    except Exception:  # any failure of a classifier is the text's lack of an answer
        if len(texts) < 2:
            return [(None, None)] * len(texts)
        half = len(texts) // 2
        return answers(classifier, texts[:half]) + answers(classifier, texts[half:])


def _classified(load: Callable[[], Classifier], text: Column) -> Column:
    @F.pandas_udf("struct<label:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = load()
        for s in batches:
            there = s.notna()
            got = answers(own, s[there].tolist())
            out = pd.DataFrame({"label": pd.Series(None, s.index, object), "score": pd.Series(np.nan, s.index)})
            out.loc[there, "label"], out.loc[there, "score"] = [g[0] for g in got], [g[1] for g in got]
            yield out

    return run(text)


def predict(spark: SparkSession, model: TextModel, text: Column) -> Column:
    """``(label, score)`` of a text; null where there is no text."""
    shared = spark.sparkContext.broadcast(model.to_json())
    return _classified(lambda: TextModel.from_json(shared.value), text)


def classify_with(classifier: Classifier, text: Column) -> Column:
    """The same of a classifier of the caller's, which travels by pickle; null also where it fails."""
    return _classified(lambda: classifier, text)


def predict_top(spark: SparkSession, model: TextModel, text: Column, k: int = 3) -> Column:
    """The k best labels of a text."""
    shared = spark.sparkContext.broadcast(model.to_json())

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = TextModel.from_json(shared.value)
        for s in batches:
            yield pd.Series([[{"label": a, "score": b} for a, b in row] for row in own.top(s.fillna("").tolist(), k)], s.index)

    return run(text)


def category_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in fixed.LABEL_CATEGORY.items() for x in p])
    return F.coalesce(F.element_at(table, label), label)


def add_classified(found: DataFrame, predicted: DataFrame, keys: tuple[str, ...], confidence: float | None = 0.8, source: str = "CLASSIFIER") -> DataFrame:
    """Findings and, for each text whose predicted category isn't among them, one of that category.

    ``predicted(keys, text, label, score)``; NONE adds nothing.  The confidence is fixed, or the score if None.
    """
    p = predicted.where("label is not null and label <> 'NONE'").select(*keys, F.lit(1 << 30).alias("pos"), category_of(F.col("label")).alias("type"), F.col("text").alias("value"), (F.lit(confidence) if confidence is not None else F.round("score", 3)).alias("confidence"))
    new = p.join(found.select(*keys, "type").distinct(), [*keys, "type"], "left_anti")
    return found.unionByName(new.withColumn("risk", base_risk(F.col("type"))).withColumn("source", F.lit(source)).withColumn("context", F.lit("")), allowMissingColumns=True)


def boost(found: DataFrame, predicted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Findings and what the booster may add: four categories from a score of 0.55, where type and value are new, the first of equals."""
    p = predicted.where(F.col("label").isin(*fixed.BOOST_TYPES) & (F.col("score") >= fixed.BOOST_FROM))
    p = p.groupBy(*keys, F.col("label").alias("type"), trim(F.col("text")).alias("value")).agg(F.min_by("score", "chunk").alias("score"), F.min("chunk").alias("chunk"))
    new = p.join(found.select(*keys, "type", "value").distinct(), [*keys, "type", "value"], "left_anti")
    new = new.select(*keys, (F.col("chunk") + (1 << 30)).cast("int").alias("pos"), "type", "value", F.round("score", 3).alias("confidence"), base_risk(F.col("type")).alias("risk"), F.lit("ML").alias("source"), F.col("value").alias("context"))
    return found.unionByName(new, allowMissingColumns=True)


def chunk_rows(pages: DataFrame, keys: tuple[str, ...], text_col: str) -> DataFrame:
    """The pieces of a text that the booster looks at, in order."""
    return pages.select(*keys, F.posexplode(model_chunks(F.col(text_col))).alias("chunk", "text"))


def only_predicted(predicted: DataFrame) -> DataFrame:
    """The predicted category alone, NONE included."""
    return predicted.select("id", category_of(F.col("label")).alias("type"))


def hybrid(found: DataFrame, predicted: DataFrame) -> DataFrame:
    """``found(id, type)`` united with the predicted category; NONE where both have nothing."""
    own = found.select("id", "type").distinct()
    p = only_predicted(predicted)
    both = own.union(p.where("type <> 'NONE'")).distinct()
    return both.union(p.where("type = 'NONE'").join(own.select("id").distinct(), "id", "left_anti").select("id", "type"))
