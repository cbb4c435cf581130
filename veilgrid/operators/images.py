"""Pictures: redaction of regions and a small network that scores them, as numpy on batches of rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgrid.functions import fixed


def clamp(box: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """x0, y0, x1, y1 of a box's part on the picture in whole pixels (halves go up)."""
    x, y, w, h = box
    up = lambda v: int(np.floor(v + 0.5))
    x0, y0 = max(0, up(x)), max(0, up(y))
    return x0, y0, max(x0, min(width, up(x + w))), max(y0, min(height, up(y + h)))


def blur(image: np.ndarray, box: tuple[int, int, int, int], radius: int = 10) -> None:
    """Box blur inside a region; the radius is held between 1 and 30."""
    x0, y0, x1, y1 = box
    part = image[y0:y1, x0:x1, :3].astype(np.float64)
    r = min(30, max(1, radius))
    for axis in (0, 1):
        n = part.shape[axis]
        if not n:
            return
        sums = np.concatenate([np.zeros_like(np.take(part, [0], axis)), np.cumsum(part, axis)], axis)
        lo, hi = np.maximum(np.arange(n) - r, 0), np.minimum(np.arange(n) + r + 1, n)
        shape = [1, 1, 1]
        shape[axis] = n
        part = (np.take(sums, hi, axis) - np.take(sums, lo, axis)) / (hi - lo).reshape(shape)
    image[y0:y1, x0:x1, :3] = np.round(part).astype(np.uint8)


def pixelate(image: np.ndarray, box: tuple[int, int, int, int], size: int = 8) -> None:
    """Squares of their mean colour; 2 pixels at least."""
    x0, y0, x1, y1 = box
    size = max(2, size)
    for y in range(y0, y1, size):
        for x in range(x0, x1, size):
            cell = image[y : min(y + size, y1), x : min(x + size, x1), :3]
            cell[:] = np.round(cell.reshape(-1, 3).mean(0))


def fill(image: np.ndarray, box: tuple[int, int, int, int], colour: tuple[int, int, int] = (0, 0, 0)) -> None:
    x0, y0, x1, y1 = box
    image[y0:y1, x0:x1, :3] = colour
    image[y0:y1, x0:x1, 3] = 255


# Colours under a token and under a replaced text.
TOKEN_COLOUR, REPLACE_COLOUR = (0xE0, 0xE0, 0xE0), (0xCC, 0xCC, 0xCC)


def redact_picture(rgba: bytes, width: int, height: int, boxes: list[dict], scale: tuple[float, float] = (1.0, 1.0), padding: float = 3.0) -> bytes:
    """The picture with every box (x, y, width, height, method) redacted, scaled to the picture and padded."""
    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).copy()
    for b in boxes or ():
        if b["width"] <= 0 or b["height"] <= 0:
            continue
        sx, sy = scale
        at = clamp((b["x"] * sx - padding, b["y"] * sy - padding, b["width"] * sx + 2 * padding, b["height"] * sy + 2 * padding), width, height)
        if at[2] - at[0] < 1 or at[3] - at[1] < 1:
            continue
        method = b.get("method") or "mask"
        if method == "blur":
            blur(image, at)
        elif method == "pixelate":
            pixelate(image, at)
        else:
            fill(image, at, TOKEN_COLOUR if method == "tokenize" else REPLACE_COLOUR if method == "replace" else (0, 0, 0))
    return image.tobytes()


def redact_pictures(images: DataFrame, padding: float = 3.0) -> DataFrame:
    """Adds ``redacted`` to ``images(id, w, h, rgba, boxes)``."""

    @F.pandas_udf("binary")
    def run(rgba: pd.Series, w: pd.Series, h: pd.Series, boxes: pd.Series) -> pd.Series:
        return pd.Series([redact_picture(a, int(b), int(c), [dict(x) for x in (d if d is not None else [])], padding=padding) for a, b, c, d in zip(rgba, w, h, boxes, strict=True)])

    return images.withColumn("redacted", run("rgba", "w", "h", "boxes"))


def gray_crop(rgba: bytes, width: int, height: int, box: tuple[float, float, float, float], out: tuple[int, int] = (96, 48)) -> np.ndarray:
    """A region's red channel resized to the network's input by nearest points, from 0 to 1."""
    x0, y0, x1, y1 = clamp(box, width, height)
    w, h = out
    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    if x1 <= x0 or y1 <= y0:
        return np.zeros((h, w), np.float32)
    ys = y0 + ((np.arange(h) + 0.5) * (y1 - y0) / h).astype(int)
    xs = x0 + ((np.arange(w) + 0.5) * (x1 - x0) / w).astype(int)
    return image[np.ix_(ys, xs)][:, :, 0].astype(np.float32) / 255


def windows(x: np.ndarray, k: int, stride: int, pad: int) -> np.ndarray:
    """All k by k windows of ``x`` (..., height, width): (..., out height, out width, k, k)."""
    x = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(pad, pad), (pad, pad)])
    return np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(-2, -1))[..., ::stride, ::stride, :, :]


#: Pictures that pass the network at once.
PICTURES = 64


def run_networks(layers: list[dict], x: np.ndarray) -> np.ndarray:
    """Probability of the last layer's one output for each picture of ``x`` (pictures, channels, height, width); layers are dicts of kind and weights."""
    for layer in layers:
        kind = layer["kind"]
        if kind == "conv":
            v = windows(x, layer["w"].shape[2], layer.get("stride", 1), layer.get("pad", 0))
            x = np.moveaxis(np.tensordot(v, layer["w"], axes=((1, 4, 5), (1, 2, 3))), -1, 1) + layer["b"][:, None, None]
        elif kind == "depthwise":
            w = layer["w"]
            v = windows(x, w.shape[1], layer.get("stride", 1), layer.get("pad", 0))
            x = sum(v[..., i, j] * w[:, i, j, None, None] for i in range(w.shape[1]) for j in range(w.shape[2])) + layer["b"][:, None, None]
        elif kind == "relu":
            x = np.maximum(x, 0)
        elif kind == "maxpool":
            v = windows(x, layer["k"], layer.get("stride", layer["k"]), 0)
            x = functools.reduce(np.maximum, (v[..., i, j] for i in range(layer["k"]) for j in range(layer["k"])))
        elif kind == "mean":
            x = x.mean(axis=(2, 3))
        elif kind == "dense":
            x = x @ layer["w"] + layer["b"]
    return 1 / (1 + np.exp(-np.clip(x[:, 0], -30, 30)))


def run_network(layers: list[dict], x: np.ndarray) -> float:
    """``run_networks`` of one picture (channels, height, width)."""
    return float(run_networks(layers, x[None])[0])


def random_network(seed: int = 3, channels: int = 6) -> list[dict]:
    """An untrained network of the usual shape; its last layer is what ``fit_last`` trains."""
    r = np.random.default_rng(seed)
    n = lambda *s: r.normal(0, 0.3, s)
    return [
        {"kind": "conv", "w": n(channels, 1, 3, 3), "b": np.zeros(channels), "stride": 2, "pad": 1}, {"kind": "relu"},
        {"kind": "depthwise", "w": n(channels, 3, 3), "b": np.zeros(channels), "stride": 1, "pad": 1}, {"kind": "relu"}, {"kind": "maxpool", "k": 2}, {"kind": "mean"},
        {"kind": "dense", "w": n(channels, 1), "b": np.zeros(1)},
    ]


def fit_last(layers: list[dict], crops: list[np.ndarray], labels: list[int], rounds: int = 300, rate: float = 1.0) -> list[dict]:
    """Logistic regression of the last layer on the features before it; the loss is on the logit."""
    x = np.array([_features(layers[:-1], c[None]) for c in crops])
    mean, std = x.mean(0), x.std(0) + 1e-6
    z, y, w, b = (x - mean) / std, np.array(labels, float), np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - rate * (z.T @ g / len(y) + 1e-3 * w), b - rate * g.mean()
    return [*layers[:-1], {"kind": "dense", "w": (w / std)[:, None], "b": np.array([b - (w / std) @ mean])}]


def _features(layers: list[dict], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        if layer["kind"] == "mean":
            return x.mean(axis=(1, 2))
        x = _apply(layer, x)
    return x.reshape(-1)


def _apply(layer: dict, x: np.ndarray) -> np.ndarray:
    if layer["kind"] == "relu":
        return np.maximum(x, 0)
    v = windows(x, layer.get("k") or layer["w"].shape[-1], layer.get("stride", layer.get("k", 1)), layer.get("pad", 0))
    if layer["kind"] == "maxpool":
        return v.max(axis=(3, 4))
    return np.einsum("chwij,ocij->ohw" if layer["kind"] == "conv" else "chwij,cij->chw", v, layer["w"]) + layer["b"][:, None, None]


def score_regions(spark: SparkSession, layers: list[dict], rgba: Column, w: Column, h: Column, box: Column) -> Column:
    """Probability that a region of a picture is sensitive."""
    shared = spark.sparkContext.broadcast(layers)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for a, b, c, d in batches:
            boxes = list(d[["x", "y", "width", "height"]].itertuples(index=False))
            out = np.zeros(len(a))
            for at in range(0, len(a), PICTURES):
                some = slice(at, at + PICTURES)
                crops = [gray_crop(p, int(x), int(y), tuple(z)) for p, x, y, z in zip(a[some], b[some], c[some], boxes[some], strict=True)]
                out[some] = run_networks(shared.value, np.stack(crops)[:, None])
            yield pd.Series(out)

    return run(rgba, w, h, box)


def vision_boost(entities: DataFrame, scores: DataFrame, keys: tuple[str, ...], entity_key: str = "entity_id") -> DataFrame:
    """Entities whose region scores 0.6 or more take VISION as source and the greater confidence; the first 12 boxed ones of a page count."""
    boxed = (F.col("bbox.width") >= fixed.VISION_SIDE) & (F.col("bbox.height") >= fixed.VISION_SIDE)
    rank = F.row_number().over(Window.partitionBy(*keys, boxed).orderBy("pos"))
    rows = entities.withColumn("__r", F.when(boxed, rank)).join(scores.select(*keys, entity_key, F.col("p").alias("__p")), [*keys, entity_key], "left")
    hit = F.coalesce((F.col("__r") <= fixed.VISION_REGIONS) & (F.col("__p") >= fixed.VISION_FROM), F.lit(False))
    return rows.withColumn("source", F.when(hit, "VISION").otherwise(F.col("source"))).withColumn("confidence", F.when(hit, F.greatest("confidence", F.round("__p", 3))).otherwise(F.col("confidence"))).withColumn("visual_confirmed", hit).drop("__r", "__p")
