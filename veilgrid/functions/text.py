"""Text preparation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions import fixed
from veilgrid.functions.patterns import SPACES, java


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once.

    What a lambda takes from outside is evaluated again for each element, unless it is a column or another lambda's variable.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(text: Column) -> Column:
    """Without any white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def strip(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, java(pattern), "")


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost and not overlapping, as an array."""
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces between runs of sentence punctuation that white space or the end follows; blank pieces dropped."""
    return F.filter(F.split(text, java(r"[.!?]+(?={s}|$)")), lambda s: s.rlike(java("{S}")))


def text_chunks(text: Column) -> Column:
    """Each sentence trimmed, followed by its word pairs of over 5 characters.

    Words of the untrimmed sentence count, so a pair can begin or end with a space.
    """

    def pairs(words: Column) -> Column:
        both = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(words) > 1, F.filter(both, lambda p: F.length(p) > 5)).otherwise(F.array().cast("array<string>"))

    def chunks(sentence: Column) -> Column:
        return F.concat(F.array(trim(sentence)), let(F.split(sentence, java("{s}+")), pairs))

    return F.flatten(F.transform(sentences(F.coalesce(text, F.lit(""))), chunks))


def model_chunks(text: Column, longest: int = fixed.BOOST_LENGTH, most: int = fixed.BOOST_CHUNKS) -> Column:
    """Pieces of 2 to 180 characters after punctuation and white space; the beginning if there are none; 40 at most."""
    pieces = F.filter(F.transform(F.split(text, java(r"(?<=[.\n;,]){s}+")), trim), lambda c: F.length(c).between(2, longest))
    whole = trim(text)
    instead = F.when(F.length(whole) >= 2, F.array(F.substring(whole, 1, longest))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.when(F.size(pieces) > 0, pieces).otherwise(instead), 1, most)


def surrounding(value: Column, text: Column, reach: int = 60) -> Column:
    """The first occurrence of a value with up to 60 characters on both sides, trimmed; empty if there is none."""
    at = F.instr(text, value)
    start = F.greatest(at - reach, F.lit(1))
    cut = F.substring(text, start, at + F.length(value) + reach - start)
    return F.when(at > 0, trim(cut)).otherwise(F.lit(""))


def cleanup(text: Column) -> Column:
    """Visible text with runs of blank lines and blanks reduced."""
    runs = F.regexp_replace(text, java(r"(?:\n{s}*){3,}"), "\n\n")
    return trim(F.regexp_replace(runs, r"[ \t]{2,}", " "))


def model_tokens(text: Column) -> Column:
    """For each word the word, then each of its characters behind a hash sign; case is kept."""
    words = F.filter(F.split(text, java("{s}+")), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.concat(F.lit("#"), c)))))


def action_tokens(text: Column) -> Column:
    """Words in lower case."""
    return F.filter(F.split(F.lower(trim(text)), java("{s}+")), lambda w: w != "")


def build_vocabulary(tokens: DataFrame, token_col: str = "token", most: int = 10_000) -> DataFrame:
    """``(token, n, id)`` of the most frequent tokens: ids from 2 (0 pads, 1 is unknown), ties by token.

    The ordered limit keeps at most that many rows, so numbering them in one task is bounded.
    """
    counts = tokens.groupBy(F.col(token_col).alias("token")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(most)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token"))
    return top.withColumn("id", (order + 1).cast("int"))


def encode(docs: DataFrame, tokens_col: str, vocabulary: DataFrame, length: int = 64, out: str = "ids") -> DataFrame:
    """The first tokens of each row as ids, padded with 0 to a fixed length.

    The vocabulary is bounded by its size limit, so it travels as one map.
    """
    table = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("v"))
    known = table.select("v").scalar()
    ids = F.transform(F.slice(F.col(tokens_col), 1, length), lambda t: F.coalesce(F.element_at(F.col("__v"), t), F.lit(1)))
    padded = F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(F.col(tokens_col)), F.lit(0))))
    return docs.withColumn("__v", known).withColumn(out, padded).drop("__v")


def for_cloud(text: Column) -> Column:
    """Cut to 9000 characters with a mark."""
    return F.when(F.length(text) > fixed.CLOUD_CHARS, F.concat(F.substring(text, 1, fixed.CLOUD_CHARS), F.lit(fixed.CLOUD_MARK))).otherwise(text)


def replace_all(text: Column, pairs: list[tuple[Column, Column]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, a, b)
    return text


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def valid(text: Column) -> Column:
        n = F.length(text)
        # from the right, every second digit is doubled and its digits added
        value = lambda i: F.substring(text, n - i, F.lit(1)).cast("int")
        weigh = lambda i: F.when(i % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
        return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda s, i: s + F.coalesce(weigh(i), F.lit(0))) % 10 == 0

    return let(digits, valid)


def fuzzy(a: Column, b: Column) -> Column:
    """Similarity of two values: 1 equal, 0.95 equal without separators, 0.7 one inside the other, else the larger of
    the share of the longer one's characters that the shorter one has and the share of equal places."""
    x, y = fuzzy_form(a), fuzzy_form(b)
    return fuzzy_forms(x["said"], x["bare"], y["said"], y["bare"])


def fuzzy_form(value: Column) -> Column:
    """What ``fuzzy_forms`` compares of a value: it trimmed in lower case, and that without separators."""
    said = F.lower(trim(value))
    return F.struct(said.alias("said"), strip(said, r"[{s}\-_.]+").alias("bare"))


def fuzzy_forms(x: Column, p: Column, y: Column, q: Column) -> Column:
    """``fuzzy`` of two values by their forms, which a join makes once for each row and not for each pair."""
    short, long = F.when(F.length(p) <= F.length(q), p).otherwise(q), F.when(F.length(p) <= F.length(q), q).otherwise(p)
    chars = F.filter(F.split(long, ""), lambda c: c != "")
    shared = F.size(F.filter(chars, lambda c: F.instr(short, c) > 0)) / F.length(long)
    n = F.length(short)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(short, i, F.lit(1)) == F.substring(long, i, F.lit(1)))))
    return (
        F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(p == q, 0.95)
        .when((short != "") & F.contains(long, short), 0.7)
        .when(short == "", 0.0)
        .otherwise(F.floor(F.greatest(shared, same / n) * 1000 + 0.5) / 1000)
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes ``(x, y, width, height)``."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    meet = w * h
    union = a["width"] * a["height"] + b["width"] * b["height"] - meet
    return F.when((w > 0) & (h > 0) & (union > 0), meet / union).otherwise(0.0)


def contains_box(outer: Column, inner: Column) -> Column:
    return (
        (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"])
        & (outer["x"] + outer["width"] >= inner["x"] + inner["width"]) & (outer["y"] + outer["height"] >= inner["y"] + inner["height"])
    )


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """The part of a box on a canvas in whole pixels: ``(sx, sy, sw, sh)``."""
    half_up = lambda v: F.floor(v + 0.5)
    sx, sy = F.greatest(F.lit(0), half_up(box["x"])), F.greatest(F.lit(0), half_up(box["y"]))
    ex, ey = F.least(width, half_up(box["x"] + box["width"])), F.least(height, half_up(box["y"] + box["height"]))
    return F.struct(sx.cast("long").alias("sx"), sy.cast("long").alias("sy"), F.greatest(F.lit(0), ex - sx).cast("long").alias("sw"), F.greatest(F.lit(0), ey - sy).cast("long").alias("sh"))


def agent_score(label: Column, query: Column) -> Column:
    """How well a label meets a description: the mean over the query's words of their best match."""
    text, wanted = F.lower(trim(label)), F.lower(trim(query))
    words = F.filter(F.split(wanted, java("{s}+")), lambda w: w != "")
    have = F.filter(F.split(text, java("{s}+")), lambda w: w != "")

    def best(q: Column) -> Column:
        ratio = lambda t: F.least(F.length(t), F.length(q)) / F.greatest(F.length(t), F.length(q))
        part = F.exists(have, lambda t: (F.contains(t, q) | F.contains(q, t)) & (ratio(t) >= 0.6))
        letters = F.filter(F.split(q, ""), lambda c: c != "")
        share = F.size(F.filter(letters, lambda c: F.contains(text, c))) / F.length(q)
        return F.when(F.array_contains(have, q), 1.0).when(part, 0.5).when(F.contains(text, q), 0.3).when((share > 0.8) & (F.length(q) >= 3), 0.2).otherwise(0.0)

    total = F.aggregate(words, F.lit(0.0), lambda s, q: s + best(q))
    return F.when(wanted == "", 0.0).when(F.contains(text, wanted), 1.0).otherwise(total / F.size(words))
