"""Quality rules with verdicts on hosts, in built-in DataFrame functions only.

Each document gets counts over its whole text and fails or passes the base rules.  Failures are
summed by host, a host's failure rate is shrunk towards the rate of all hosts with a beta prior
fitted to the hosts by moments, and hosts whose shrunk rate is far out in that prior take their documents
with them: above its mean by ``deviations`` of its standard deviations, or, where the hosts differ so much that
this is no limit, above the middle between its mean and 1.  Hosts that are alike, as chance would have them, all stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.workspace import WORD, Workspace

#: Characters that count as symbols.
SYMBOL = r"[#*$%&|<>]"


def _repeated_words(sums: Column, window: int) -> Column:
    """Words in windows that occur more than once; sums: the hashes of all windows in order."""
    placed = F.array_sort(F.transform(sums, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # places whose hash equals a neighbour's in the order by hash, then in the order of the text
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    pairs = F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0))), lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    step = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return step


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = 8) -> DataFrame:
    """``(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` over whole texts.

    Null texts count as empty: all counts are 0.
    """
    one = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = one.select("id", "host", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    hashed = words.select(
        "id", "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    # a window's hash is that of its words' hashes
    every = F.when(F.size("wh") >= window, F.transform(F.sequence(F.lit(1), F.size("wh") - window + 1), lambda i: F.xxhash64(*[F.get("wh", i - 1 + k) for k in range(window)])))
    windows = hashed.select("id", "host", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), every.alias("sums"))
    some = F.size("sums") > F.size(F.array_distinct("sums"))
    return windows.select("id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(some, _repeated_words(F.col("sums"), window)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """The base rules: under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_verdicts(hosts: DataFrame, deviations: float = 3.0) -> DataFrame:
    """``hosts(host, n, failed)`` -> the same with ``rate`` (shrunk), ``limit`` and ``bad`` (rate above limit).

    The beta prior has the mean of all documents' failures and, as its weight, what the spread of
    the hosts' rates beyond chance implies (from 1 document for hosts that differ wholly to
    1000 for hosts that don't); with no host there are no rows.
    """
    m = F.sum("failed") / F.sum("n")
    whole = hosts.agg(m.alias("m"), F.sum("n").alias("all_n"), F.count("*").alias("k"), (F.sum(F.col("failed") * F.col("failed") / F.col("n")) / F.sum("n") - m * m).alias("spread"))
    # expected spread of rates weighted by size: v + (m(1-m) - v) * k / all_n, with v = m(1-m) / (weight + 1)
    chance = F.col("k") / F.col("all_n")
    full = F.col("m") * (1 - F.col("m"))
    between = F.when((full > 0) & (chance < 1), (F.col("spread") / full - chance) / (1 - chance)).otherwise(F.lit(0.0))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / F.greatest(between, F.lit(0.001)) - 1))
    prior = whole.select("m", "spread", weight.alias("weight"))
    limit = F.least(F.col("m") + deviations * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("weight") + 1)), (F.col("m") + 1) / 2)
    prior = prior.select(F.struct("m", "weight", limit.alias("limit")).alias("prior"))
    p = F.col("prior")
    rate = (F.col("failed") + p["m"] * p["weight"]) / (F.col("n") + p["weight"])
    return hosts.select("*", prior.scalar().alias("prior")).select("host", "n", "failed", rate.alias("rate"), p["limit"].alias("limit"), (rate > p["limit"]).alias("bad"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", deviations: float = 3.0) -> DataFrame:
    """Counts, base verdict, host rate and final verdict for every row of ``docs``.

    Null hosts form one host of their own.  Null, empty and blank texts have no words and
    fail.  Null ids and repeated rows stay; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "quality")
    rows = ws.table(rule_counts(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()), "counts")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("base_failed"), 1)).alias("failed"))
    verdicts = ws.table(host_verdicts(ws.table(hosts, "hosts"), deviations), "verdicts")
    rows, verdicts = rows.alias("r"), verdicts.alias("v")
    return rows.join(verdicts, F.col("r.host").eqNullSafe(F.col("v.host"))).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("bad")).alias("kept"), F.col("rate").alias("host_rate"),
    )
