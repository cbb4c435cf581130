"""Block lists as tables: domains by equality, path patterns by a literal that each of their matches must hold.

A pattern is tried only on sources that hold a piece of its literal: pieces are the keys of an equi-join, so ten thousand
patterns are neither terms of a plan nor compared with every source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.names import own_prefix
from veilgrid.sources.shared import cut

#: Characters of a piece, and rules without one that a list may have unless its caller says otherwise.
PIECE, MOST_OTHER = 4, 1_000

_BREAK = "\x01"
#: Punctuation that patterns write with a backslash, each with a stand-in while a pattern is taken apart.
_ESCAPED = {c: chr(0xE000 + ord(c)) for c in "\\./?+*()[]{}^$|&=#:;,-_~@!%'\"<> "}


def required_literal(pattern: Column) -> Column:
    """The longest text that every match of a Java pattern holds; empty if there is none or it isn't plain.

    Alternatives at the top, inline flags, quoting and escapes by code make a pattern not plain; groups, classes and optional
    characters are left out.
    """
    p = F.coalesce(pattern, F.lit(""))
    for c, stand in _ESCAPED.items():
        p = F.replace(p, F.lit("\\" + c), F.lit(stand))
    p = F.replace(p, F.lit("(?:"), F.lit("("))
    odd = p.rlike(r"\(\?|\\[^dDwWsSbB]|\\$")
    p = F.regexp_replace(p, r"\\[dDwWsSbB]", _BREAK)
    p = F.regexp_replace(p, r"\[\^?\]?[^\[\]]*\]", _BREAK)
    for _ in range(4):
        p = F.regexp_replace(p, r"\([^()]*\)", _BREAK)
    odd = odd | p.rlike(r"[|()\[\]]")
    p = F.regexp_replace(p, r"(?s).(?:[?*]|\{[^}]*\})[?+]?", _BREAK)
    p = F.regexp_replace(p, r"\+[?+]?|[.^$]", _BREAK)
    for c, stand in _ESCAPED.items():
        p = F.replace(p, F.lit(stand), F.lit(c))
    longest = F.array_max(F.transform(F.split(p, _BREAK), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    return F.when(odd | p.rlike(r"[{}]"), "").otherwise(longest)


def _pieces(text: Column) -> Column:
    """Distinct runs of PIECE characters."""
    n = F.length(text) - PIECE + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(PIECE))))).otherwise(F.array().cast("array<string>"))


def matching_rules(rows: DataFrame, rules: DataFrame, source_col: str = "source", rule_col: str = "rule_id", pattern_col: str = "pattern", most_other: int | None = MOST_OTHER) -> DataFrame:
    """The rows once for each rule whose pattern is found in the source, with the rule's id; ``rules(rule_id, pattern)`` has ids of its own.

    Each distinct pattern is tried once, whatever the rules that have it. A pattern's key is the piece of its literal that fewest patterns
    have. Patterns without a literal of PIECE characters are tried on every source, by a join without keys; more than most_other rules with
    such are refused (None: never). Null sources and patterns match nothing, and a rule that is given twice counts once.
    """
    own = own_prefix(rows, rules)
    lit, piece, pattern, n = (own + x for x in ("literal", "piece", "pattern", "n"))
    known = rules.where(F.col(pattern_col).isNotNull()).select(rule_col, F.col(pattern_col).alias(pattern)).distinct()
    # written once: else the filters below go beneath the distinct, and literals are made for each rule
    patterns = cut(known.select(pattern).distinct().withColumn(lit, required_literal(F.col(pattern))))
    plain = F.length(lit) >= PIECE
    pieces = patterns.where(plain).select(pattern, lit, F.explode(_pieces(F.col(lit))).alias(piece))
    common = pieces.groupBy(piece).agg(F.count("*").alias(n))
    keyed = pieces.join(common, piece).groupBy(pattern, lit).agg(F.min_by(piece, F.struct(n, piece)).alias(piece))
    tried, found = rows.where(F.col(source_col).isNotNull()), F.expr(f"`{source_col}` RLIKE `{pattern}`")
    met = tried.withColumn(piece, F.explode(_pieces(F.col(source_col)))).join(keyed, piece).where(F.contains(F.col(source_col), F.col(lit)) & found).select(*rows.columns, pattern)
    rest = patterns.where(~plain).select(pattern)
    if not rest.isEmpty():
        if most_other is not None and (count := known.join(rest, pattern).count()) > most_other:
            raise ValueError(f"{count} patterns have no literal of {PIECE} characters; {most_other} may")
        met = met.union(tried.join(rest, found).select(*rows.columns, pattern))
    return met.join(known, pattern).select(*rows.columns, rule_col)


def check_outbound_by_rules(payloads: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """``check_outbound`` with the rules as a table ``(rule_id, kind, value)``; kind is ``domain`` or ``path``.

    Only distinct sources meet distinct patterns, so what many payloads or rules share is tried once.
    """
    from veilgrid.operators.firewall import check_outbound

    own = own_prefix(payloads)
    at, verdict = own + "source", own + "verdict"
    sources = payloads.select(F.col("source").alias(at)).distinct()
    domains = sources.join(rules.where("kind = 'domain'").select(F.col("value").alias(at)).distinct(), at)
    patterns = rules.where("kind = 'path'").groupBy(F.col("value").alias("pattern")).agg(F.min("rule_id").alias("rule_id"))
    paths = matching_rules(sources, patterns, at, most_other=None).select(at).distinct()
    verdicts = domains.select(at, F.lit(0).alias("k")).union(paths.select(at, F.lit(1))).groupBy(at).agg(F.min("k").alias(verdict))
    checked = check_outbound(payloads, strict=strict).join(verdicts, F.col("source") == F.col(at), "left")
    k = F.col(verdict)
    why = F.when(k == 0, F.concat(F.lit("Domain "), F.col("source"), F.lit(" is blocked"))).when(k == 1, F.concat(F.lit("Source "), F.col("source"), F.lit(" matches blocked pattern")))
    return checked.withColumn("action", F.when(k.isNotNull(), "BLOCK").otherwise(F.col("action"))).withColumn("reason", F.coalesce(why, F.col("reason"))).drop(at, verdict)
