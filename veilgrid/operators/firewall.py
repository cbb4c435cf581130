"""Outbound checks and planned actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import fixed, patterns
from veilgrid.functions.names import own_prefix
from veilgrid.functions.patterns import java
from veilgrid.functions.text import trim
from veilgrid.operators.redact import redact_for_cloud


def json_text(text: Column) -> Column:
    """A string as it stands in JSON, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def detected_fields(payload: Column, rules: str = "lib", strict: bool = False, raw: Column | None = None) -> Column:
    """Labels of the patterns found in a payload's JSON text; strict looks at the raw text too, where line starts aren't hidden behind an escape."""
    test = lambda p: payload.rlike(java(p)) | raw.rlike(java(p)) if strict and raw is not None else payload.rlike(java(p))
    return F.filter(F.array(*[F.when(test(p), F.lit(label)) for p, label in patterns.FIREWALL[rules]]), lambda x: x.isNotNull())


def check_outbound(payloads: DataFrame, blocked_domains: tuple[str, ...] = (), blocked_paths: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``payloads(id, type, source, data)`` -> the same with detected_fields, action and reason.

    A blocked domain decides first, then a blocked path, then what the payload holds.  data is JSON text.
    """
    rows = payloads.withColumn("detected_fields", detected_fields(F.col("data"), "lib", strict, F.replace(F.col("data"), F.lit("\\n"), F.lit("\n"))))
    domain = F.col("source").isin(*blocked_domains) if blocked_domains else F.lit(False)
    path = F.lit(False)
    for p in blocked_paths:
        path = path | F.col("source").rlike(p)
    some = F.size("detected_fields") > 0
    action = F.when(domain | path, "BLOCK").when(some, "REDACT").otherwise("ALLOW")
    reason = (
        F.when(domain, F.concat(F.lit("Domain "), F.col("source"), F.lit(" is blocked")))
        .when(path, F.concat(F.lit("Source "), F.col("source"), F.lit(" matches blocked pattern")))
        .when(some, F.concat(F.lit("Outbound payload contains sensitive fields: "), F.array_join("detected_fields", ", ")))
        .otherwise("No sensitive data detected in outbound payload")
    )
    return rows.withColumn("action", action).withColumn("reason", reason)


def firewall_check(payloads: DataFrame, data_col: str = "data") -> DataFrame:
    """The runtime's check: detected_fields, safe and reason."""
    rows = payloads.withColumn("detected_fields", detected_fields(F.col(data_col), "rt"))
    some = F.size("detected_fields") > 0
    return rows.withColumn("safe", ~some).withColumn("reason", F.when(some, F.concat(F.lit("Sensitive data detected: "), F.array_join("detected_fields", ", "))).otherwise("No sensitive data detected"))


def header_findings(headers: DataFrame) -> DataFrame:
    """``headers(id, name, value)`` whose value of over 20 characters holds something; they are reported, not stopped."""
    own = own_prefix(headers) + "json"
    return firewall_check(headers.where(F.length("value") > 20).withColumn(own, json_text(F.col("value"))), own).where("not safe").drop(own)


def action_log(entities: DataFrame, redactions: DataFrame, key: str = "page_id") -> DataFrame:
    """A REDACT row for each redaction, and a WARN row for each page with entities of which none was redacted."""
    red = redactions.select(key, F.lit("REDACT").alias("action"), F.concat(F.lit("Redacted "), F.col("method"), F.lit(" on entity "), F.col("entity_id")).alias("reason"))
    bare = entities.join(redactions.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    warn = bare.select(key, F.lit("WARN").alias("action"), F.concat(F.col("n").cast("string"), F.lit(" entities detected but none redacted")).alias("reason"))
    return red.union(warn)


def block(config: DataFrame, domain: str) -> DataFrame:
    """The blocklist ``config(domain)`` with a domain added."""
    return config.union(config.sparkSession.createDataFrame([(domain,)], "domain string")).distinct()


def unblock(config: DataFrame, domain: str) -> DataFrame:
    return config.where(F.col("domain") != domain)


def on_blocklist(rows: DataFrame, config: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows whose source is on the blocklist."""
    own = own_prefix(rows) + "domain"
    return rows.join(config.select(F.col("domain").alias(own)), F.col(source_col) == F.col(own), "left_semi")


def role_of(e: Column) -> Column:
    kind = F.when(e["input_type"].isin("password", "checkbox", "radio"), e["input_type"]).otherwise("textbox")
    return F.when(e["is_button"], "button").when(e["is_link"], "link").when(e["is_input"], kind).otherwise("generic")


def label_of(e: Column) -> Column:
    some = lambda c: F.when(e[c] != "", e[c])
    return F.coalesce(some("aria_label"), some("placeholder"), some("name"), F.when(F.length(e["text"]).between(1, 99), e["text"]), some("id"), e["tag_name"])


def safe_elements(elements: DataFrame, sensitive: DataFrame | None = None, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Visible elements with role and label, without their content; sensitive ``(keys, idx, sensitive_fields)`` is joined in."""
    e = F.struct(*elements.columns)
    rows = elements.where("is_visible").select(*keys, "idx", F.col("tag_name").alias("tag"), role_of(e).alias("role"), label_of(e).alias("label"), "selector", "rect", (F.col("is_input") | F.col("is_button") | F.col("is_link")).alias("is_interactive"))
    none = F.array().cast("array<string>")
    if sensitive is None:
        return rows.withColumn("sensitive_fields", none)
    return rows.join(sensitive.select(*keys, "idx", "sensitive_fields"), [*keys, "idx"], "left").withColumn("sensitive_fields", F.coalesce("sensitive_fields", none))


def safe_form_fields(fields: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    required = F.coalesce(F.col("required"), F.lit(False)) if "required" in fields.columns else F.lit(False)
    return fields.select(*keys, "idx", "selector", F.coalesce(some("label"), some("placeholder"), some("name"), F.col("type")).alias("label"), "type", required.alias("required"))


def valid_action(a: Column) -> Column:
    """Whether a planned action (a struct) is allowed."""
    safe = lambda c: ~F.coalesce(a[c], F.lit("")).rlike(patterns.ACTION_SENSITIVE)
    size = F.length(a["value"])
    test = a["action"].isin(*fixed.ACTIONS) & a["target"].isNotNull() & (F.length(a["target"]) <= 300)
    test = test & ((a["action"] != "type") | (a["value"].isNotNull() & (size <= 500) & safe("value") & safe("target")))
    test = test & ((a["action"] != "search") | (a["value"].isNotNull() & size.between(1, 200)))
    test = test & ((a["action"] != "select") | (a["value"].isNotNull() & (size <= 200) & safe("value")))
    test = test & ((a["action"] != "keypress") | F.coalesce(a["key"].isin(*fixed.ACTION_KEYS), F.lit(False)))
    test = test & ((a["action"] != "scroll") | a["amount"].isNull() | a["amount"].between(1, 2000))
    return F.coalesce(test, F.lit(False))


def validate_actions(actions: Column) -> Column:
    """Allowed actions of an array with defaults filled in."""
    blank = lambda a, c: F.coalesce(a[c], F.lit(""))
    normal = lambda a: F.struct(
        a["action"].alias("action"), blank(a, "target").alias("target"), blank(a, "value").alias("value"), blank(a, "key").alias("key"),
        F.when(blank(a, "direction") == "", "down").otherwise(a["direction"]).alias("direction"), F.coalesce(a["amount"], F.lit(500)).alias("amount"),
    )
    return F.transform(F.filter(actions, valid_action), normal)


def direct_search(instruction: Column) -> Column:
    """What an instruction asks to search for; null if it isn't a plain search request."""
    found = F.regexp_extract(instruction, java(patterns.SEARCH_REQUEST), 1)
    return F.when(found != "", found)


def offline_plan(instruction: Column) -> Column:
    """The kind of plan that rules make of an instruction without a model: search, press, fill, summary or answer."""
    low = F.lower(trim(instruction))
    has = lambda *words: _any([F.contains(low, F.lit(w)) for w in words])
    return (
        F.when(low.rlike(java(r"^(?:search|find|look{s}+for){s}+(?:for{s}+)?.+$")), "search")
        .when(has("submit", "login", "log in", "checkout", "pay", "continue", "sign in"), "press")
        .when(has("fill", "type", "enter"), "fill")
        .when(has("what", "risk", "privacy", "summary", "show", "check", "help"), "summary")
        .otherwise("answer")
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def cloud_prompt(instruction: Column, context: Column) -> Column:
    """The text that would go to a remote model, redacted and cut; sending it isn't part of this library."""
    cut = redact_for_cloud(context)
    cut = F.when(F.length(cut) > fixed.CLOUD_CHARS, F.concat(F.substring(cut, 1, fixed.CLOUD_CHARS), F.lit(fixed.CLOUD_MARK))).otherwise(cut)
    return F.concat(F.lit("Instruction: "), redact_for_cloud(instruction), F.lit("\nPage: "), cut)


def parse_plan(answer: Column) -> Column:
    """``(answer, actions)`` of a model's reply: JSON, possibly fenced; other prose is an answer without actions."""
    bare = trim(F.regexp_replace(answer, r"^```json\s*|```$", ""))
    schema = "struct<answer:string,actions:array<struct<action:string,target:string,value:string,key:string,direction:string,amount:double>>>"
    parsed = F.from_json(bare, schema)
    ok = F.try_parse_json(bare).isNotNull()
    none = F.array().cast("array<struct<action:string,target:string,value:string,key:string,direction:string,amount:double>>")
    return F.struct(F.when(ok & parsed["answer"].isNotNull(), parsed["answer"]).otherwise(answer).alias("answer"), validate_actions(F.slice(F.when(ok, F.coalesce(parsed["actions"], none)).otherwise(none), 1, 5)).alias("actions"))
