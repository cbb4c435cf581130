"""Whole scans: from pages or documents to findings, risks, redactions and reports.

Everything is one logical plan; Python runs only where HTML is parsed, a model is asked or greedy matching is settled.
Parsed pages and scored findings, which several results are made of, are kept on disk between them (and made again from
the source if an executor goes); ``ScanResult.release`` lets them go, or ``tied`` when a frame that was made of them goes.
"""

from __future__ import annotations

import weakref
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import fixed
from veilgrid.functions.text import text_chunks
from veilgrid.operators import classify, detect, firewall, matching, redact, report, risk
from veilgrid.sources import html


class ScanResult(NamedTuple):
    """Frames of a scan; entities carry their risk."""

    pages: DataFrame
    entities: DataFrame
    redactions: DataFrame
    safe: DataFrame
    report: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Drops all that is kept on disk for the frames."""
        for df in self.kept:
            df.unpersist()


def scan_documents(docs: DataFrame, key: str = "doc_id", text_col: str = "text", mode: str = "rt", page_type: str = "unknown", categories: tuple[str, ...] = fixed.CATEGORIES) -> DataFrame:
    """Findings in whole texts with their risk: key, pos, type, value, confidence, risk, source, context, parts, overall, level."""
    found = detect.detect(docs, text_col, (key,), mode, categories=categories)
    return risk.score(found, F.lit(page_type), "rt" if mode == "rt" else "lib")


def scan_texts(docs: DataFrame, key: str = "doc_id", text_col: str = "text", **options) -> ScanResult:
    """The same with redactions, redacted texts and a report."""
    scored = scan_documents(docs, key, text_col, **options).withColumn("entity_id", entity_id(key))
    scored = _keep(scored)
    red = redact.redaction_actions(scored)
    safe = redact.redact_documents(docs.select(key, F.col(text_col)), scored, key, text_col, "redacted")
    return ScanResult(docs, scored, red, safe, report.privacy_report(scored, scored, red, (key,)), (scored,))


def entity_id(key: str):
    """The same id in every run."""
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), "type", "value"), 256)


def _keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)


def tied(df: DataFrame, scan: ScanResult) -> DataFrame:
    """The frame; what the scan keeps is let go when the frame is garbage."""
    weakref.finalize(df, scan.release).atexit = False
    return df


def scan_pages_rt(pages: DataFrame, ended: bool = False) -> ScanResult:
    """The runtime's scan of raw pages: whole text and field values, additive page type, constant element context. ended: as of ``extract_pages``."""
    parsed = _keep(html.extract_pages(pages, ended))
    p = classify.classify_additive(parsed, F.col("form_hints"))
    p = _keep(p.withColumn("hints", detect.page_hints(F.col("form_fields"), F.col("page_type"))))
    text = _keep(detect.detect(p, "visible_text", ("page_id",), "rt", F.col("hints")))
    values = p.select("page_id", "hints", "visible_text", F.explode("form_fields").alias("f")).select("page_id", "hints", "visible_text", F.col("f.idx").alias("idx"), F.col("f.value").alias("value_text")).where("value_text <> ''")
    fields = detect.detect(values, "value_text", ("page_id", "idx"), "rt", F.col("hints"), context=F.col("visible_text"))
    fields = detect.first_of_page(fields, ("page_id",), ("idx", "pos")).drop("idx").withColumn("pos", F.col("pos") + (1 << 20))
    return _finish(p, matching.append_new(text, fields), "rt", (parsed, p, text))


def scan_pages_lib(pages: DataFrame) -> ScanResult:
    """The library's scan: form values, then sentences and word pairs; weighted page type."""
    parsed = _keep(html.extract_pages(pages))
    p = classify.classify_weighted(parsed, "elements")
    p = _keep(p.withColumn("hints", detect.page_hints(F.col("form_fields"), F.col("page_type"))))
    values = F.filter(F.transform("form_fields", lambda f: f["value"]), lambda v: F.trim(v) != "")
    chunks = p.select("page_id", "hints", "visible_text", F.posexplode(F.concat(values, F.filter(text_chunks(F.col("visible_text")), lambda c: F.length(c) >= 2))).alias("chunk_pos", "chunk"))
    found = detect.detect(chunks, "chunk", ("page_id", "chunk_pos"), "lib", F.col("hints"), distinct=False, context=F.col("visible_text"))
    first = detect.first_of_page(found)
    first = first.withColumn("pos", F.col("chunk_pos").cast("long") * 1024 + F.col("pos")).drop("chunk_pos")
    return _finish(p, first, "lib", (parsed, p))


def _finish(p: DataFrame, found: DataFrame, mode: str, kept: tuple[DataFrame, ...]) -> ScanResult:
    # Spark reckons the pages' size from that of the files before they are parsed: they are never broadcast
    typed = found.join(p.select("page_id", "page_type", F.substring("visible_text", 1, 500).alias("__page")).hint("merge"), "page_id")
    scored = risk.score(typed, F.col("page_type"), mode, fallback=F.col("__page") if mode == "lib" else None).drop("__page").withColumn("entity_id", entity_id("page_id"))
    scored = _keep(scored)
    red = redact.redaction_actions(scored)
    safe = redact.redact_documents(p.select("page_id", "url", "title", "page_type", "visible_text"), scored, "page_id", "visible_text", "redacted" if mode == "rt" else "type")
    return ScanResult(p, scored, red, safe, report.privacy_report(scored, scored, red, ("page_id",)), (*kept, scored))


def sanitized_context(scan: ScanResult) -> DataFrame:
    """What may leave: address, title, type, redacted text, safe elements and form fields, and how much was found."""
    elements = html.elements_frame(scan.pages).withColumn("rect", F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "width", "height")]))
    e = firewall.safe_elements(elements).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tag", "role", "label", "selector", "is_interactive"))).alias("safe_elements"))
    f = firewall.safe_form_fields(html.fields_frame(scan.pages)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "selector", "label", "type", "required"))).alias("safe_form_fields"))
    n = scan.entities.groupBy("page_id").agg(F.count("*").alias("entity_count"))
    out = scan.safe.join(e, "page_id", "left").join(f, "page_id", "left").join(n, "page_id", "left")
    return out.select("page_id", redact.scrub_url(F.col("url")).alias("url"), "title", "page_type", "safe_text", "safe_elements", "safe_form_fields", F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


def outbound(requests: DataFrame) -> DataFrame:
    """``requests(id, instruction, context)`` -> redacted prompt, shortcut or plan, and the check of what would be sent."""
    prompt = firewall.cloud_prompt(F.col("instruction"), F.col("context"))
    rows = requests.withColumn("prompt", prompt).withColumn("search", firewall.direct_search(redact.redact_for_cloud(F.col("instruction")))).withColumn("plan", firewall.offline_plan(F.col("instruction")))
    return firewall.firewall_check(rows.withColumn("data", firewall.json_text(F.col("prompt")))).drop("data")
