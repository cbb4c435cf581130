"""Stores and sinks: screenshots, audit entries, settings, exports and benchmark results."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgrid.functions import fixed
from veilgrid.functions.names import own_prefix
from veilgrid.operators.redact import sanitize_log, scrub_url

def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Image files as ``(path, modificationTime, length, content)``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def shot_bytes() -> Column:
    n = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    return n("original") + n("redacted")


def accept_shots(records: DataFrame) -> DataFrame:
    """Records that may be stored, normalised: the original is required, 6 MiB in all is the most, URL and title are cut."""
    text = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n).alias(c)
    kept = records.where((F.coalesce(F.col("original"), F.lit("")) != "") & (shot_bytes() <= fixed.SHOT_BYTES))
    return kept.select(
        "id", text("url", fixed.URL_CHARS), text("title", fixed.TITLE_CHARS), F.coalesce("page_type", F.lit("unknown")).alias("page_type"), "ts", F.coalesce("overall_risk", F.lit("UNKNOWN")).alias("overall_risk"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"), shot_bytes().alias("size_bytes"), "original", F.coalesce("redacted", F.lit("")).alias("redacted"),
    )


def newest(rows: DataFrame, n: int, order: str = "ts", tie: str = "id") -> DataFrame:
    """The n newest rows: an ordered limit, so each task brings n rows at most together."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)


def newest_by(rows: DataFrame, keys: tuple[str, ...], n: int, order: str = "ts", tie: str = "id") -> DataFrame:
    """The n newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie)))
    own = own_prefix(rows) + "rank"
    return rows.withColumn(own, rank).where(F.col(own) <= n).drop(own)


def prune_shots(shots: DataFrame) -> DataFrame:
    return newest(shots, fixed.SHOTS_KEPT)


def list_shots(shots: DataFrame) -> DataFrame:
    """Newest first, without images."""
    return shots.orderBy(F.desc("ts"), F.desc("id")).select("id", "url", "title", "page_type", "ts", "overall_risk", "entity_count", "size_bytes", (F.coalesce("redacted", F.lit("")) != "").alias("has_redacted"))


def get_shot(shots: DataFrame, shot_id: str) -> DataFrame:
    return shots.where(F.col("id") == shot_id)


def remove_shot(shots: DataFrame, shot_id: str) -> DataFrame:
    return shots.where(F.col("id") != shot_id)


def export_manifest(shots: DataFrame) -> DataFrame:
    """A row for each file that an export writes, with the scrubbed address."""
    both = F.filter(F.array(F.struct(F.lit("before").alias("part"), F.col("original").alias("d")), F.struct(F.lit("after").alias("part"), F.col("redacted").alias("d"))), lambda x: F.coalesce(x["d"], F.lit("")) != "")
    rows = shots.select("id", scrub_url(F.col("url")).alias("url"), "ts", "overall_risk", "entity_count", F.explode(both).alias("f"))
    return rows.select("id", "url", "ts", "overall_risk", "entity_count", F.col("f.part").alias("part"), F.concat("id", F.lit("_"), F.col("f.part"), F.lit(".png")).alias("file"))


def auto_export(shots: DataFrame) -> DataFrame:
    """Redacted images alone, in a folder of the day."""
    file = F.concat(F.lit(fixed.EXPORT_FOLDER + "/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), F.col("id"), F.lit("_after.png"))
    return shots.where(F.coalesce(F.col("redacted"), F.lit("")) != "").select("id", file.alias("file"), F.col("redacted").alias("content"))


def download_fallback(shots: DataFrame) -> DataFrame:
    """What may be downloaded: the redacted image, or the original of a page without entities."""
    safe = F.when(F.coalesce(F.col("redacted"), F.lit("")) != "", F.col("redacted")).when(F.col("entity_count") == 0, F.col("original"))
    return shots.select("id", safe.alias("content"), F.concat(F.lit(fixed.EXPORT_FOLDER + "/"), F.col("id"), F.lit("_after.png")).alias("file")).where("content is not null and content <> ''")


def write_shots(shots: DataFrame, path: str) -> None:
    """Appends accepted records as Parquet."""
    accept_shots(shots).write.mode("append").parquet(path)


def append_audit(log: DataFrame | None, entries: DataFrame, enabled: bool = True, keep: int = fixed.AUDIT_KEPT) -> DataFrame:
    """The log with new entries, their data sanitised, cut to the newest ones; unchanged if logging is off."""
    if not enabled:
        return entries.limit(0) if log is None else log
    clean = entries.withColumn("data", sanitize_log(F.col("data")))
    return newest(clean if log is None else log.unionByName(clean), keep)


@dataclass
class Settings:
    """Configuration; what callers give is merged into the defaults and clamped."""

    enabled: bool = True
    risk_threshold: str = "HIGH"
    scan_interval_ms: int = 5000
    enable_ocr: bool = True
    enable_dom: bool = True
    enable_vision: bool = True
    enable_firewall: bool = True
    enable_logging: bool = True
    max_log_entries: int = fixed.AUDIT_KEPT
    redaction_methods: dict[str, str] = field(default_factory=lambda: dict.fromkeys(fixed.CATEGORIES, "mask"))

    @classmethod
    def merged(cls, **given: object) -> Settings:
        own = asdict(cls())
        for k, v in given.items():
            if k not in own:
                continue
            own[k] = own[k] | v if isinstance(own[k], dict) and isinstance(v, dict) else v
        own["scan_interval_ms"] = min(60_000, max(500, int(own["scan_interval_ms"])))
        own["max_log_entries"] = min(10_000, max(10, int(own["max_log_entries"])))
        if own["risk_threshold"] not in fixed.LEVELS:
            own["risk_threshold"] = "HIGH"
        return cls(**own)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        return cls.merged(**json.loads(text))


def write_results(metrics: DataFrame, path: str, form: str = "json") -> None:
    """Benchmark results as one JSON or CSV file."""
    w = metrics.coalesce(1).write.mode("overwrite")
    w.json(path) if form == "json" else w.option("header", True).csv(path)
