"""A corpus pipeline: classify, deduplicate, redact, mix and pack documents.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilgrid.llm import mixing, near_dedup as near, packing, quality_classifier, secrets
from veilgrid.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return quality_classifier.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near.near_dedup(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets replaced."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their texts."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("simhash_dedup", near_dedup),
    ("secret_redaction", secret_redaction),
    ("source_mixing", source_mix),
    ("bestfit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = ws.table(stage(spark, docs, sf_dir), name)
        ws.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier is trained and the mix and the packing are sequential: no SQL states the rows.
ORACLE_SQL: str | None = None
