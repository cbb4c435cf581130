"""Streams of page changes, audit entries and findings.

A watermark is a parameter of this library: late rows past it are dropped, which bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilgrid.functions import fixed
from veilgrid.functions.names import own_prefix
from veilgrid.operators.detect import entities


def read_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def significant(kind: Column, added: Column, interactive: Column, attribute: Column, hides: Column, text_length: Column) -> Column:
    """Whether a change of a page is worth a new scan: interactive or over three new nodes, a hidden or hiding element, a changed value, much new text."""
    nodes = (kind == "childList") & (interactive | (added > 3))
    attr = (kind == "attributes") & (attribute.isin("hidden", "value", "content") | (attribute.isin("style", "class") & hides))
    return F.coalesce(nodes | attr | ((kind == "characterData") & (text_length > 50)), F.lit(False))


def debounce(changes: DataFrame, key: str, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """One row for each burst of a key's changes: it fires when the gap has passed without another.

    Works on streams and tables alike: a session window with the gap.
    """
    rows = changes.withWatermark("ts", watermark) if changes.isStreaming else changes
    burst = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return burst.select(key, F.col("w.start").alias("first_ts"), "last_ts", F.col("w.end").alias("fires_at"), "n")


def rescans(changes: DataFrame, scans: DataFrame, key: str, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """Bursts of keys that were scanned before and whose overlay shows; ``scans(key, overlay)`` is a table."""
    return debounce(changes, key, gap, watermark).join(scans.where("overlay").select(key).distinct(), key, "left_semi")


def scan_stream(texts: DataFrame, key: str = "doc_id", mode: str = "rt") -> DataFrame:
    """Findings of a stream of texts, row by row; nothing is kept between rows."""
    rows = texts.select(key, "ts", F.posexplode(entities(F.col("text"), mode)).alias("pos", "e"))
    return rows.select(key, "ts", "pos", F.col("e.type").alias("type"), F.col("e.value").alias("value"), F.round("e.confidence", 3).alias("confidence"))


def scan_counts(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Running number of events."""
    return events.groupBy(key).agg(F.count("*").alias("scans"))


#: Days without an entry after which a key's ring is forgotten.
IDLE_DAYS = 30


class _Ring(StatefulProcessor):
    """The newest entries of a key as list state; they go by their time, then by id."""

    def __init__(self, key: str, keep: int, idle_ms: int):
        self.key, self.keep, self.idle_ms = key, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # what isn't written again within the time is dropped by the store itself
        self.held = handle.getListState("held", "ts timestamp, id long, level string, message string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.held.get())
        for f in rows:
            held += list(f[["ts", "id", "level", "message"]].itertuples(index=False, name=None))
            held = sorted(held, key=lambda r: (pd.Timestamp(r[0]), r[1]))[-self.keep :]
        self.held.put([(pd.Timestamp(t).to_pydatetime(), int(i), lv, m) for t, i, lv, m in held])
        yield pd.DataFrame({self.key: [key[0]] * len(held), "ts": [pd.Timestamp(r[0]) for r in held], "id": [int(r[1]) for r in held], "level": [r[2] for r in held], "message": [r[3] for r in held]})

    def close(self) -> None:
        pass


def audit_ring(entries: DataFrame, key: str = "source", keep: int = fixed.AUDIT_KEPT, idle_days: int = IDLE_DAYS) -> DataFrame:
    """A stream of ``entries(key, ts, id, level, message)``: after each batch the newest entries of every key it touched.

    The state of a key is a list of ``keep`` rows at most, and is forgotten when nothing came for ``idle_days``. The state store must be
    RocksDB's (``with_rocksdb``). Null keys are a key of their own.
    """
    out = f"{key} string, ts timestamp, id long, level string, message string"
    rows = entries.select(F.col(key).cast("string").alias(key), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), "level", "message")
    return rows.groupBy(key).transformWithStateInPandas(_Ring(key, keep, idle_days * 86_400_000), out, "Update", "ProcessingTime")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """While streams with list state start: their store is RocksDB, and only new rows make a batch (else what may expire makes one after another)."""
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_seen(rows: DataFrame, keys: tuple[str, ...], known: DataFrame | None = None, watermark: str = "1 hour") -> DataFrame:
    """Rows of a stream whose keys weren't seen within the watermark's delay and aren't in ``known(keys)``, a snapshot.

    The first to come wins; files that come twice, or late by less than the delay, add nothing. On a table: the first by time.
    """
    if rows.isStreaming:
        new = rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))
    else:
        own = own_prefix(rows)
        by = Window.partitionBy(*keys).orderBy("ts")
        new = rows.withColumn(f"{own}n", F.row_number().over(by)).where(F.col(f"{own}n") == 1).drop(f"{own}n")
    return new if known is None else new.join(known.select(*keys).distinct(), list(keys), "left_anti")


def run_merged(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "append") -> None:
    """Keeps partial results of a stream up to date in a folder and stops when all that is there now is read.

    Each batch's partial result replaces the part of its number, so a batch that is run again after a failure counts once. ``merged``
    reads the parts.
    """

    def put(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """Takes back the commit of the last batch of a stream that is stopped, as if the driver had failed before it; the batch runs again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = {int(f.getPath().getName()): f.getPath() for f in fs.listStatus(at) if f.getPath().getName().isdigit()}
    if files:
        last = files[max(files)]
        fs.delete(last, False)
        fs.delete(last.suffix(".crc"), False)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f".{last.getName()}.crc"), False)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """All parts of ``run_merged``, with the number of their batch."""
    return spark.read.option("basePath", path).parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there now to Parquet and stops; running it again goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
