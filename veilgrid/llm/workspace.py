"""Intermediate tables in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir``; a private one is made only where that setting is
absent (tests).  A written table cuts lineage like ``checkpoint()`` and survives the loss of
any executor, since nothing of it lives on an executor's own disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of word splitting: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: A word, in the dialect of Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of numbers that one task writes.
ROWS_A_TASK = 50_000
#: Largest size by estimate of what is broadcast while a table is written: estimates are of compressed files, and a row that is exploded counts once.
BROADCAST_BYTES = 256 << 10
#: Bytes of an Arrow batch of a task, which the JVM and the Python worker each hold beside their heaps.
BATCH_BYTES = 32 << 20

_private: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _private:
        _private[app] = tempfile.mkdtemp(prefix="veilgrid-")
    return _private[app]


class Workspace:
    """Named tables of one operator run, removed on request or when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int = BATCH_BYTES):
        self.spark, self.batch_bytes = spark, batch_bytes
        self.root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, label: str) -> str:
        return f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it again; rows: about how many it has, where that is known, so that few don't go in many tasks."""
        path = self.path(label)
        if rows is not None and (tasks := tasks_for(rows, ROWS_A_TASK)) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
        with self._lean():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._veilgrid_path = path
        return out

    @contextmanager
    def _lean(self):
        """While a table is written: its shuffle files go when it is there, Arrow batches are bounded by bytes, and broadcasts fit a small driver."""
        conf, own = self.spark.conf, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(self.batch_bytes)}
        if self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST_BYTES:
            own["spark.sql.autoBroadcastJoinThreshold"] = str(BROADCAST_BYTES)
        before = {k: conf.get(k, None) for k in own}
        for k, v in own.items():
            conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for t in tables:
            if path := getattr(t, "_veilgrid_path", None):
                fs, at = self._fs(path)
                fs.delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it (upper and lower case are one)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def tasks_for(size: int, each: int, most: int = 1 << 14) -> int:
    """How many tasks share ``size`` so that each has about ``each``; a task of more streams what it has."""
    return max(1, min(most, -(-size // each)))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
