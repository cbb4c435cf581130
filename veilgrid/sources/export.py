"""Export of one file for each row, with a commit: what a failed or killed task has written is never listed.

A task writes the files of its rows into a folder of its own. Only when all tasks are done, the driver puts a list of these folders beside
them, which is what readers go by; of a job that fails, the folders of its finished tasks are removed. A task that runs again
has another folder, so nothing is listed twice. What a killed task leaves goes by ``remove_unlisted``.

A file of a few bytes takes a block of the disk: many small ones can go into ZIP archives, a few for each task, which are
listed and read alike.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import RecordBatch, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_LISTS = "committed"
#: Files and bytes of their contents after which another archive begins.
MEMBERS, ARCHIVE_BYTES = 20_000, 64 << 20
_ARCHIVE = "packed-"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    part: str
    files: int
    bytes: int


class FileWriter(DataSourceArrowWriter):
    """Writes rows ``(file, content)`` as files below a folder; any file system that pyarrow knows will do."""

    def __init__(self, path: str, packed: bool = False):
        self.path, self.packed = path, packed

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, f"{root}/{name}"

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        part = f"part-{uuid.uuid4().hex}"
        system, root = self._at(part)
        made: set[str] = set()
        files = size = 0
        archive = stream = None

        def close() -> None:
            if archive:
                archive.close()
                stream.close()

        try:
            for batch in iterator:
                for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    if not name or name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"not a file's name: {name!r}")
                    content = b"" if content is None else bytes(content)
                    if self.packed:
                        if archive is None or held[0] >= MEMBERS or held[1] >= ARCHIVE_BYTES:
                            close()
                            system.create_dir(root, recursive=True)
                            made.add(root)
                            stream, held = system.open_output_stream(f"{root}/{_ARCHIVE}{uuid.uuid4().hex}.zip"), [0, 0]
                            archive = zipfile.ZipFile(stream, "w")
                        archive.writestr(zipfile.ZipInfo(name), content)
                        files, size, held = files + 1, size + len(content), [held[0] + 1, held[1] + len(content)]
                        continue
                    at = f"{root}/{name}"
                    if (folder := at.rpartition("/")[0]) not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    with system.open_output_stream(at) as out:
                        out.write(content)
                    files, size = files + 1, size + len(content)
            close()
        except BaseException:
            if made:
                system.delete_dir(root)
            raise
        return Written(part if files else "", files, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the tasks' folders: a file that appears at once, when it is complete."""
        rows = [json.dumps({"part": m.part, "files": m.files, "bytes": m.bytes}) for m in messages if m and m.files]
        system, folder = self._at(_LISTS)
        system.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{folder}/.{name}.tmp") as out:
            out.write("\n".join(rows).encode())
        system.move(f"{folder}/.{name}.tmp", f"{folder}/{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.files:
                system, root = self._at(m.part)
                system.delete_dir(root)


class FileExport(DataSource):
    """``df.write.format("row_files")`` of ``(file string, content binary)``; appends to what the folder has."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("an export is appended to, never overwritten")
        return FileWriter(self.options["path"], self.options.get("packed", "false") == "true")


def export_files(rows: DataFrame, path: str, file: str = "file", content: str = "content", packed: bool = False) -> None:
    """Writes each row's content to its file below the folder, or (packed) to its member of an archive there. Names are relative, null content is an empty file, and names that repeat are kept apart by task only."""
    rows.sparkSession.dataSource.register(FileExport)
    rows.select(F.col(file).cast("string").alias("file"), F.col(content).cast("binary").alias("content")).write.format("row_files").option("packed", str(packed).lower()).mode("append").save(path)


def exported_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, length, content)`` of all files that are listed, members of archives among them, but for empty ones; none where nothing was exported."""
    if not (parts := _listed(spark, path)):
        return spark.createDataFrame([], "file string, length long, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{path}/{p}" for p in parts])
    packed = F.col("path").rlike(rf"/part-[0-9a-f]{{32}}/{_ARCHIVE}[0-9a-f]{{32}}\.zip$")
    plain = found.where(~packed).select(_below(F.col("path")).alias("file"), "length", "content")
    return plain.union(found.where(packed).select("content").mapInArrow(_members, plain.schema))


def _members(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
    """What archives hold, a bounded number of files at a time."""
    for batch in batches:
        for one in batch.column(0):
            with zipfile.ZipFile(pa.BufferReader(one.as_buffer())) as archive:
                infos = [i for i in archive.infolist() if i.file_size]
                for at in range(0, len(infos), 1_000):
                    some = infos[at : at + 1_000]
                    yield pa.record_batch([pa.array([i.filename for i in some], pa.string()), pa.array([i.file_size for i in some], pa.int64()), pa.array([archive.read(i) for i in some], pa.binary())], names=["file", "length", "content"])


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Folders of finished tasks."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_LISTS}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return [r.part for r in spark.read.schema("part string, files long, bytes long").json(f"{path}/{_LISTS}").where("part is not null").collect()]  # one for each task


def remove_unlisted(spark: SparkSession, path: str) -> None:
    """Removes the folders of tasks that never finished; not while an export runs."""
    listed, at = set(_listed(spark, path)), spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in system.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("part-") and name not in listed:
            system.delete(f.getPath(), True)


def _below(path: Column) -> Column:
    """A file's name below its task's folder, which is the last of its kind in the path."""
    return F.regexp_extract(path, r".*/part-[0-9a-f]{32}/(.*)$", 1)
