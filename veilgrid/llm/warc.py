"""WARC archives: write with an index, read selected records by byte ranges.

An archive is a file of gzip members, one for each record, as the format has it.  A page becomes its compressed
response record where it is read, so that only compressed records travel; the records are dealt to
tasks by a hash and written in order to files of bounded size.  Each task returns the index rows (file, offset, length, URL,
digest) of what it has written, and the index is written by Spark: a task that is lost or repeated leaves a
file that no index row names.

Of records with equal payloads of at least ``least`` bytes one is a response and the others are revisits that
name it, without a payload.  Which ones is settled on digests alone; the verdicts travel to the writing
tasks beside the records, a marker row before the rows it is about.

Reading takes any selection of index rows, sorts them by file and offset, merges ranges that lie
close together, and parses the records out of each range.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.workspace import Workspace, slices, tasks_for

# Fixed values of the format.
CRLF = "\r\n"
END = CRLF * 2
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes that a task writes, about.
TASK_BYTES = 32 << 20

_UNSAFE = re.compile(r"[\x00-\x1F\x7F]")


@dataclass
class Archives:
    """A set of archives: the index of their records, and in how many tasks they are read."""

    index: DataFrame
    tasks: int


def _record_id(page_id: int | None, url: str | None, digest: str, rank: int) -> str:
    h = hashlib.md5(f"{page_id}|{digest}|{rank}|{url}".encode()).hexdigest()
    return f"<urn:uuid:{uuid.UUID(h)}>"


def make_record(page_id: int | None, url: str | None, digest: str, date: str, payload: bytes = b"", rank: int = 1, first: tuple[int | None, str | None] | None = None) -> bytes:
    """A response record, or a revisit of the response of the page and URL ``first``, as a gzip member; null ids and URLs have no header line."""
    http = f"{HTTP}{len(payload)}{END}".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest, rank)}",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_UNSAFE.sub('%20', url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(*first, digest, 1)}"] if first else []),
        *([f"X-Refers-To-Page: {first[0]}"] if first and first[0] is not None else []),
        *([] if page_id is None else [f"X-Page: {page_id}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {0 if first else len(http) + len(payload)}",
    ]
    data = (CRLF.join(lines) + END).encode() + (b"" if first else http + payload) + END.encode()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_RECORD = "page_id long, url string, digest string, payload_bytes long, again long, first struct<page_id: long, url: string>, member binary"


def _members(pages: DataFrame, date: str) -> DataFrame:
    """Every page as a compressed response record."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("again", pa.int64()), ("first", pa.struct([("page_id", pa.int64()), ("url", pa.string())])), ("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for i, u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                payload = h.as_py() or b""
                digest = hashlib.sha1(payload).hexdigest()
                out.append({"page_id": i, "url": u, "digest": digest, "payload_bytes": len(payload), "again": None, "first": None, "member": make_record(i, u, digest, date, payload)})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return pages.mapInArrow(run, _RECORD)


def _revisits(ws: Workspace, pages: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Marker rows ``(page_id, url, digest, again, first)``: so many of the rows of this page, URL and payload revisit that page; and the bytes of all payloads."""
    meta = pages.select("page_id", "url", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    keys = ws.table(meta.groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"), F.max("payload_bytes").alias("payload_bytes")), "digests")
    total = keys.agg(F.sum(F.col("n") * F.col("payload_bytes"))).first()[0] or 0
    # the largest page first, rows without one last; then the least URL, none before any
    order = F.struct(F.col("page_id").isNull().alias("none"), F.bitwise_not("page_id").alias("not_id"), F.col("url").alias("url"))
    top = keys.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min(order).alias("t"), F.sum("n").alias("held")).where("held > 1")
    top = ws.table(top.select(F.col("digest").alias("same"), F.bitwise_not("t.not_id").alias("top_id"), F.col("t.url").alias("top_url")), "responses")
    both = keys.where(F.col("payload_bytes") >= least).join(top, F.col("digest") == F.col("same"))
    is_top = F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    again = F.col("n") - F.when(is_top, 1).otherwise(0)
    marks = both.select("page_id", "url", "digest", again.cast("long").alias("again"), F.struct(F.col("top_id").alias("page_id"), F.col("top_url").alias("url")).alias("first")).where("again > 0")
    return marks, int(total)


_INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def _write(records: DataFrame, folder: str, file_bytes: int, date: str) -> DataFrame:
    """Writes the records of each task; the index rows."""
    kinds = pa.schema([(c, pa.int64() if k == "long" else pa.string()) for c, k in (x.split() for x in _INDEX.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = name = None
        at, mark, rank = 0, None, 0
        try:
            for batch in slices(batches):
                rows = []
                for r in batch.to_pylist():
                    key = r["page_id"], r["url"], r["digest"]
                    if mark is None or mark[0] != key:
                        mark, rank = [key, 0, None], 0
                    if r["member"] is None:
                        mark[1:] = r["again"], (r["first"]["page_id"], r["first"]["url"])
                        continue
                    data, kind, rank = r["member"], "response", rank + 1
                    if mark[1] > 0:
                        # of rows that repeat page, URL and payload the last is the response
                        mark[1] -= 1
                        data, kind = make_record(*key, date, rank=rank + 1, first=mark[2]), "revisit"
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        if store is None:
                            store, base = _store(folder)
                            store.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data)
                    rows.append({"file": f"{folder}/{name}", "offset": at, "length": len(data), "page_id": r["page_id"], "url": r["url"], "digest": r["digest"], "record_type": kind})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        finally:
            if out is not None:
                out.close()

    return records.mapInArrow(run, _INDEX)


def _store(path: str):
    """File system and path of a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, least: int = 1000, file_bytes: int = 64 << 20, task_bytes: int = TASK_BYTES, date: str = "2024-01-01T00:00:00Z") -> Archives:
    """Writes a record for each row of ``pages(page_id, url, html)``.

    The payload is the html in UTF-8, null as empty.  The response of equal payloads is that of
    the largest page_id (of repeats of that page, the first by url).  Null ids and URLs have no header line;
    control characters of a URL are written as %20.  Other columns aren't read.  An empty table gives an empty index.
    """
    ws = Workspace(pages.sparkSession, "warc")
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marks, total = _revisits(ws, source, least)
    tasks = tasks_for(total, task_bytes)
    marks = marks.select("page_id", "url", "digest", F.lit(0).cast("long").alias("payload_bytes"), "again", "first", F.lit(None).cast("binary").alias("member"))
    key = ["page_id", "digest", "url"]
    # markers sort before the rows they are about
    dealt = _members(source, date).unionByName(marks).repartition(tasks, *key).sortWithinPartitions(*key, F.col("member").isNotNull())
    return Archives(ws.table(_write(dealt, ws.path("archives"), file_bytes, date), "index"), tasks)


def parse_record(data: bytes) -> dict:
    """Header fields and payload of one record, a gzip member with nothing after it."""
    z = zlib.decompressobj(31)
    data = z.decompress(data)
    if not z.eof or z.unused_data:
        raise ValueError("no whole record at this range")
    head, _, block = data.partition(END.encode())
    lines = head.decode("utf-8").split(CRLF)
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block, ending = block[: int(fields["Content-Length"])], block[int(fields["Content-Length"]) :]
    if lines[0] != "WARC/1.1" or ending != END.encode():
        raise ValueError(f"no record at this range: {lines[0][:40]!r}")
    return {"fields": fields, "payload": block.partition(END.encode())[2] if fields["WARC-Type"] == "response" else None}


def merged_ranges(spans: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """Sorted ``(offset, length)`` -> ``(first, last + 1, start, stop)``: runs of spans read at once."""
    out: list[tuple[int, int, int, int]] = []
    for k, (at, n) in enumerate(spans):
        if out and at - out[-1][3] <= gap and at + n - out[-1][2] <= most:
            first, _, start, stop = out[-1]
            out[-1] = (first, k + 1, start, max(stop, at + n))
        else:
            out.append((k, k + 1, at, at + n))
    return out


def read_records(archives: Archives, selected: DataFrame | None = None, gap: int = 64 << 10, most: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """Records of the selected index rows (all without a selection), read back from the archives.

    ``(page_id, record_type, url, refers_to, header_digest, payload_bytes, payload_digest, payload)``:
    the last three are of the payload read, null for revisits; payload is null unless asked for.
    A response whose payload doesn't have the digest of its header is an error.
    """
    index = archives.index if selected is None else selected
    kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def record(data: bytes) -> dict:
        r = parse_record(data)
        f, payload = r["fields"], r["payload"]
        digest = None if payload is None else hashlib.sha1(payload).hexdigest()
        said = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if digest not in (None, said):
            raise ValueError(f"payload digest {digest} isn't {said}")
        number = lambda name: int(f[name]) if name in f else None
        return {
            "page_id": number("X-Page"), "record_type": f["WARC-Type"], "url": f.get("WARC-Target-URI"), "refers_to": number("X-Refers-To-Page"), "header_digest": said,
            "payload_bytes": None if payload is None else len(payload), "payload_digest": digest, "payload": payload if with_payload else None,
        }

    def read(path: str, rows: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            for first, last, start, stop in merged_ranges(rows, gap, most):
                data = f.read_at(stop - start, start)
                yield pa.RecordBatch.from_pylist([record(data[a - start : a - start + n]) for a, n in rows[first:last]], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rows = None, []
        for batch in batches:
            for p, a, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != path or len(rows) >= 4096:
                    if rows:
                        yield from read(path, rows)
                    path, rows = p, []
                rows.append((a, n))
        if rows:
            yield from read(path, rows)

    wanted = index.select("file", "offset", "length").repartition(archives.tasks, "file").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, "page_id long, record_type string, url string, refers_to long, header_digest string, payload_bytes long, payload_digest string, payload binary")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads all records, and resolves revisits by the response they share a digest with."""
    ws = Workspace(pages.sparkSession, "warc-read")
    archives = write_archives(pages)
    if archives.index.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    got = ws.table(read_records(archives).drop("payload", "url"), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = got.where("record_type = 'response'")
    again = got.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "header_digest")
    # a digest that is revisited has one response
    shared = whole.select(F.col("payload_digest"), "payload_bytes").where(F.col("payload_bytes") > 0)
    resolved = again.join(shared, again.header_digest == shared.payload_digest).select(*columns)
    return whole.select(*columns).union(resolved)
