"""Secret scan: keyword automaton, anchored patterns at its hits, embedded checksums.

One Aho-Corasick pass over the ASCII-lowered text finds the keywords of every kind; a kind's
regular expression is then matched only at its hits, anchored there.  Runs of hexadecimal
digits have no keyword; their own pattern is a single character class and is scanned directly.
Kinds that embed a checksum are reported only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.workspace import slices

# Kinds in the order in which equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
# Lower-case keywords whose hits are candidates of a kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "xprv": "xprv",
}
# The pattern of a kind, matched where a keyword starts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
LEAST = {"assign": 12, "access": 18, "hex": 16}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


def crc_token_ok(body: str, tail: str) -> bool:
    """Whether tail is the CRC-32 of body as six base-62 digits."""
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return digits == tail


def base58check_ok(value: str) -> bool:
    """Whether the last four bytes are the checksum of the rest (two rounds of SHA-256)."""
    n = 0
    for c in value:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def _anchored(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """End of the kind's match at a position and whether it counts; None: no match."""
    if kind == "assign":
        m = ASSIGN.match(text, at)
        return m and (m.end(), len(m[2]) >= LEAST["assign"])
    if kind == "access":
        m = ACCESS.match(text, at)
        return m and (m.end(), m.end() - at >= LEAST["access"])
    if kind == "xprv":
        m = XPRV.match(text, at)
        return m and (m.end(), base58check_ok(m[0]))
    m = (GITHUB if kind == "github" else NPM).match(text, at)
    return m and (m.end(), crc_token_ok(m[1], m[2]))


class Scanner:
    """Finds secrets in one text at a time."""

    def __init__(self) -> None:
        self._hits = _automaton()

    def scan(self, text: str | None) -> list[tuple[int, int, str]]:
        """``(start, end, kind)`` in code points, end exclusive, by start and then kind.

        Within a kind, matches are leftmost and don't overlap; a match that fails its length or
        checksum is dropped but has used up its characters.
        """
        if not text:
            return []
        found = [(m.start(), m.end(), "hex") for m in _HEX_RUN.finditer(text)]
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII only, so places stay
        starts: dict[str, list[int]] = {}
        for end, (kind, n) in self._hits.iter(lowered):
            starts.setdefault(kind, []).append(end + 1 - n)
        for kind, places in starts.items():
            free = 0
            for at in sorted(places):
                if at >= free and (m := _anchored(kind, text, at)):
                    free = m[0]
                    if m[1]:
                        found.append((at, m[0], kind))
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def spans_text(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by ``[SECRET]``."""
    out, at, cover = [], 0, -1
    for a, b, _ in sorted(found):
        if a >= cover:
            out += [text[at:a], "[SECRET]"]
        cover = at = max(cover, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, found)`` for every row; found: array of ``(start, end, kind)`` as of Scanner.scan.

    Null and empty texts have no spans; null ids and repeated rows stay; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kind = Scanner(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in slices(batches):
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in scanner.scan(t.as_py())] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["id", "found"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "id long, found array<struct<start: long, end: long, kind: string>>")


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with every secret in the text replaced by ``[SECRET]``.

    Same columns and rows; where a text changed, chars_col (if there is one) is its new length in
    code points.  Texts without secrets, nulls included, stay as they are.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    chars = names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches):
            texts, changed = batch.column(at).to_pylist(), {}
            for i, t in enumerate(texts):
                if t and (found := scanner.scan(t)):
                    texts[i] = changed[i] = redact(t, found)
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    lengths = columns[chars].to_pylist()
                    for i, t in changed.items():
                        lengths[i] = len(t)
                    columns[chars] = pa.array(lengths, columns[chars].type)
                batch = pa.record_batch(columns, schema=batch.schema)
            yield batch

    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # columns go by place: any name will do
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, for every row."""
    found = F.col("found")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(found, lambda x: x["kind"].isin(*KINDS[:3]))
    return scan_secrets(docs, id_col, text_col).select(
        F.col("id").alias(id_col), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(found).alias("spans"),
    )
