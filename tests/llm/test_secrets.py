"""Secret scan against plain regular expressions, and its checksums."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilgrid.llm import secrets


def brute_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), m.end(), "assign"))
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))


PIECES = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apikey", "=", ":", " ", '"', "'", "AKIA", "akia", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "abcdefghijkl", "ghp_", "ſecret", "-", "to"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans(text):
    got = [x for x in secrets.Scanner().scan(text) if x[2] in secrets.KINDS[:3]]
    assert got == brute_base(text)


def github(body="a" * 30, prefix="ghp_"):
    crc, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        tail = secrets.BASE62[d] + tail
    return prefix + body + tail


def test_checksums():
    good = github("Zx9" * 10)
    scan = secrets.Scanner().scan
    assert [x[2] for x in scan(f"see {good}.")] == ["github"]
    assert scan(f"see {good[:-1]}{'0' if good[-1] != '0' else '1'}.") == []
    assert [x[2] for x in scan(github("Ab3" * 10, "npm_"))] == ["npm"]
    raw = bytes(range(78))
    raw = b"\x04\x88\xad\xe4" + raw[4:]
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, key = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        key = secrets.BASE58[d] + key
    assert key.startswith("xprv") and len(key) == 111
    assert [x[2] for x in scan(f"k {key} k")] == ["xprv"]
    assert not [x for x in scan(f"k {key[:-1]}{'1' if key[-1] != '1' else '2'} k") if x[2] == "xprv"]


def test_query_columns(spark):
    texts = [(1, None), (2, ""), (3, "😀 token = 'abcdefghijklm' x"), (None, "AKIA" + "Q" * 16), (3, "0123456789abcdef" * 3000), (4, github())]
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in texts], "doc_id long, text string, found int, kind string")
    got = {(r.doc_id, r.spans): r for r in secrets.secret_digest(docs).collect()}
    assert len(got) == 6
    r = got[(3, "assign:2:24")]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 0, 0) and r.base_sha256 == hashlib.sha256(b"assign:2:24").hexdigest()
    assert (3, "hex:0:48000") in got and (None, "access:0:20") in got
    gh = next(r for (i, _), r in got.items() if i == 4)
    assert "github:0:40" in gh.spans and "github" not in str(gh.n_assign) and gh.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in brute_base(github())).encode()).hexdigest()
    assert secrets.secret_digest(docs.limit(0)).count() == 0


def test_documents_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: ",".join(f"{k}:{a}:{b}" for a, b, k in brute_base(r.text)) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.base_sha256 for r in secrets.secret_digest(docs).collect()}
    assert got == {i: hashlib.sha256(s.encode()).hexdigest() for i, s in want.items()}


def test_redaction_changes_only_secrets(spark):
    rows = [(1, "keep me", 7), (2, "password: abcdefghijkl0123456789abcdef end", 42), (3, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("keep me", 7), 2: ("[SECRET] end", 12), 3: (None, None)}


@pytest.mark.parametrize(("found", "want"), [([(0, 3, "a"), (2, 5, "b")], "[SECRET]fg"), ([(0, 5, "a"), (1, 2, "b"), (6, 7, "c")], "[SECRET]f[SECRET]"), ([], "abcdefg")])
def test_redact_overlaps(found, want):
    assert secrets.redact("abcdefg", found) == want
