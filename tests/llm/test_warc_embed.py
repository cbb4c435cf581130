"""WARC round trip and embedding near-duplicates."""

import hashlib
import math
import random

import numpy as np
import pytest

from veilgrid.llm import embedding_dedup, warc

PAGES = "page_id long, url string, html string, digest string, shard int"


def brute_warc(rows, least=1000):
    groups = {}
    for k, (i, u, h) in enumerate(rows):
        groups.setdefault((h or "").encode(), []).append((i is not None, i or 0, k))
    out = []
    for payload, members in groups.items():
        digest = hashlib.sha1(payload).hexdigest()
        members.sort(key=lambda m: (m[0], m[1]))
        top = members[-1]
        for k, m in enumerate(members):
            i = m[1] if m[0] else None
            if len(payload) < least or k == len(members) - 1:
                out.append((i, len(payload), digest, "response", None))
            else:
                out.append((i, len(payload), digest, "revisit", top[1] if top[0] else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rng = random.Random(0)
    big = ["é" * 600, "x" * 1000, "y" * 999, "\r\n\r\n" * 400, "WARC/1.1\r\n\r\n" * 100]
    rows = [(i, f"http://h{i}/\r\nX: y", rng.choice([*big, "", None, f"page {i}" * 300])) for i in range(300)]
    rows += [(7, "http://a/", "x" * 1000), (7, "http://b/", "x" * 1000), (None, None, "x" * 1000), (None, None, "q" * 2000), (999, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "d", 3) for r in rows], PAGES)
    assert sorted(map(tuple, warc.warc_round_trip(df).collect()), key=str) == brute_warc(rows)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_pages(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    assert sorted(map(tuple, warc.warc_round_trip(df).collect()), key=str) == brute_warc([(r.page_id, r.url, r.html) for r in df.collect()])


def test_selected_records_and_index(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(100)]
    a = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), task_bytes=4000, file_bytes=700)
    assert a.index.select("file").distinct().count() > 3
    some = warc.read_records(a, a.index.where("url like '%7'"), with_payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {i: f"<p>{i}</p>" * (i + 1) for i in range(100) if str(i).endswith("7")}


def test_merged_ranges():
    assert warc.merged_ranges([(0, 10), (10, 5), (100, 5), (106, 1000)], 8, 50) == [(0, 2, 0, 15), (2, 3, 100, 105), (3, 4, 106, 1106)]


VECS = "vec_id long, embedding array<float>, label int, node string"


def brute_links(rows, threshold=0.95):
    x = []
    for _, v in rows:
        ok = v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        a = np.array(v, np.float32).astype(np.float64) if ok else None
        x.append(a / np.linalg.norm(a) if ok else None)
    n = len(rows)
    links = [[j for j in range(n) if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in range(n)]
    seen, comp = [None] * n, {}
    for s in range(n):
        if seen[s] is None:
            todo = [s]
            while todo:
                i = todo.pop()
                if seen[i] is None:
                    seen[i] = s
                    todo += links[i]
    for i in range(n):
        if rows[i][0] is not None:
            comp[seen[i]] = min(comp.get(seen[i], rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], len(links[i]), comp.get(seen[i])) for i in range(n)), key=str)


def vectors(n=250, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n // 5):
        base = rng.standard_normal(16)
        rows += [(len(rows) + k, (base + rng.standard_normal(16) * 0.04).tolist()) for k in range(1 + g % 9)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [float("inf")] * 16), (9006, [1.0] * 8), (9007, [2.0] * 8), (None, [3.0] * 8), (5, rows[5][1]), (9008, [1e-30] * 16), (9009, [1e30] * 16), (9010, [-0.0] + [1.0] * 15), (9011, [0.0] + [1.0] * 15)]
    return rows


@pytest.mark.parametrize("chunk", [128, 3])
def test_embedding_links(spark, chunk):
    rows = vectors()
    got = embedding_dedup.embedding_links(spark.createDataFrame([(*r, 1, "n") for r in rows], VECS), chunk=chunk, recall=0.999999)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)
    assert embedding_dedup.embedding_links(spark.createDataFrame([], VECS)).count() == 0


def test_recall_on_the_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    want = brute_links([(r.vec_id, r.embedding) for r in df.collect()])
    got = {r.id: r.n_links for r in embedding_dedup.embedding_links(df).collect()}
    assert all(got[i] <= n for i, n, _ in want)
    assert sum(got.values()) >= 0.9 * sum(n for _, n, _ in want)


def test_recall_at_the_threshold():
    """Pairs just above the threshold meet about as often as reckoned."""
    rng = np.random.default_rng(1)
    k, tables = embedding_dedup.table_sizes(50_000, 0.95, 0.95)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((400, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * o
    met = (embedding_dedup.signatures(a, k, tables, 7) == embedding_dedup.signatures(b, k, tables, 7)).any(axis=1)
    assert met.mean() > 0.9
