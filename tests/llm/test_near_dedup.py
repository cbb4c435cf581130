"""Near-duplicate groups against all pairs, and recall on planted near copies."""

import random

import pytest

import corpus_pipeline
from veilgrid.llm import near_dedup as near

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_jaccard(a, b):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed=1, pairs=150):
    """Texts of random words, each with a copy of a few substituted words."""
    rng, out = random.Random(seed), []
    for k in range(pairs):
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice((60, 100, 300)))]
        copy = list(words)
        for at in rng.sample(range(len(copy)), max(1, len(copy) // 60)):
            copy[at] = f"x{rng.randrange(50_000)}"
        out += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", "s", 0) for i, t in rows], DOCS)


def test_the_stage_removes_ordinary_near_copies(spark):
    rows = planted()
    near_pairs = [k for k in range(len(rows) // 2) if brute_jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8]
    assert len(near_pairs) > 100
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert {2 * k for k in range(len(rows) // 2)} <= kept
    gone = sum(2 * k + 1 not in kept for k in near_pairs)
    assert gone >= 0.97 * len(near_pairs)
    assert len(rows) - len(kept) == gone  # pairs below 0.8 stay


def test_groups_against_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            if brute_jaccard(a, b) >= 0.8:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    got = {r.id: r.component_id for r in near.near_components(frame(spark, rows)).collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_links_beyond_the_least_of_a_bucket(spark):
    """A chain: its ends aren't similar, all share the buckets of the middle."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 150])) for k in range(12)]
    assert brute_jaccard(rows[0][1], rows[11][1]) < 0.8 <= brute_jaccard(rows[0][1], rows[1][1])
    assert {r.component_id for r in near.near_components(frame(spark, rows)).collect()} == {0}


def test_one_id_on_different_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (0, c), (3, a), (None, a)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in near.near_dedup(frame(spark, rows)).collect())
    assert got == sorted([(False, 1, a), (False, 1, b), (False, 0, c), (True, 0, a)])


def test_edges(spark):
    assert near.near_dedup(frame(spark, [])).count() == 0
    got = {r.id: r.component_id for r in near.near_components(frame(spark, [(4, None), (2, " \n"), (3, "One two"), (5, "one  two"), (6, "one")])).collect()}
    assert got == {4: 2, 2: 2, 3: 3, 5: 3, 6: 6}
    assert len(near.shingle_set(b"x " * 50_000)) == 1


@pytest.mark.parametrize("n", [1, 2, 5, 1024, 1300, 3000])
def test_fingerprint_is_the_majority_of_mixed_hashes(n):
    import numpy as np

    h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))

    def mixed(x, k):
        m = (1 << 64) - 1
        x = (int(x) + k * 0x9E3779B97F4A7C15) & m
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return (x ^ (x >> 31)).to_bytes(8, "little")

    for k, got in enumerate(near.long_simhash(h, 3), 1):
        bits = np.array([[b >> (7 - j) & 1 for b in mixed(x, k) for j in range(8)] for x in h])
        ones = bits.sum(axis=0)
        want = (2 * ones > len(h)) | ((2 * ones == len(h)) & (bits[0] == 1))
        assert np.packbits(want).tobytes() == got.to_bytes(8, "little", signed=True)


def test_band_keys_are_minimum_hashes():
    """The keys of a set depend on its members only, and agree as often as the sets are alike."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    assert near.band_keys(x, 16) == near.band_keys(np.sort(x), 16) and len(set(near.band_keys(x, 16))) == 16
    assert near.band_keys(x[:0], 3) == [0, 0, 0]
    for same, apart in ((160, 20), (60, 60)):
        s, met = same / (same + 2 * apart), 0
        for _ in range(200):
            both, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (same, apart, apart))
            p, q = (near.band_keys(np.concatenate([both, z]), 16) for z in (a, b))
            met += sum(u == v for u, v in zip(p, q, strict=True))
        assert abs(met / 3200 - s**near.ROWS) < 0.05


def test_share_of_pairs_at_the_similarity_that_meet():
    """Pairs just at 0.8 share a band and pass both checks of fingerprints about as often as reckoned; the number of bands is fixed."""
    import numpy as np

    rng, met, bands = np.random.default_rng(2), 0, near.bands_for()
    assert bands == 16
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (160, 20, 20))
        x, y = (np.sort(np.concatenate([both, z])) for z in (a, b))
        p, q = (np.array(near.long_simhash(z, near.WORDS)).view(np.uint64) for z in (x, y))
        away = [bin(int(u ^ v)).count("1") for u, v in zip(p, q, strict=True)]
        shared = any(u == v for u, v in zip(near.band_keys(x, bands), near.band_keys(y, bands), strict=True))
        met += shared and away[0] <= near.check_radius() and sum(away) <= near.check_radius(near.WORDS)
    assert met >= 0.96 * 300


def test_a_large_group_of_near_copies_costs_little(spark):
    """Pairs grow with the group, not with its square."""
    from veilgrid.llm.workspace import Workspace

    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs, seen = frame(spark, rows), []

    class Counted(Workspace):
        def table(self, df, label, rows=None):
            out = super().table(df, label, rows)
            if label.endswith("-pairs"):
                seen.append(out.count())
            return out

    bands = near.bands_for()
    links = near.near_links(Counted(spark, "t"), near.sketches(docs, bands), docs, bands)
    assert links.count() >= 399 and sum(seen) < 20 * len(rows)
    assert {r.component_id for r in near.near_components(docs).collect()} == {0}


def test_columns_of_any_name_are_kept(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = frame(spark, [(1, text), (2, text), (2, "other " + text[:40])]).selectExpr("*", "1 keep", "2 want", "3 rank", "4 own", "5 i", "6 node", "7 `a b.c`", "8 _keep")
    got = near.near_dedup(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.keep, r["a b.c"]) for r in got.collect()) == [(1, 1, 7), (2, 1, 7)]


def test_simhash_tables_with_balls_bring_near_copies_together(spark):
    """Segments that differ in two bits meet, in three don't; most copies of 0.9 or more are found before any minimum hash is asked."""
    from veilgrid.llm.workspace import Workspace

    ws, w = Workspace(spark, "t"), [11, -7, *range(14)]
    far, odd, three = [~x for x in w], [0x5555555555555555] * 16, 0b111 | 0b111 << 40
    rows = [(1, 9, *w), (-2, 9, w[0] ^ 0b111 ^ (0b11 << 40), 0x3333333333333333, *w[2:]), (3, 9, *far), (4, 9, far[0] ^ three, far[1] ^ 0b1 ^ (0b111 << 40), *far[2:])]
    rows += [(5, 9, *odd), (6, 9, odd[0] ^ three, odd[1] ^ three, *odd[2:])]
    nodes = spark.createDataFrame(rows, "node long, n long, " + ", ".join(f"w{k} long" for k in range(near.WORDS)))
    got = {tuple(r) for r in near.ball_pairs(ws, nodes).collect()}
    assert {(-2, 1), (3, 4)} <= got and (5, 6) not in got
    texts = planted(seed=2, pairs=200)
    docs, bands = frame(spark, texts), near.bands_for()
    key = lambda k: near.node_key(texts[k][1].encode())
    close = {tuple(sorted((key(2 * k), key(2 * k + 1)))) for k in range(200) if brute_jaccard(texts[2 * k][1], texts[2 * k + 1][1]) >= 0.9}
    alike = {tuple(sorted((key(2 * k), key(2 * k + 1)))) for k in range(200) if brute_jaccard(texts[2 * k][1], texts[2 * k + 1][1]) >= 0.8}
    _, links = near.ball_links(ws, near._nodes(near.sketches(docs, bands), bands), docs, "text", 0.8, 400)
    got = {tuple(r) for r in links.collect()}
    assert got <= alike and len(got & close) >= 0.6 * len(close) > 0


def test_no_task_makes_the_ball_points_of_many_texts(spark):
    """One file of many texts: a task's map of points held all of them."""
    from pyspark.sql import functions as F

    count = 5 * near.BALLS_A_TASK
    nodes = spark.range(0, count, 1, 1).select(F.xxhash64("id").alias("node"), F.lit(9).cast("long").alias("n"), *[F.xxhash64("id", F.lit(k)).alias(f"w{k}") for k in range(near.WORDS)])
    held = [r["count"] for r in near.ball_entries(nodes, count).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == count * near.TABLES * 33 and max(held) <= 1.2 * near.BALLS_A_TASK * near.TABLES * 33


def test_arrow_batches_of_the_stage_are_small(spark, monkeypatch):
    """Whole texts of 24 MB in one partition reach a task in batches of about BATCH_BYTES."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from veilgrid.llm.workspace import Workspace

    sizes = []

    def sketches(docs, bands, id_col, text_col):
        def run(batches):
            for b in batches:
                yield pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["size"])

        return docs.select(id_col, text_col).mapInArrow(run, "size long")

    class Seen(Workspace):
        def table(self, df, label, rows=None):
            out = super().table(df, label, rows)
            if label == "rows":
                sizes.extend(r.size for r in out.collect())
                raise StopIteration
            return out

    monkeypatch.setattr(near, "sketches", sketches)
    monkeypatch.setattr(near, "Workspace", Seen)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    with pytest.raises(StopIteration):
        near.near_components(docs)
    assert sum(sizes) > 20 << 20 and max(sizes) <= 6 << 20
