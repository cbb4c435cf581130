"""SimHash against all pairs, and its documented cases."""

import random

import pytest
from xxhash import xxh64_intdigest

from veilgrid.llm import simhash
from veilgrid.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ")
    for c in "\t\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance=2):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= distance and root[j] != (r := min(root[i], root[j])):
                    root[j], changed = r, True
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(r) for r in root]


def test_documents_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f, c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps), strict=True)}
    got = {(r.id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == want
    assert len({c for _, _, c in want}) < len(want)


def test_edge_rows(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "É é"), (7, "é é"), (None, "one"), (4, "One"), (8, "a b c"), (9, "A b c"), (10, "x " * 50_000)]
    got = simhash.simhash_components(spark.createDataFrame([(i, t, "l", "s", 0) for i, t in texts], DOCS)).collect()
    assert len(got) == len(texts)
    by = {(r.id, r.fp % (1 << 64)): r.component_id for r in got}
    for i, t in texts:
        assert (i, brute_fingerprint(t)) in by
    assert by[(1, 0)] == by[(2, 0)] == by[(3, 0)] == 1
    assert by[(None, brute_fingerprint("one"))] == 4


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.simhash_dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("distance", "segments", "hot"), [(2, 2, 64), (2, 2, 1), (2, 3, 64), (3, 2, 64), (3, 2, 1), (1, 2, 2), (4, 4, 64)])
def test_links_reach_what_all_pairs_reach(spark, distance, segments, hot):
    rng = random.Random(distance * 10 + segments)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(12):
            g = f
            for _ in range(rng.randrange(4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.simhash_links(Workspace(spark, "t"), spark.createDataFrame([(f,) for f in signed], "fp long"), distance, segments, hot).collect()
    pos, root = {f: i for i, f in enumerate(signed)}, list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert bin((a ^ b) % (1 << 64)).count("1") <= distance
        i, j = find(pos[a]), find(pos[b])
        root[max(i, j)] = min(i, j)
    want = brute_components(list(range(len(fps))), fps, distance)
    assert [find(i) for i in range(len(fps))] == want


def test_dedup_keeps_one_of_each_group_with_all_columns(spark):
    rows = [(3, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "something else here now", "en", "s", 1), (None, "a b c d", "en", "s", 7)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", fp int")
    got = simhash.simhash_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 2), (True, 0)]


def test_dedup_tells_texts_of_one_id_apart(spark):
    a, b = "a b c d e f g", "something else here now and then"
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a), (0, "third words of their own"), (5, "third words of their own"), (5, "a fourth text that nothing else repeats")]
    got = simhash.simhash_dedup(spark.createDataFrame([(*r, "l", "s", 0) for r in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (1, b), (0, rows[5][1]), (5, rows[7][1])])


def test_fingerprint_is_that_of_the_hash_function(spark):
    for t in ("a b c d e", "One two", "", None, "a b c d"):
        assert simhash.fingerprint(t.encode() if t is not None else None) % (1 << 64) == brute_fingerprint(t)


def test_no_table_is_broadcast_by_the_size_of_its_file(spark):
    """At Spark's own threshold of 10 MB the probes, 34 rows a fingerprint, were broadcast."""
    rng, plans, most = random.Random(4), {}, []

    class Seen(Workspace):
        def table(self, df, label, rows=None):
            with self._lean():
                most.append(int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))
                plans[label] = df._jdf.queryExecution().executedPlan().toString()
            return super().table(df, label, rows)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        ws = Seen(spark, "t")
        fps = ws.table(spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(300)], "fp long"), "fps")
        simhash.simhash_links(ws, fps)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10m"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastExchange" not in plans["matches"] and max(most) <= 256 << 10
