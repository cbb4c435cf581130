"""Near-duplicate documents by SimHash: five-word shingles at a Jaccard similarity of 0.8 or more.

Two texts of Jaccard similarity s have a cosine of 2s / (1 + s), and a bit of their SimHashes differs with probability acos(cosine) / pi:
0.15 at 0.8.  Multi-index hashing comes first: ``TABLES`` segments of 32 bits of the fingerprint, each with the Hamming ball of radius 1 around
every text's value, so that two texts meet where a segment differs in two bits or fewer; most copies of 0.9 or more do.  Tables that find all at
0.8 need more and longer segments as the corpus grows, whatever the balls in them.  So what isn't joined yet gets further candidates
from bands of minimum hashes of the shingles (``ROWS`` in a band): two texts share a band with probability
1 - (1 - s ** ROWS) ** bands, whatever the size of the corpus.  Both kinds of tables have the same few rows for each text at any size.

Texts that the balls bring together are verified by their complete fingerprints and exact shingle sets.  Texts that share a band are verified in three steps: by the distance of 64 bits of their SimHash fingerprints, which
travel with each entry of the tables; those entries that have any partner by then, by the distance of the complete
fingerprints (``WORDS`` times 64 bits, long enough to tell 0.8 from 0.7); and at last by their exact shingle sets.

Texts of equal words are one node.  Every node is first compared with the heads of its buckets, a few times over, each time with
one in another group; a bucket's head is its node whose buckets hold most in all, which is the text in the middle of
many copies.  Then all that isn't in a bucket's largest group is compared
with every node of the bucket that is in another group.  So no link that joins two groups is left out, and many
copies around one text cost comparisons in proportion to their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from veilgrid.llm.components import connected_components
from veilgrid.llm.simhash import _ball, _signed
from veilgrid.llm.workspace import Workspace, column, fresh, slices, tasks_for

SHINGLE = 5
SIMILARITY = 0.8
#: Share of pairs at the similarity that shall meet in a band, and minimum hashes of a band.
RECALL, ROWS = 0.99, 6
#: 64-bit words of a fingerprint.
WORDS = 16
#: Standard deviations above the expected distance of pairs at the similarity that a check of fingerprints allows.
SPREAD = 2.5
#: Segments of 32 bits of the fingerprint that have a table with balls of radius 1.
TABLES = 4
#: Distinct texts whose ball points one task holds: 33 points for each segment, nearly all of them different, 60 to 70 bytes each.
BALLS_A_TASK = 4096
#: Bytes of an Arrow batch: texts are worked on one by one, so larger ones only take memory.
BATCH_BYTES = 4 << 20
#: Times that each node is compared with the highest head of its buckets, before all that is left is compared.
TURNS = 4
#: The filter of texts that are compared has about so many bits for each, and two to this power at most.
FILTER_SHARE, FILTER_MOST = 16, 28

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: ASCII letters and white space only


def node_key(text: bytes | None) -> int:
    """Signed 64-bit hash of a text's words; equal for texts that differ in case and white space only."""
    h = xxh64_intdigest(b" ".join(_words(text)), 1)
    return h - (1 << 64) if h >> 63 else h


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = _words(text)
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxh64_digest(joined, 42)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = (ends - [len(w) for w in words]).tolist()
        digests = b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)])
    return np.unique(np.frombuffer(digests, "<u8"))


def bit_flip(similarity: float) -> float:
    """Chance that a bit of two fingerprints differs, for sets of like size at this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Number of bands in one of which this share of pairs at the similarity meets."""
    return math.ceil(math.log(1 - recall) / math.log1p(-(similarity**ROWS)))


def band_keys(hashes: np.ndarray, bands: int) -> list[int]:
    """A key for each band: the number of the band and the least of each of its ROWS hash functions over the shingles; equal sets have equal keys."""
    if not len(hashes):
        return [0] * bands
    k = np.arange(1, bands * ROWS + 1, dtype=np.uint64)
    times, plus = (k * _MIX[0] ^ (k << np.uint64(31))) | np.uint64(1), (k * _MIX[1]) ^ (k << np.uint64(17))
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 10):  # bounded memory for texts of any length
        x = hashes[at : at + (1 << 10), None].astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * times + plus
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX[2]
    for row in least.reshape(bands, ROWS).T:
        key = (key ^ row) * _MIX[1]
        key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def check_radius(words: int = 1, similarity: float = SIMILARITY) -> int:
    """Largest distance of so many 64-bit words of pairs at the similarity, but for six in a thousand just at it."""
    p, n = bit_flip(similarity), 64 * words
    return math.ceil(n * p + SPREAD * math.sqrt(n * p * (1 - p)))


def long_simhash(hashes: np.ndarray, words: int) -> list[int]:
    """SimHash of so many signed 64-bit words: a bit is that of most shingles, and where they tie that of the least shingle."""
    if not len(hashes):
        return [0] * words
    salt = (np.arange(1, words + 1, dtype=np.uint64) * _MIX[0])[None, :]
    ones, least = np.zeros(words * 64, np.int64), None
    for at in range(0, len(hashes), 1 << 10):  # bounded memory for texts of any length
        x = hashes[at : at + (1 << 10), None].astype(np.uint64) + salt
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1)
        least = bits[0] if least is None else least
        for part in range(0, len(bits), 255):
            ones += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    twice = 2 * ones
    return np.packbits((twice > len(hashes)) | ((twice == len(hashes)) & (least > 0))).view("<i8").tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; that of two empty ones is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / n if (n := len(a) + len(b) - both) else 1.0


def sketches(docs: DataFrame, bands: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, node, n, fp, keys)`` for every row: key, number of shingles, fingerprint and band keys of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sizes, fps, keys = [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                s = shingle_set(text := t.as_py())
                nodes.append(node_key(text))
                sizes.append(len(s))
                fps.append(long_simhash(s, WORDS))
                keys.append(band_keys(s, bands))
            kind = pa.list_(pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, kind), pa.array(keys, kind)], names=["id", "node", "n", "fp", "keys"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "id long, node long, n long, fp array<long>, keys array<long>")


def _marks(nodes: np.ndarray, bits: int) -> np.ndarray:
    """Two positions of each node in the filter."""
    u = nodes.view(np.uint64)
    return np.stack([u >> np.uint64(64 - bits), (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)])


def _filter(nodes: DataFrame, bits: int, tasks: int = 8) -> np.ndarray:
    """Two to the power of ``bits`` bits of a Bloom filter over ``nodes(node)``; false hits only cost work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << bits, bool)
        for batch in batches:
            marked[_marks(batch.column(0).to_numpy(), bits).ravel()] = True
        yield pa.record_batch([pa.array([np.packbits(marked).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in nodes.repartition(tasks).mapInArrow(run, "bits binary").toLocalIterator():  # a fixed number of bounded size
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def _sets(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """``(node, shingles)`` of the texts whose key is in ``nodes``, once each; texts themselves aren't shuffled."""
    size = min(FILTER_MOST, max(10, math.ceil(math.log2(max(1, FILTER_SHARE * nodes.count())))))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(nodes, size))  # 32 MiB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in slices(batches):
            found = []
            for t in batch.column(0).cast(pa.binary()):
                if (key := node_key(text := t.as_py())) in seen:
                    continue
                if all(bits[m >> 3] >> (7 - (m & 7)) & 1 for m in _marks(np.array([key], np.int64), size).ravel().tolist()):
                    seen.add(key)
                    found.append((key, shingle_set(text).tobytes()))
            yield pa.record_batch([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["node", "shingles"])

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "node long, shingles binary")
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _similar(ws: Workspace, pairs: DataFrame, docs: DataFrame, text_col: str, similarity: float, label: str, rows: int | None = None) -> DataFrame:
    """Those of ``pairs(a, b)``, about so many rows if that is known, whose shingle sets are similar enough."""
    pairs = ws.table(pairs.distinct(), f"{label}-pairs", rows)
    if not (size := pairs.count()):
        return pairs
    needed = ws.table(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{label}-needed", 2 * size)
    sets = ws.table(_sets(docs, needed, text_col), f"{label}-sets")
    one = lambda side, name: sets.select(F.col("node").alias(side), F.col("shingles").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            near = [jaccard(np.frombuffer(p.as_py(), "<u8"), np.frombuffer(q.as_py(), "<u8")) >= similarity for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").select("a", "b", "x", "y")
    out = ws.table(both.mapInArrow(run, "a long, b long"), f"{label}-links")
    ws.drop(pairs, needed, sets)
    return out


def _nodes(rows: DataFrame, bands: int) -> DataFrame:
    """``(node, n, w0, w1, ..., k0, k1, ...)``: the distinct texts with the words of their fingerprints and their band keys."""
    # rows of a node are equal: a minimum of plain numbers is combined before the shuffle
    return rows.groupBy("node").agg(F.min("n").alias("n"), *[F.min(F.col("fp")[k]).alias(f"w{k}") for k in range(WORDS)], *[F.min(F.col("keys")[k]).alias(f"k{k}") for k in range(bands)])


def _index(nodes: DataFrame, bands: int) -> DataFrame:
    """Entries of the tables: ``(v, node, n, c)``, one for each band of each distinct text; v is the band's key, c the first word of the fingerprint."""
    return nodes.select("node", "n", F.col("w0").alias("c"), F.explode(F.array(*[F.col(f"k{k}") for k in range(bands)])).alias("v")).select("v", "node", "n", "c")


def ball_entries(nodes: DataFrame, count: int) -> DataFrame:
    """``(node, v)``: the points of the balls around the segments of ``nodes(node, w0, w1, ...)``, about ``count`` rows, dealt so that no task makes many."""
    high = _signed(((1 << 32) - 1) << 32)
    segments = [(F.col(f"w{s // 2}").bitwiseAND(F.lit(high)) if s % 2 == 0 else F.shiftleft(f"w{s // 2}", 32)).bitwiseOR(F.lit(s).cast("long")) for s in range(TABLES)]
    ball = F.explode(F.array(*[F.lit(_signed(m << 32)).cast("long") for m in _ball(32, 1)]))
    # a file of few MB has tens of thousands of texts; they are dealt before they grow to 132 rows each
    dealt = nodes.select("node", *[f"w{k}" for k in range((TABLES + 1) // 2)]).repartition(tasks_for(count, BALLS_A_TASK, 1 << 18), "node")
    return dealt.select("node", F.explode(F.array(*segments)).alias("v0")).select("node", "v0", ball.alias("m")).select("node", F.col("v0").bitwiseXOR(F.col("m")).alias("v"))


def ball_pairs(ws: Workspace, nodes: DataFrame, count: int | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes(node, w0, w1, ...)`` whose balls around a segment meet: for each node that with which it is paired most often.

    A point where balls meet gives one pair, of the first and the last of its nodes in an order of its own: many copies meet in many points,
    so a group's pairs are spread over it and their number follows that of its entries.
    """
    entries = ball_entries(nodes, nodes.count() if count is None else count)
    order = F.col("node").bitwiseXOR(F.col("v"))
    met = entries.groupBy("v").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo != hi").select(F.col("lo").bitwiseXOR(F.col("v")).alias("x"), F.col("hi").bitwiseXOR(F.col("v")).alias("y"))
    met = ws.table(met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("k")), "met")
    both = met.union(met.select("y", "x", "k"))
    often = F.shiftleft(F.col("k"), 48).bitwiseOR(F.shiftrightunsigned("y", 16))  # ties go by node
    best = both.groupBy("x").agg(F.max_by("y", often).alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def ball_links(ws: Workspace, nodes: DataFrame, docs: DataFrame, text_col: str, similarity: float, count: int) -> tuple[DataFrame, DataFrame]:
    """Of the ball pairs those whose fingerprints are near enough, and of these the links ``(a, b)`` whose shingle sets are."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), *[F.col(f"w{k}").alias(f"{x}{k}") for k in range(WORDS)])
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(WORDS)), F.lit(0))
    alike = (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * (similarity - 1e-9)) & (apart <= check_radius(WORDS, similarity))
    tried = ws.table(ball_pairs(ws, nodes, count).join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b"), "ball-tried", count)
    return tried, _similar(ws, tried, docs, text_col, similarity, "balls", count)


def near_links(ws: Workspace, rows: DataFrame, docs: DataFrame, bands: int, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` between the nodes of ``rows``, the sketches of ``docs``, that connect all candidates within the similarity."""
    radius = check_radius(1, similarity)
    nodes = ws.table(_nodes(rows, bands), "nodes")
    count = nodes.count()
    entries = count * bands
    index = ws.table(_index(nodes, bands), "index")
    # of the texts around one the middle lies in the fullest buckets: the heads are the nodes with the largest sums of bucket sizes
    full = ws.table(index.groupBy("v").agg(F.count("*").alias("held")).where("held > 1"), "full", entries)
    scores = ws.table(index.select("v", "node").join(full, "v").groupBy("node").agg(F.sum("held").alias("score")), "scores", count)
    placed = index.join(scores, "node")
    heads = placed.groupBy("v").agg(F.max("score").alias("s"), *[F.max_by(x, "score").alias(y) for x, y in (("node", "a"), ("n", "an"), ("c", "ac"))], F.count("*").alias("held"))
    heads = ws.table(heads.where("held > 1").drop("held"), "heads", entries)

    def near(p, q, x, y):
        """Sets of too different sizes can't be similar enough, nor can fingerprints too far apart be theirs."""
        return (F.least(p, q) >= F.greatest(p, q) * (similarity - 1e-9)) & (F.bit_count(x.bitwiseXOR(y)) <= radius)

    met = index.join(heads, "v").where((F.col("node") != F.col("a")) & near(F.col("n"), F.col("an"), F.col("c"), F.col("ac")))
    star = ws.table(met.select("a", F.col("node").alias("b"), "s").distinct(), "star", entries)
    ws.drop(full, scores, heads)
    # groups begin with what the balls join and grow by the highest head of each node's buckets, one at a time, while that joins any
    tried, links = ball_links(ws, nodes, docs, text_col, similarity, count)
    tried = tried.union(tried.select("b", "a"))
    groups = ws.table(connected_components(ws, links, count), "groups", count)
    for turn in range(TURNS):
        one, two = (groups.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
        apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
        star = ws.table(star.join(tried, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left").where(apart).select("a", "b", "s"), "star", entries)
        tried = ws.table(star.groupBy("b").agg(F.max_by("a", "s").alias("a")).select("a", "b"), "tried", count)
        found = _similar(ws, tried, docs, text_col, similarity, f"star{turn}", count)
        if turn and found.isEmpty():
            break
        links = links.union(found)
        groups = ws.table(connected_components(ws, links, count), "groups", count)
    ws.drop(star)
    rooted = ws.table(index.join(groups, "node", "left").select("v", "node", "n", "c", F.coalesce("root", "node").alias("root")), "rooted", entries)
    ws.drop(index)
    # the largest group of a bucket isn't compared with itself
    held = rooted.groupBy("v", "root").agg(F.count("*").alias("k"))
    main = held.groupBy("v").agg(F.max_by("root", "k").alias("main"), F.count("*").alias("roots")).where("roots > 1").select("v", "main")
    main = ws.table(main, "main", entries)
    mixed = ws.table(rooted.join(main, "v"), "mixed", entries)
    ws.drop(rooted, main)
    rooted = mixed.drop("main")
    rest = mixed.where("root != main").select("v", F.col("node").alias("a"), F.col("n").alias("an"), F.col("c").alias("ac"), F.col("root").alias("ar"), "main")
    # pairs inside the rest would come twice: once is enough
    once = (F.col("root") == F.col("main")) | (F.col("a") < F.col("node"))
    maybe = (F.col("root") != F.col("ar")) & once & near(F.col("n"), F.col("an"), F.col("c"), F.col("ac"))
    left, right, at = rooted.withColumnRenamed("v", "rv"), rest.withColumnRenamed("v", "rv"), F.col("rv") == F.col("v")
    # entries with a partner, each with its complete fingerprint and all its keys
    print_of = lambda side: nodes.select(F.col("node").alias(f"{side}_node"), *[F.col(f"w{k}").alias(f"{side}{k}") for k in range(WORDS)], *[F.col(f"k{k}").alias(f"{side}_k{k}") for k in range(bands)])
    own = rest.join(left, at & maybe, "left_semi").join(print_of("x"), F.col("a") == F.col("x_node")).drop("x_node")
    other = rooted.join(right, at & maybe, "left_semi").join(print_of("y"), F.col("node") == F.col("y_node")).drop("y_node")
    own, other = ws.table(own, "own", entries), ws.table(other, "other", entries)
    apart = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(WORDS)), F.lit(0))
    # a pair counts in the first table where it meets
    first = F.coalesce(*[F.when(F.col(f"x_k{k}") == F.col(f"y_k{k}"), F.col(f"x_k{k}")) for k in range(bands)])
    cross = other.join(own, "v").where(maybe & (apart <= check_radius(WORDS, similarity)) & (first == F.col("v"))).select("a", F.col("node").alias("b"))
    out = links.union(_similar(ws, cross, docs, text_col, similarity, "cross"))
    ws.drop(mixed, own, other, nodes)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Near-duplicate groups: ``(id, node, root, component_id)``, one row for each row of ``docs``.

    root names the group; component_id is the smallest id in it.  Null and blank texts are one
    group.  Rows with a null id are kept; a group of only such rows has a null component_id.
    An empty table gives no rows; other columns aren't read.
    """
    ws = Workspace(docs.sparkSession, "near", BATCH_BYTES)
    bands = bands_for(similarity, recall)
    rows = ws.table(sketches(docs, bands, id_col, text_col), "rows")
    links = near_links(ws, rows, docs, bands, text_col, similarity)
    count = rows.count()
    stars = ws.table(connected_components(ws, links, count), "stars", count)
    known = rows.select("id", "node").join(stars, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    known = ws.table(known, "known", count)
    first = known.groupBy("root").agg(F.min("id").alias("component_id"))
    return known.join(first, "root").select("id", "node", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents with one of each near-duplicate group: that with the smallest id.

    All columns of ``docs`` are kept, whatever their names.  Rows of one id with different texts are told apart, so that each
    group has one row; of rows that repeat both, the least by text stays.  Rows with a null id can't
    be named and stay.
    """
    ws = Workspace(docs.sparkSession, "near-keep", BATCH_BYTES)
    known = ws.table(near_components(docs, id_col, text_col, similarity, recall).where("id is not null"), "known")
    keep, want, rank, own = fresh(docs, "keep", "want", "rank", "own")
    first = known.groupBy("root").agg(F.min(F.struct("id", "node")).alias("k")).select(F.col("k.id").alias(keep), F.col("k.node").alias(want))
    often = known.groupBy("id").count().where("count > 1").select(F.col("id").alias("i"))
    first = ws.table(first.join(often, F.col(keep) == F.col("i"), "left"), "first")
    named = docs.where(column(id_col).isNotNull()).withColumn(own, column(id_col).cast("long"))
    columns = [column(c) for c in docs.columns]
    kept = named.join(first.where("i is null").select(keep).hint("merge"), F.col(own) == F.col(keep), "left_semi").select(*columns)
    more = first.where("i is not null").select(keep, want)
    if not more.isEmpty():
        key = F.pandas_udf(lambda texts: texts.map(lambda t: node_key(None if t is None else t.encode())).astype("int64"), "long")
        again = named.join(more, F.col(own) == F.col(keep)).where(key(column(text_col)) == F.col(want))
        again = again.withColumn(rank, F.row_number().over(Window.partitionBy(keep, want).orderBy(column(text_col).asc_nulls_first())))
        kept = kept.unionByName(again.where(F.col(rank) == 1).select(*columns))
    return kept.unionByName(docs.where(column(id_col).isNull()))
