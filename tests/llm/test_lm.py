"""Language-model scores against plain counting."""

import cProfile
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilgrid.llm import lm_scoring

DOCS = "doc_id long, text string, block long, score string"


def tokens(text):
    return (text or "").encode().lower().split() + [b" end"]


def brute(rows):
    """Counts of whole texts, probabilities by the recursion, no automaton."""
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    uni, bi, tri, texts = Counter(), Counter(), Counter(), 0
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            w = tokens(t)
            uni.update(w)
            w = [b" begin", *w]
            bi.update(zip(w, w[1:], strict=False))
            tri.update(zip(w, w[1:], w[2:], strict=False))
            texts += 1
    n, v = sum(uni.values()), len(uni)
    seen = lambda x: texts if x == b" begin" else uni[x]

    def p1(x):
        return (uni[x] + 1) / (n + v + 1)

    def p2(b, x):
        m = lm_scoring.MASS[0]
        return (bi[b, x] + m * p1(x)) / (seen(b) + m)

    def p3(a, b, x):
        m = lm_scoring.MASS[1]
        return (tri[a, b, x] + m * p2(b, x)) / (bi[a, b] + m) if bi[a, b] >= lm_scoring.MIN_CONTEXT else p2(b, x)

    out = []
    for (i, t), h in zip(rows, held, strict=True):
        w = [b" begin", *tokens(t)]
        score = sum(math.log10(p2(w[k - 1], w[k]) if k == 1 else p3(*w[k - 2 : k + 1])) for k in range(1, len(w)))
        out.append((i, h, len(w) - 1, sum(x in uni for x in w[1:]), n, sum(math.log10(p1(x)) for x in w[1:]), score))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *(round(x, 6) for x in r[2:]))


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-7, abs=1e-5)


@pytest.mark.parametrize(("block", "fan"), [(1 << 20, 256), (40, 3), (700, 2)])
def test_against_plain_counts(spark, block, fan):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "The", "cat", "sat", "on", "mat", "É", "x" * rng.randrange(1, 4)]) for _ in range(rng.randrange(25)))) for i in range(80)]
    rows += [(80, None), (81, ""), (None, "the cat"), (5, "the cat sat"), (5, "the cat sat"), (82, "mat " * 3000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], DOCS)
    same(lm_scoring.score_documents(docs, block=block, fan=fan).collect(), brute(rows))


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    same(lm_scoring.score_documents(docs).collect(), brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def test_edges(spark):
    docs = spark.createDataFrame([], DOCS)
    assert lm_scoring.score_documents(docs).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "a b") for i in held]
    same(lm_scoring.score_documents(spark.createDataFrame([(*r, 0, "") for r in rows], DOCS)).collect(), brute(rows))


def small_model():
    """An automaton over one block, all of it learnt."""
    rng = random.Random(1)
    texts = [[rng.randrange(2, 8) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    parts = [np.array([lm_scoring.BEGIN, *t, lm_scoring.END]) for t in texts]
    one = np.ones(len(parts), np.int64)
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 9, dtype=np.uint64)  # the last word is unknown
    block = lm_scoring.Block(0, one, list(range(40)), np.array([len(p) for p in parts]), one, one == 0, np.concatenate(parts), hashes)
    words, bigrams = block.words(), block.bigrams()
    trigrams = block.trigrams(bigrams, lm_scoring.is_state(bigrams, bigrams.counts, 9))
    n = int(words.sum() - words[lm_scoring.BEGIN])
    v = int((np.delete(words, lm_scoring.BEGIN) > 0).sum())
    return block, lm_scoring.compile_automaton(words, bigrams, bigrams.counts, trigrams, trigrams.counts, n, v)


def test_probabilities_of_a_state_sum_to_one():
    block, model = small_model()
    every = np.array([w for w in range(9) if w != lm_scoring.BEGIN])
    reached, todo = set(), [0, int(model.first[lm_scoring.BEGIN])]
    while todo:
        if (s := todo.pop()) not in reached:
            reached.add(s)
            gained, after = model.step(np.full(len(every), s), every)
            assert (10.0**gained).sum() == pytest.approx(1.0)  # the unknown word stands for all unknown ones
            todo += after.tolist()
    assert sum(s > 9 for s in reached) > 20  # states of two words
    assert all(model.back[s] == 0 if s <= 9 else 0 < model.back[s] <= 9 for s in reached if s)


def test_lanes_carry_the_state():
    block, model = small_model()
    whole = model.scores(block, lane=1 << 20)
    for lane in (2, 3, 7):
        assert model.scores(block, lane) == pytest.approx(whole)


def test_messages_grow_in_proportion(spark):
    """Rows that nodes send, over 6, 12 and 24 blocks with a fan of 4, and what a part is sent of the commonest word."""
    from veilgrid.llm.workspace import Workspace

    sent = {}
    for blocks in (6, 12, 24):
        rows = [(i, " ".join(f"w{(7 * i + k * k) % 900}" for k in range(99)) + " the") for i in range(blocks)]
        made = []

        class Counted(Workspace):
            def table(self, df, label):
                out = super().table(df, label)
                if label == "sent":
                    made.append((out.count(), out.groupBy("to_prefix", "to_node", "kind").count().agg({"count": "max"}).first()[0]))
                return out

        ws = Counted(spark, "t")
        table = ws.table(lm_scoring._blocks(spark.createDataFrame(rows, "id long, t string").coalesce(1), 7, 2, 102), "blocks")
        assert table.count() == blocks
        lm_scoring.totals(ws, lm_scoring._ask_words_and_bigrams(table), blocks, 4)
        sent[blocks] = sum(n for n, _ in made), max(k for _, k in made)
    for blocks, (rows, most) in sent.items():  # two kinds, four ranges a node, levels by the logarithm
        assert rows <= blocks * 2 * 4 * math.ceil(math.log(blocks, 4)) and most <= 16


def test_a_doubled_text_is_scored_apart(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60))) for i in range(0, 400)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    rows += [(1000 + i, t) for i, t in rows[:20] if zlib.crc32(str(1000 + i).encode()) % 7 != 2]
    got = {r.id: r.score / r.n_tokens for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = {i - 1000 for i in got if i >= 1000}
    assert min(got[i] for i in twice) > max(x for i, x in got.items() if i < 1000 and i not in twice)


def test_packing_of_numbers():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(x)) == x).all()
    assert len(lm_scoring.unpack(lm_scoring.pack(x[:0]))) == 0


class Local:
    """What a task makes of one batch, in this process."""

    def __init__(self, **columns):
        self.batch = pa.RecordBatch.from_pydict(columns)

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter([self.batch])))


class FirstTask:
    get = classmethod(lambda cls: cls)
    partitionId = classmethod(lambda cls: 0)  # noqa: N815


def test_calls_do_not_follow_tokens(monkeypatch):
    """Texts of few different words: splitting and numbering them is no call a token."""
    monkeypatch.setattr(lm_scoring, "TaskContext", FirstTask)
    texts = [" ".join(f"w{(i * k) % 300}" for k in range(2000)) for i in range(50)]
    with cProfile.Profile() as p:
        blocks = lm_scoring._blocks(Local(id=list(range(50)), t=texts), 7, 2, 1 << 20)
    assert sum(e.callcount for e in p.getstats()) < 20_000  # of 100,050 tokens
    block = lm_scoring._block_of(blocks[0].to_pylist()[0])
    assert len(blocks) == 1 and len(block.tokens) == 50 * 2002 and len(block.hashes) == 302


def test_split_as_bytes_are(monkeypatch):
    """Any white space of ASCII and no other, and capitals of A to Z only."""
    monkeypatch.setattr(lm_scoring, "TaskContext", FirstTask)
    rng = random.Random(3)
    texts = [None, "", " ", *("".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0AzÉß\0x") for _ in range(rng.randrange(20))) for _ in range(2000))]
    (row,) = lm_scoring._blocks(Local(id=list(range(len(texts))), t=texts), 7, 2, 1 << 20)[0].to_pylist()
    block = lm_scoring._block_of(row)
    ends = np.cumsum(block.lengths)
    for text, start, end in zip(texts, block.starts, ends, strict=True):
        want = [lm_scoring.xxh64_intdigest(w) for w in (b" begin", *tokens(text))]
        assert block.hashes[block.tokens[start:end]].tolist() == want


def test_order_of_numbers():
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    close = np.concatenate([wide[:1], np.uint64(1 << 63) + rng.integers(0, 50, 3000, dtype=np.uint64), [np.uint64(0), np.uint64((1 << 64) - 1)]])  # more bits than there is room
    for x in (wide, np.concatenate([wide, wide[:999]]), close, wide[:1], wide[:0], rng.integers(0, 9, 500), np.zeros(7, np.int64)):
        assert (lm_scoring.order_of(x) == np.argsort(x, kind="stable")).all()
        for got, want in zip(lm_scoring.distinct(x), np.unique(x, return_index=True, return_inverse=True), strict=True):
            assert (got == want).all() and len(got) == len(want)
