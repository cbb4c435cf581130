"""Chat formatting: round trip, sharing, and places."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilgrid.llm import chat_format

ROWS = "conv_id long, turn long, role string, text string, node string, path int"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=20) | st.lists(st.sampled_from([*chat_format.CONTROL, "<|turn|>", "<|end|>", "\\", "\n", "<", "|", "[", "s>", "é"]), max_size=12).map("".join), st.sampled_from(["user", "a\nb", "\\", "", "<|end|>"]))
def test_template_round_trip(text, role):
    formatted, a, b = chat_format.format_turn(role, text)
    assert chat_format.parse_turn(formatted) == (role, text)
    assert chat_format.unescape(formatted[a:b]) == text
    assert not any(c in formatted[a:b] for c in chat_format.CONTROL)


def brute(rows):
    out = {}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    for c, turns in convs.items():
        turns.sort(key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in (r[1],)) + ((r[2] or "", r[3] or ""),))
        learnt = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (
            len(turns), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest(),
            len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), sum(len(chat_format.format_turn(r[2] or "", r[3] or "")[0]) for r in turns),
        )
    return out


def sample(seed=0, n=60):
    rng = random.Random(seed)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, ("system", "user", "assistant")[t % 3], rng.choice(["a", "b", "<|end|>", "é\\", None, "long " * 50])))
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (900, 1, None, None), (900, 1, None, None), (901, 0, "assistant", "z" * 100_000)]
    return rows


def test_read_back_and_structure(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], ROWS)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.chat_digest(df).collect()}
    assert got == brute(rows)
    segments, members = chat_format.format_conversations(df)
    segs = segments.orderBy("seq_id", "segment").collect()
    by = {}
    for s in segs:
        by.setdefault(s.seq_id, []).append(s)
    for tree in by.values():
        nodes = [s.node for s in tree]
        assert len(nodes) == len(set(nodes))  # a shared turn once
        at = 0
        for s in tree:
            assert s.start == at and s.stop - s.start == len(s.formatted)
            at = s.stop
            assert s.position == sum(a.stop - a.start for a in s.ancestors)  # positions go on where the ancestors end
            assert all(a.stop <= s.start for a in s.ancestors)
        text = "".join(s.formatted for s in tree)
        for s in tree:  # the ancestors' intervals and the segment are one conversation's beginning
            prefix = "".join(text[a.start : a.stop] for a in s.ancestors) + s.formatted
            assert prefix.count(chat_format.TURN) == s.depth + 1
    assert len(segs) < len(rows)
    assert members.count() == len({r[0] for r in rows})


def test_equal_conversations_and_one_common_first_turn(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "hi" if t == 0 else f"{c % 5} {t}") for c in range(200) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments, _ = chat_format.format_conversations(df)
    shards = segments.selectExpr("split(seq_id, '-')[0] s").distinct().count()
    assert segments.count() <= 1 + 5 * 2 + 2 * shards
    assert {r.conv_id: tuple(r)[1:] for r in chat_format.chat_digest(df).collect()} == brute(rows)


def test_one_prompt_shared_by_all_is_cut_by_length(spark):
    """Sequences keep to their bound, each begins with the prompt, and the shards are even."""
    said, rng = "prompt " * 20, random.Random(5)
    rows = [(c, t, ("system", "user", "assistant")[t], said if t == 0 else f"{c} " * rng.randrange(1, 60)) for c in range(400) for t in range(3)]
    rows += [(1000, 0, "system", said), (1000, 1, "user", "long " * 4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments, _ = chat_format.format_conversations(df, sequence_chars=4000, shard_chars=9000)
    by, shards = {}, {}
    for s in segments.collect():
        by.setdefault(s.seq_id, []).append(s)
        shards[s.seq_id.split("-")[0]] = shards.get(s.seq_id.split("-")[0], 0) + len(s.formatted)
    assert len(by) > 20 and len(shards) > 8
    for tree in by.values():
        tree.sort(key=lambda s: s.segment)
        assert tree[0].depth == 0 and said.strip() in tree[0].formatted and sum(s.depth == 0 for s in tree) == 1
        assert tree[-1].stop <= 4000 or sum(s.ends_conversation for s in tree) == 1
    assert max(n for n in shards.values() if n < 20_000) <= 9000 + 4000
    assert sum(map(len, by.values())) == 2 * 400 + 1 + len(by)  # besides the prompts no turn is repeated
    assert {r.conv_id: tuple(r)[1:] for r in chat_format.chat_digest(df, sequence_chars=4000, shard_chars=9000).collect()} == brute(rows)


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame(sample(2, 5), "conv_id long, turn long, role string, text string")
    segments, _ = chat_format.format_conversations(df, P.path("byte_bpe_50k.json"))
    for s in segments.collect():
        assert s.stop - s.start == len(s.tokens) and s.position == sum(a.stop - a.start for a in s.ancestors)


def test_empty(spark):
    assert chat_format.chat_digest(spark.createDataFrame([], ROWS)).count() == 0
