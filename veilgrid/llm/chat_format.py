"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them.  Distinct conversations are sorted by
the hashes of their turns, which puts every subtree in one stretch; each stretch is then emitted
depth-first, a shared turn once.  A sequence is one tree of a stretch: its segments (one for
each turn) are laid end to end, and each has its place in the sequence, the position ids of its
conversation (which continue those of its ancestors), and the intervals of the sequence that
hold its ancestors, which its tokens may attend to besides their own segment.

A sequence has a bounded number of characters, unless one conversation alone has more: where a tree goes
beyond, or spans two ranges of the order, another sequence begins with the turns on the path to its first
conversation, since intervals can't point into another sequence.  Sequences are dealt to shards by the length of
their texts, so that tasks have like amounts however the conversations share their turns.  Sorting and emission keep
the state of one path; no tree or group of equal conversations is ever gathered.

The template of a turn is ``<|turn|>role newline text <|end|> newline``.  A backslash goes before every backslash
and after the first character of every control string inside a role or text, and before a newline inside a role;
dropping it restores them.  Units of lengths, places and positions are code points, or tokens where a tokenizer is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.workspace import Workspace, slices

# The template's marks, and strings that other chat templates use for control.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")

_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END) + r"\n", re.S)
#: Role whose texts are learnt.
LEARNT = "assistant"
#: Characters of a sequence at most, and of a shard about.
SEQUENCE_CHARS, SHARD_CHARS = 1 << 17, 1 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends."""
    head = TURN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _TURN.fullmatch(formatted)
    return unescape(m[1]), unescape(m[2])


def _signed(b: bytes) -> int:
    return int.from_bytes(b, "big", signed=True)


def _turns(rows: DataFrame) -> DataFrame:
    """Turns in order with the hash of the path to each: ``(conv_id, idx, role, text, node, path, sizes)``.

    path and sizes are set on the last turn: 8 bytes of hash, and the characters of the formatted turn in 8 bytes, for each
    turn of the conversation.
    """
    kinds = pa.schema([("conv_id", pa.int64()), ("idx", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("node", pa.int64()), ("path", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, path, sizes, digest = object(), None, [], [], b""
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                if r["conv_id"] != key:
                    if last:
                        out.append(last | {"path": b"".join(path), "sizes": b"".join(sizes)})
                    key, last, path, sizes, digest = r["conv_id"], None, [], [], b""
                if last:
                    out.append(last)
                role, text = r["role"] or "", r["text"] or ""
                digest = hashlib.blake2b(digest + len(role.encode()).to_bytes(8, "big") + role.encode() + text.encode(), digest_size=16).digest()
                last = {"conv_id": key, "idx": len(path), "role": role, "text": text, "node": _signed(digest[:8]), "path": None, "sizes": None}
                path.append(digest[:8])
                sizes.append(len(format_turn(role, text)[0]).to_bytes(8, "big"))
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if last:
            yield pa.RecordBatch.from_pylist([last | {"path": b"".join(path), "sizes": b"".join(sizes)}], schema=kinds)

    source = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, idx long, role string, text string, node long, path binary, sizes binary")


def _ranked(paths: DataFrame, sequence_chars: int, shard_chars: int) -> DataFrame:
    """Distinct conversations in the order of their paths: ``(rep, shard, ord, shared)``.

    shared: turns that are in the sequence already; 0 where a sequence begins, and there the text of a full shard ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, before, sequence, filled = TaskContext.get().partitionId() << 32, 0, b"", 0, 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for path, chars in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sizes, same = [int.from_bytes(chars[k : k + 8], "big") for k in range(0, len(chars), 8)], 0
                while same < min(len(path), len(before)) and path[same : same + 8] == before[same : same + 8]:
                    same += 8
                same //= 8
                if sequence + sum(sizes[same:]) > sequence_chars:
                    same = 0
                if not same:
                    sequence = 0
                    if filled >= shard_chars:
                        shard, filled = shard + 1, 0
                sequence += sum(sizes[same:])
                filled += sum(sizes[same:])
                for x, y in zip(out, (shard, n, same), strict=True):
                    x.append(y)
                n, before = n + 1, path
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["rep", "shard", "ord", "shared"])

    return paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, "rep long, shard long, ord long, shared long")


_SEGMENT = "seq_id string, segment long, node long, depth long, role string, formatted string, start long, stop long, position long, ancestors array<struct<start: long, stop: long>>, loss_start long, loss_stop long, ends_conversation boolean, tokens array<int>"


def _emit(turns: DataFrame, tokenizer_path: str | None) -> DataFrame:
    """Segments of the sequences; turns come by shard, conversation and turn, shared ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if tokenizer_path:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer_path)
            t.encode_special_tokens = True
            encode = lambda text: t.encode(text, add_special_tokens=False).ids
        shard, tree, segment, at = None, -1, 0, 0
        stack: list[tuple[int, int, int]] = []  # (start, stop, position after) of the path
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, tree, stack = r["shard"], -1, []
                del stack[r["idx"] :]
                if not stack:
                    tree, segment, at = tree + 1, 0, 0
                text, a, b = format_turn(r["role"], r["text"])
                tokens = encode(text) if encode else None
                size = len(text) if tokens is None else len(tokens)
                position = stack[-1][2] if stack else 0
                merged: list[dict] = []
                for x, y, _ in stack:
                    if merged and merged[-1]["stop"] == x:
                        merged[-1]["stop"] = y
                    else:
                        merged.append({"start": x, "stop": y})
                learnt = r["role"] == LEARNT
                out.append({
                    "seq_id": f"{shard}-{tree}", "segment": segment, "node": r["node"], "depth": len(stack), "role": r["role"], "formatted": text, "start": at, "stop": at + size,
                    "position": position, "ancestors": merged, "loss_start": a if learnt else None, "loss_stop": b if learnt else None, "ends_conversation": r["path"] is not None, "tokens": tokens,
                })
                stack.append((at, at + size, position + size))
                segment, at = segment + 1, at + size
            yield pa.RecordBatch.from_pylist(out, schema=_segment_schema())

    keys = ["shard", "ord", "idx"]
    return turns.repartition("shard").sortWithinPartitions(*keys).mapInArrow(run, _SEGMENT)


def _segment_schema() -> pa.Schema:
    interval = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    long = ["segment", "node", "depth", "start", "stop", "position", "loss_start", "loss_stop"]
    kinds = {"seq_id": pa.string(), "role": pa.string(), "formatted": pa.string(), "ancestors": pa.list_(interval), "ends_conversation": pa.bool_(), "tokens": pa.list_(pa.int32())} | dict.fromkeys(long, pa.int64())
    return pa.schema([(n.split()[0], kinds[n.split()[0]]) for n in re.split(r", (?![^<]*>)", _SEGMENT)])


def format_conversations(conversations: DataFrame, tokenizer_path: str | None = None, sequence_chars: int = SEQUENCE_CHARS, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(segments, members)`` of ``conversations(conv_id, turn, role, text)``.

    segments: one row for each turn of the trees, in the columns of ``_SEGMENT``; loss_start and loss_stop are
    code points of the formatted turn.  members: ``(conv_id, node)``, the segment that ends each conversation.
    A sequence has at most sequence_chars characters, or is one conversation; a tree that has more is several sequences, each
    with the turns that lead to its first conversation.  Turns go by turn, nulls first, ties by role and text; null roles and texts are empty.  Rows
    with a null conv_id are one conversation.  An empty table gives empty results.
    """
    ws = Workspace(conversations.sparkSession, "chat")
    turns = ws.table(_turns(conversations), "turns")
    last = turns.where("path is not null")
    members = ws.table(last.select("conv_id", "node", "path", "sizes"), "members")
    # equal paths have equal last nodes; the least conversation stands for all
    distinct = members.groupBy("path").agg(F.min(F.struct(F.col("conv_id").isNull().alias("n"), "conv_id", "sizes")).alias("r"))
    ranked = ws.table(_ranked(distinct.select(F.col("r.conv_id").alias("rep"), "path", "r.sizes"), sequence_chars, shard_chars), "ranked")
    new = turns.join(ranked, turns.conv_id.eqNullSafe(ranked.rep)).where("idx >= shared").select("shard", "ord", "idx", "role", "text", "node", "path")
    segments = ws.table(_emit(new, tokenizer_path), "segments")
    return segments, members.select("conv_id", "node")


def read_back(segments: DataFrame) -> DataFrame:
    """Conversations read from the segments: ``(node, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, one for each that ends."""
    kinds = pa.schema([("node", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, stack = None, []
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                if r["seq_id"] != seq:
                    seq, stack = r["seq_id"], []
                # the depth is that of the tree; the path so far holds the ancestors' states
                del stack[r["depth"] :]
                turns, loss, chars, size = stack[-1] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                role, text = parse_turn(r["formatted"])
                turns, loss = turns.copy(), loss.copy()
                turns.update(f"{role}\n{text}\n".encode())
                if r["loss_start"] is not None:
                    learnt = unescape(r["formatted"][r["loss_start"] : r["loss_stop"]])
                    loss.update(learnt.encode())
                    chars += len(learnt)
                size += len(r["formatted"])
                stack.append((turns, loss, chars, size))
                if r["ends_conversation"]:
                    out.append({"node": r["node"], "n_turns": len(stack), "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    source = segments.select("seq_id", "segment", "node", "depth", "formatted", "loss_start", "loss_stop", "ends_conversation")
    return source.repartition("seq_id").sortWithinPartitions("seq_id", "segment").mapInArrow(run, "node long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digest(conversations: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    """What ``read_back`` finds, for every conversation."""
    segments, members = format_conversations(conversations, tokenizer_path, **options)
    back = Workspace(conversations.sparkSession, "chat-back").table(read_back(segments), "back")
    return members.join(back, "node").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
