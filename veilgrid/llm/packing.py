"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted; one of c words costs ``overhead + c + c * c / attention``: a
fixed part, the layers that see each word alone, and attention.  Pieces go by decreasing length into the open bin
that they fill best.  If none has room, a bin opens, and its length is chosen among all that hold the piece: for
each, the pieces that are left are laid into it largest first, and the length wins whose cost, after shrinking to
what it then holds, is least for each word.  At the end each bin shrinks to the least permitted length that holds
its contents.  The lengths are optimised together over the whole cell: the packing is made for every set of
opening lengths, single ones included, and the cheapest stays, so no single length is ever better.

Texts longer than the longest sequence are cut, in one pass, into pieces of that length and a rest.  A piece of
the longest length is a bin by itself.  The heuristic is sequential, so rests are dealt to cells of about 256 by
a hash of id and text; a cell is packed by one task, at most ``2 * cell`` pieces at a time, and cells are many
more than tasks.  What a task holds is bounded by ``2 * cell`` pieces of the longest length, whatever the texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilgrid.llm.workspace import slices

#: Permitted sequence lengths in words.
CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length.
OVERHEAD = 16
#: Words of a sequence for which attention costs as much as all else (12 times a model width of 4096).
ATTENTION = 49_152

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sequence_cost(capacity: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return overhead + capacity + capacity * capacity / attention


class _Left:
    """The lengths that are not yet placed, with their numbers."""

    def __init__(self, lengths: list[int]):
        self.count = Counter(lengths)
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.sizes[bisect_left(self.sizes, n)]

    def fill(self, room: int) -> int:
        """Words of the pieces that go into a bin of this room, largest first."""
        used, at = 0, bisect_right(self.sizes, room)
        while at:
            n = self.sizes[at - 1]
            k = min(self.count[n], (room - used) // n)
            used += k * n
            at = min(at - 1, bisect_right(self.sizes, room - used))
        return used


def pack_lengths(lengths: list[int], capacities: tuple[int, ...], cost: dict[int, float], opening: tuple[int, ...]) -> list[tuple[int, int, list[int]]]:
    """Best fit by decreasing length: ``(capacity, used, indices)`` of each bin.

    Bins open with the length of ``opening`` that costs least for each word that it can be filled with (a piece longer
    than all of them opens the least capacity that holds it).  Ties go to the earlier index, the earlier bin, the lesser length.
    """
    caps = sorted(capacities)
    fits = lambda used: caps[bisect_left(caps, used)]
    left = _Left(lengths)
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    free: list[int] = []
    opened: list[int] = []
    held: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        left.take(n)
        at = bisect_left(room, (n, -1))
        if at < len(room):
            _, b = room.pop(at)
        else:
            may = [c for c in opening if c >= n] or [fits(n)]
            used = {c: n + left.fill(c - n) for c in may} if len(may) > 1 else {}
            cap = min(may, key=lambda c: (cost[fits(used[c])] / used[c] if used else 0, c))
            b = len(free)
            free.append(cap)
            opened.append(cap)
            held.append([])
        free[b] -= n
        held[b].append(i)
        if free[b]:
            insort(room, (free[b], b))
    return [(fits(opened[b] - free[b]), opened[b] - free[b], items) for b, items in enumerate(held)]


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION) -> list[tuple[int, int, list[int]]]:
    """Packs positive lengths up to the largest capacity: ``(capacity, used, indices)`` of each bin, bins in the order of opening, indices in that of placing."""
    cost = {c: sequence_cost(c, overhead, attention) for c in capacities}
    sets = [x for k in range(len(capacities), 0, -1) for x in combinations(sorted(capacities), k)]
    every = [pack_lengths(lengths, capacities, cost, x) for x in sets]
    return min(every, key=lambda bins: sum(cost[c] for c, _, _ in bins))  # the first of equals


def cut_text(text: str | None, longest: int, with_text: bool = True) -> list[tuple[int, int, str | None]]:
    """``(first word, words, stretch)`` of the pieces of a text, white space inside them included; one of no words for a text without."""
    out: list[tuple[int, int, str | None]] = []
    text = text or ""
    n = start = end = 0
    for m in _WORD.finditer(text):
        if n % longest == 0:
            if n:
                out.append((n - longest, longest, text[start:end] if with_text else None))
            start = m.start()
        end = m.end()
        n += 1
    first = max(0, n - 1) // longest * longest
    out.append((first, n - first, text[start:end] if with_text else None))
    return out


_PIECES = "cell long, h long, id long, start long, length long, text string"
_BINS = "bin_id string, capacity long, used long, doc_ids array<long>, starts array<long>, lengths array<long>, text string"


def _pieces(docs: DataFrame, longest: int, cells: int, with_text: bool, seed: int) -> DataFrame:
    """The pieces of ``docs(id, text)`` with their cells; rows that repeat in a task are dealt to cells of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = xxh64_intdigest(repr(i).encode() + b"\0" + (t or "").encode(), seed)
                again = seen[h]
                seen[h] += 1
                for start, n, part in cut_text(t, longest, with_text):
                    spread = f"{h} {task if again else 0} {again} {start // longest if n == longest else 0}"
                    for x, y in zip(out, (xxh64_intdigest(spread, seed) % cells, h >> 1, i, start, n, part), strict=True):
                        x.append(y)
            yield pa.record_batch([pa.array(x, pa.string() if k == 5 else pa.int64()) for k, x in enumerate(out)], names=["cell", "h", "id", "start", "length", "text"])

    return docs.mapInArrow(run, _PIECES)


def _pack(pieces: DataFrame, capacities: tuple[int, ...], overhead: float, attention: float, cell: int, with_text: bool) -> DataFrame:
    longest, least = max(capacities), min(capacities)
    kinds = pa.schema([("bin_id", pa.string()), ("capacity", pa.int64()), ("used", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made, held, blank = None, 0, [], []

        def row(capacity: int, items: list[dict]) -> dict:
            nonlocal made
            made += 1
            text = "\n".join(r["text"] for r in items if r["length"]) if with_text else None
            return {"bin_id": f"{at}-{made - 1}", "capacity": capacity, "used": sum(r["length"] for r in items), "doc_ids": [r["id"] for r in items], "starts": [r["start"] for r in items], "lengths": [r["length"] for r in items], "text": text}

        def settle() -> list[dict]:
            """The bins of what is held; pieces of no words go to the first, or to one of their own."""
            out = [(c, [held[i] for i in items]) for c, _, items in best_fit([r["length"] for r in held], capacities, overhead, attention)]
            if blank:
                out = [(c, items + blank * (k == 0)) for k, (c, items) in enumerate(out)] or [(least, list(blank))]
            made = [row(c, items) for c, items in out]
            held.clear()
            blank.clear()
            return made

        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                if r["cell"] != at or len(held) + len(blank) >= 2 * cell:
                    out += settle()
                    if r["cell"] != at:
                        at, made = r["cell"], 0
                if r["length"] == longest:
                    out.append(row(longest, [r]))
                else:
                    (held if r["length"] else blank).append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if out := settle():
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return pieces.repartition("cell").sortWithinPartitions("cell", "h", "id", "start").mapInArrow(run, _BINS)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION,
    cell: int = 256, with_text: bool = True, seed: int = 5,
) -> DataFrame:
    """Sequences ``(bin_id, capacity, used, doc_ids, starts, lengths, text)``, one row for each.

    doc_ids, starts and lengths name the pieces in order: the document, its first word (from 0)
    and its number of words; used is their sum and never above capacity, which is the least
    permitted length that holds it.  text joins the pieces by a newline (null without
    ``with_text``, and then texts aren't shuffled).  Every word of every row is in one piece.
    Texts without words, nulls included, are pieces of 0 words in a bin of their cell.  Rows with
    a null id are packed like others, repeated rows each for itself; an empty table gives no rows.
    Columns of any other name aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cells = max(1, -(-docs.count() // cell))
    return _pack(_pieces(rows, max(capacities), cells, with_text, seed), capacities, overhead, attention, cell, with_text)
