"""Places of values in a text, and texts rebuilt once around them.

One after another, longest or first first, each value takes its places from left to right where no earlier value took any. An
automaton reads the text once for all values; what is taken is marked letter by letter, so the work follows the
text's length and the number of places, not their product.
"""

from __future__ import annotations

from veilgrid.operators.values import automaton


def taken(text: str, values: list[str]) -> list[tuple[int, int, int]]:
    """``(start, end, number of the value)`` by start, from 0, end exclusive; values go in order, empty ones take nothing."""
    order: dict[str, int] = {}
    for k, v in enumerate(values):
        if v:
            order.setdefault(v, k)
    if not order or not text:
        return []
    if len(order) > 4:
        places: dict[int, list[int]] = {}
        for end, v in automaton(list(order)).iter(text):
            places.setdefault(order[v], []).append(end + 1 - len(v))
    else:
        places = {k: list(_places(text, v)) for v, k in order.items()}
    free, out = bytearray(len(text)), []
    for k in sorted(places):
        n = len(values[k])
        for at in places[k]:  # ascending: the ends of one value's places are
            if free.find(1, at, at + n) < 0:
                free[at : at + n] = b"\x01" * n
                out.append((at, at + n, k))
    return sorted(out)


def _places(text: str, value: str):
    at = text.find(value)
    while at >= 0:
        yield at
        at = text.find(value, at + 1)


def rebuilt(text: str, values: list[str], by: list[str]) -> str:
    """The text with each value's places replaced, as if the values were replaced one after the other.

    A value with a bracket, or inside a replacement, could meet text that isn't from the original; then they are replaced just so.
    """
    if any("[" in v or "]" in v or any(v in b for b in set(by)) for v in values if v):
        for v, b in zip(values, by, strict=True):
            text = text.replace(v, b) if v else text
        return text
    parts, at = [], 0
    for a, z, k in taken(text, values):
        parts += [text[at:a], by[k]]
        at = z
    return "".join([*parts, text[at:]])
