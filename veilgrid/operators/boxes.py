"""Joins of boxes inside a page by grids: a box meets those near it, not all of its page.

The cells of a grid are as large as the boxes that it is for, to a power of two in each direction, so a box lies in few cells and a
page of any number of boxes is dealt over many keys. Both joins find each pair once: one side has a single cell of a grid.
Boxes are structs ``(x, y, width, height)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.names import own_prefix
from veilgrid.functions.text import contains_box, iou


def _level(size: Column) -> Column:
    """Exponent of the least power of two that is not below a size; 0 for sizes up to 1."""
    return F.ceil(F.log2(F.greatest(size, F.lit(1.0)))).cast("int")


def _cell(place: Column, level: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), level)).cast("long")


def _covered(df: DataFrame, box: Column, own: str) -> DataFrame:
    """A row for each cell that a box lies in, of the grid of the columns kw and kh."""
    for at, size, axis in (("x", "width", "w"), ("y", "height", "h")):
        level = F.col(f"{own}k{axis}")
        df = df.withColumn(f"{own}c{axis}", F.explode(F.sequence(_cell(box[at], level), _cell(box[at] + box[size], level))))
    return df


def _grid(own: str) -> list[str]:
    return [f"{own}{c}" for c in ("kw", "kh", "cw", "ch")]


def overlapping(a: DataFrame, b: DataFrame, keys: tuple[str, ...], a_box: str, b_box: str) -> DataFrame:
    """Pairs of rows of a page whose boxes share over half of what they cover together; all columns of both.

    Boxes without width or height, null ones among them, overlap nothing. The frames share the names of the keys only.
    """
    return near_pairs(a, b, keys, a_box, b_box).where(iou(F.col(a_box), F.col(b_box)) > 0.5)


def near_pairs(a: DataFrame, b: DataFrame, keys: tuple[str, ...], a_box: str, b_box: str) -> DataFrame:
    """The pairs that ``overlapping`` compares.

    Boxes that share over half differ in width and in height by less than a factor of two, and the middle of either lies inside
    the other. So ``b`` stands in the cell of its middle, in the grids of all sizes that a partner can have, and ``a`` in the
    cells that it covers of the grid of its size.
    """
    own = own_prefix(a, b)
    grid = _grid(own)
    sized = lambda df, box: df.where((F.col(box)["width"] > 0) & (F.col(box)["height"] > 0))
    p, q = F.col(a_box), F.col(b_box)
    left = sized(a, a_box).withColumns({grid[0]: _level(p["width"]), grid[1]: _level(p["height"])})
    right = sized(b, b_box)
    for axis, size in zip(grid[:2], ("width", "height"), strict=True):
        right = right.withColumn(axis, F.explode(F.sequence(_level(q[size] / 2), _level(q[size] * 2))))
    right = right.withColumns({grid[2]: _cell(q["x"] + q["width"] / 2, F.col(grid[0])), grid[3]: _cell(q["y"] + q["height"] / 2, F.col(grid[1]))})
    return _covered(left, p, own).join(right, [*keys, *grid]).drop(*grid)


def containing(inner: DataFrame, outer: DataFrame, keys: tuple[str, ...], inner_box: str, outer_box: str) -> DataFrame:
    """Pairs of rows of a page where the second box holds the first; all columns of both.

    Points and lines are boxes too; null boxes and those of a negative size hold nothing and are held by none. The frames
    share the names of the keys only.
    """
    return around_pairs(inner, outer, keys, inner_box, outer_box).where(contains_box(F.col(outer_box), F.col(inner_box)))


def around_pairs(inner: DataFrame, outer: DataFrame, keys: tuple[str, ...], inner_box: str, outer_box: str) -> DataFrame:
    """The pairs that ``containing`` compares.

    ``outer`` stands in the cells that it covers of the grid of its size, ``inner`` in the cell of its corner, in each grid that
    its page has.
    """
    own = own_prefix(inner, outer)
    grid, p, q = _grid(own), F.col(inner_box), F.col(outer_box)
    real = lambda df, box: df.where((F.col(box)["width"] >= 0) & (F.col(box)["height"] >= 0) & F.col(box)["x"].isNotNull() & F.col(box)["y"].isNotNull())
    right = real(outer, outer_box).withColumns({grid[0]: _level(q["width"]), grid[1]: _level(q["height"])})
    grids = right.select(*keys, *grid[:2]).distinct()
    left = real(inner, inner_box).join(grids, list(keys)).where((F.col(grid[0]) >= _level(p["width"])) & (F.col(grid[1]) >= _level(p["height"])))
    left = left.withColumns({grid[2]: _cell(p["x"], F.col(grid[0])), grid[3]: _cell(p["y"], F.col(grid[1]))})
    return left.join(_covered(right, q, own), [*keys, *grid]).drop(*grid)
