"""Names for inner columns that no caller's column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with."""
    own = "__"
    while any(c.lower().startswith(own) for df in frames for c in df.columns):
        own += "_"
    return own
