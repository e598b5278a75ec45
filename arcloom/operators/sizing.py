"""One place that decides whether a table may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of at most seven fixed-width columns: below 64 MB as a hash table.
BROADCAST_ROWS = 250_000


def is_small(df: DataFrame, small: bool | None = None, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows.

    Counting costs one pass over ``df`` (the request side, never the link table).
    A caller who already knows the answer passes it as ``small``.
    """
    return df.count() <= rows if small is None else small


def sized(df: DataFrame, small: bool) -> DataFrame:
    """``df`` with a broadcast hint when it was found small, as it is otherwise."""
    return F.broadcast(df) if small else df
