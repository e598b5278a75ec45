"""Patterns over the three positions of a link."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.schema import LINK_COLUMNS, PATTERN_COLUMNS

ANY = None
Pattern = Sequence[int | None]


def normalise(pattern: Pattern) -> tuple[int | None, int | None, int | None]:
    """The three-position form of a pattern of length 0, 1 or 3."""
    pattern = tuple(pattern)
    if len(pattern) == 0:
        return ANY, ANY, ANY
    if len(pattern) == 1:
        return pattern[0], ANY, ANY
    if len(pattern) == 3:
        return pattern
    raise ValueError(f"a pattern has 0, 1 or 3 positions, not {len(pattern)}")


def predicate(pattern: Pattern) -> Column | None:
    """The conjunction a pattern stands for; ``None`` when every position is ANY.

    Only bound positions give a term, so each reaches the scan as a pushed filter.
    """
    terms = [
        F.col(name) == F.lit(value)
        for name, value in zip(LINK_COLUMNS, normalise(pattern))
        if value is not None
    ]
    return reduce(and_, terms) if terms else None


def from_arrays(df: DataFrame, pid: str = "pid", pattern: str = "pattern") -> DataFrame:
    """Pattern rows from ``array<bigint>`` values, with an ``ok`` flag for the length.

    Arrays of another length (or NULL) keep their ``pid`` and come out with
    ``ok = false``, for the caller to route to a reject table.
    """
    length = F.size(F.coalesce(F.col(pattern), F.array(F.lit(0), F.lit(0)).cast("array<bigint>")))
    return df.select(
        F.col(pid).alias("pid"),
        *[
            F.get(F.col(pattern), F.lit(i)).cast("bigint").alias(name)
            for i, name in enumerate(PATTERN_COLUMNS)
        ],
        length.isin(0, 1, 3).alias("ok"),
    )
