"""A space-filling order of two bigint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (shift, mask): each step halves the runs of bits that still stand together.
_SPREAD = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)
_LOW = 0xFFFFFFFF
_SIGN = -(2**63)


def morton(x: Column, y: Column) -> tuple[Column, Column]:
    """The bits of two bigints interleaved, ``x`` first, as two bigints that order like the 128 bits.

    All 64 bits of both take part and the sign bit counts as the highest, so the order
    is defined for every value and needs no bounds of the data.
    """
    x, y = x.bitwiseXOR(F.lit(_SIGN)), y.bitwiseXOR(F.lit(_SIGN))
    return (
        _woven(F.shiftrightunsigned(x, 32), F.shiftrightunsigned(y, 32)),
        _woven(x.bitwiseAND(F.lit(_LOW)), y.bitwiseAND(F.lit(_LOW))),
    )


def _woven(x: Column, y: Column) -> Column:
    """The low 32 bits of both, interleaved; the sign is turned so that bigints order as unsigned."""
    return F.shiftleft(_spread(x), 1).bitwiseOR(_spread(y)).bitwiseXOR(F.lit(_SIGN))


def _spread(x: Column) -> Column:
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x
