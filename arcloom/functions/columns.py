"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenths(value: Column) -> Column:
    """A non-negative double as text with one decimal, correctly rounded.

    ``format_string('%.1f')`` rounds the shortest decimal form half up, so 0.15
    gives 0.2 and 1.25 gives 1.3. This rounds the double itself, exact ties to
    even, as C and Python do. The midpoint above ``h/10`` is ``(2h+1)/20``;
    ``20*v > 2h+1`` is tested as ``4*v > (2h+1) - 16*v``, where both sides are
    exact in binary floating point.
    """
    h = F.floor(value * 10)
    lean = (2 * h + 1).cast("double") - 16 * value
    up = (4 * value > lean) | ((4 * value == lean) & (h % 2 == 1))
    n = h + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
