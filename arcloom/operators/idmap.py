"""Which ids are in use, as bitmaps that are kept up instead of recounted.

A map is ``(bucket, words)``: one row per 32,768 ids that holds one bit an id, as 512
bigints, lowest id in the lowest bit of the first. Buckets without an id have no row.
Maps are made with a partial aggregate, so a task sends one row a bucket, and merged
bucket by bucket; free ids are read off the words, and what is put in order over the
whole table is two ids a bucket. Only ids above 0 are mapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.operators.commands import stored
from arcloom.operators.ids import free_ranges
from arcloom.schema import DELETE, UPDATE

# Fixed by bitmap_construct_agg.
BUCKET_IDS = 32_768
WORDS = BUCKET_IDS // 64


def id_map(ids: DataFrame) -> DataFrame:
    """The map of the column ``id``; repeated ids count once, NULLs not at all."""
    return (
        ids.where("id > 0")
        .groupBy(F.bitmap_bucket_number("id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        .select("bucket", _words(F.col("bits")).alias("words"))
    )


def _words(bits: Column) -> Column:
    # Read backwards, with the two digits of a byte put right again, the map is one
    # number whose highest digits are the last word.
    digits = F.regexp_replace(F.reverse(F.hex(bits)), "(.)(.)", "$2$1")

    def word(d: Column, i: Column) -> Column:
        return F.conv(F.substring(d, F.lit(16) * (WORDS - 1 - i) + 1, F.lit(16)), 16, -10).cast("bigint")

    places = F.sequence(F.lit(0), F.lit(WORDS - 1))
    return F.get(F.transform(F.array(digits), lambda d: F.transform(places, lambda i: word(d, i))), F.lit(0))


def with_ids(held: DataFrame, more: DataFrame) -> DataFrame:
    """The ids of either map."""
    return _combined(held, more, lambda a, b: a.bitwiseOR(b))


def without_ids(held: DataFrame, gone: DataFrame) -> DataFrame:
    """The ids of ``held`` that ``gone`` does not hold."""
    return _combined(held, gone, lambda a, b: a.bitwiseAND(F.bitwise_not(b)))


def _combined(left: DataFrame, right: DataFrame, word) -> DataFrame:
    none = F.array_repeat(F.lit(0).cast("bigint"), WORDS)
    a, b = left.alias("a"), right.alias("b")
    words = F.zip_with(F.coalesce("a.words", none), F.coalesce("b.words", none), word)
    made = a.join(b, F.col("a.bucket") == F.col("b.bucket"), "full")
    made = made.select(F.coalesce("a.bucket", "b.bucket").alias("bucket"), words.alias("words"))
    return made.where(F.exists("words", lambda w: w != 0))


def changed_map(held: DataFrame, feed: DataFrame) -> DataFrame:
    """The map after a change feed; an id's last row decides whether it is in use.

    The work is that of the feed, and of the map's rows, not of the links.
    """
    last = (
        feed.where(F.col("op") != UPDATE).groupBy("id").agg(F.max_by("op", "seq").alias("op"))
    )
    gone = F.col("op") == DELETE
    return without_ids(with_ids(held, id_map(last.where(~gone))), id_map(last.where(gone)))


def count_ids(held: DataFrame) -> DataFrame:
    """``(n)``: how many ids are in use."""
    each = F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))
    return held.select(F.coalesce(F.sum(each), F.lit(0).cast("bigint")).alias("n"))


def free_map_ranges(held: DataFrame, next_id: int | None = None) -> DataFrame:
    """Runs ``(first, last)`` of ids not in use, below ``next_id`` or the highest id, as ``ids.free_ranges`` gives them."""
    # Read four times below, so it is stored, at two numbers a run.
    runs = stored(held.select("bucket", _edges(F.col("words")).alias("edge")), "id-runs")
    base = (F.col("bucket") - 1) * BUCKET_IDS + 1
    # Within a bucket, ids are free between the end of a used run and the start of the next.
    lows = F.slice("edge.ends", F.lit(1), F.size("edge.ends") - 1)
    highs = F.slice("edge.starts", F.lit(2), F.size("edge.starts"))
    pairs = F.explode(F.arrays_zip(lows.alias("low"), highs.alias("high")))
    inner = runs.where(F.size("edge.starts") > 1).select(base.alias("base"), pairs.alias("gap"))
    inner = inner.select((F.col("base") + F.col("gap.low") + 1).alias("first"), (F.col("base") + F.col("gap.high") - 1).alias("last"))
    lowest, highest = base + F.get("edge.starts", F.lit(0)), base + F.element_at("edge.ends", -1)
    ends = runs.select(F.explode(F.array(lowest, highest)).alias("id"))
    # Between the two ids of a bucket lies what `inner` has told already.
    between = free_ranges(ends).where(
        F.bitmap_bucket_number(F.col("first") - 1) != F.bitmap_bucket_number(F.col("last") + 1)
    )
    found = inner.unionByName(between)
    if next_id is None:
        return found
    top = ends.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rest = top.select((F.col("top") + 1).cast("bigint").alias("first"), F.lit(next_id - 1).cast("bigint").alias("last"))
    found = found.withColumn("last", F.least("last", F.lit(next_id - 1))).unionByName(rest)
    return found.where("first <= last")


def _edges(words: Column) -> Column:
    """``(starts, ends)``: the places in a bucket where runs of used ids start and end."""

    def places(w: Column, edge) -> Column:
        def inside(i: Column) -> Column:
            found = F.filter(
                F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(edge(w, i), b) == 1
            )
            placed = F.transform(found, lambda b: i * 64 + b)
            return F.when(edge(w, i) == 0, F.array().cast("array<int>")).otherwise(placed)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), inside))

    def start(w: Column, i: Column) -> Column:
        before = F.coalesce(F.get(w, i - 1), F.lit(0))
        return F.get(w, i).bitwiseAND(F.bitwise_not(F.shiftleft(F.get(w, i), 1).bitwiseOR(F.shiftrightunsigned(before, 63))))

    def end(w: Column, i: Column) -> Column:
        after = F.coalesce(F.get(w, i + 1), F.lit(0))
        return F.get(w, i).bitwiseAND(F.bitwise_not(F.shiftrightunsigned(F.get(w, i), 1).bitwiseOR(F.shiftleft(after, 63))))

    made = F.transform(
        F.array(words), lambda w: F.struct(places(w, start).alias("starts"), places(w, end).alias("ends"))
    )
    return F.get(made, F.lit(0))

