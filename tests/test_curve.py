"""The order along the curve, and the copy that is laid out by it."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from arcloom.functions.curve import morton
from arcloom.operators.reads import each
from arcloom.session import scratch_path
from arcloom.sources import linkformat
from arcloom.sources.snapshots import LinkStore, choose_copy

SIDE = 256
FILES = 64


def woven(x, y):
    """Bits of two 64-bit numbers in turn, the sign bit as the highest."""
    x, y = x + 2**63, y + 2**63
    return sum((x >> b & 1) << (2 * b + 1) | (y >> b & 1) << (2 * b) for b in range(64))


def test_order_is_that_of_the_woven_bits(spark):
    draw = random.Random(3)
    ends = [0, 1, -1, 2**31, 2**32 - 1, 2**32, 2**63 - 1, -(2**63)]
    pairs = [(x, y) for x in ends for y in ends]
    pairs += [(draw.randrange(-(2**63), 2**63), draw.randrange(-(2**63), 2**63)) for _ in range(200)]
    table = spark.createDataFrame(pairs, "x bigint, y bigint")
    found = table.select("x", "y", *[k.alias(n) for k, n in zip(morton(F.col("x"), F.col("y")), "hl")]).collect()
    by_key = sorted(found, key=lambda r: (r.h, r.l))
    assert [(r.x, r.y) for r in by_key] == sorted(pairs, key=lambda p: woven(*p))
    for r in found:
        assert ((r.h + 2**63) << 64) + r.l + 2**63 == woven(r.x, r.y)


@pytest.fixture(scope="module")
def grid(spark):
    """Every pair of 256 sources and targets once, in 64 files."""
    store = LinkStore(spark, scratch_path(spark, "test-curve"))
    links = spark.range(SIDE * SIDE).select(
        (F.col("id") + 1).alias("id"), (F.col("id") % SIDE).alias("source"), F.floor(F.col("id") / SIDE).alias("target")
    )
    store.publish(links, copies=("by_curve",), partitions=FILES)
    return store


def test_copy_holds_the_table(spark, grid):
    assert grid.version().copies == ("by_id", "by_curve")
    table = grid.read()
    assert rows(grid.read(copy="by_curve")) == rows(table)
    for pattern in ([], [77], [None, 7, None], [None, None, 4], [None, 7, 4], [None, 999, None]):
        assert rows(grid.each(pattern)) == rows(each(table, pattern)), pattern


def test_either_endpoint_meets_about_the_root_of_the_files(spark, grid):
    bounds = grid.index_files().where("copy = 'by_curve'").collect()
    assert len(bounds) == FILES

    def met(**bound):
        return sum(all(b[f"{c}_min"] <= v <= b[f"{c}_max"] for c, v in bound.items()) for b in bounds)

    for value in (0, 7, 100, 255):
        # Bounds come from a sample, so files are not quite square.
        assert met(source=value) <= 3 * FILES**0.5 and met(target=value) <= 3 * FILES**0.5
        assert met(source=value, target=255 - value) <= 3


def test_hub_is_cut_over_files(spark):
    store = LinkStore(spark, scratch_path(spark, "test-curve"))
    hub = spark.range(1, 8001).select("id", F.lit(5).cast("bigint").alias("source"), (F.col("id") % 3).alias("target"))
    store.publish(hub, copies=("by_curve",), partitions=8)
    bounds = store.index_files().where("copy = 'by_curve'").collect()
    assert len(bounds) > 4 and max(b.n for b in bounds) < 3000
    assert store.each([None, 5, 1]).count() == 2667


def test_the_copy_is_chosen_where_no_better_one_is():
    curve = ("by_id", "by_curve")
    assert choose_copy([None, 7, None], curve) == choose_copy([None, None, 7], curve) == "by_curve"
    assert choose_copy([None, 7, 7], curve) == "by_curve"
    assert choose_copy([7, 7, None], curve) == choose_copy([], curve) == "by_id"
    assert choose_copy([None, 7, None], ("by_id", "by_source", "by_curve")) == "by_source"
    assert choose_copy([None, None, 7], ("by_id", "by_source", "by_curve")) == "by_curve"
    assert choose_copy([None, 7, 8], ("by_id", "by_target")) == "by_target"


def test_format_reads_it(spark, grid):
    linkformat.register(spark)
    for pattern in ([None, 7, None], [None, None, 4], [None, 7, 4]):
        found = linkformat.each(spark, grid.root, pattern)
        assert rows(found) == rows(grid.each(pattern))
        assert found.rdd.getNumPartitions() <= 3 * FILES**0.5
