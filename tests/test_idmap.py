"""Bitmaps of ids against sets of ids, and free ranges against those from the ids themselves."""

import pytest
from helpers import rows

from arcloom.operators import commands as cmd
from arcloom.operators import idmap
from arcloom.operators.ids import free_ranges
from arcloom.plans import datasets as data

SF = "/root/testdata/sf0.001"


def table(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def ids_of(held):
    """The ids of a map, read bit by bit."""
    found = set()
    for bucket, words in held.select("bucket", "words").collect():
        assert len(words) == idmap.WORDS
        for i, word in enumerate(words):
            found |= {(bucket - 1) * idmap.BUCKET_IDS + 64 * i + b + 1 for b in range(64) if word >> b & 1}
    return found


def gaps(ids, next_id=None):
    known = sorted(i for i in ids if next_id is None or i < next_id) + ([] if next_id is None else [next_id])
    return [(a + 1, b - 1) for a, b in zip([0, *known], known) if b - a > 1]


CASES = {
    "none": [],
    "one": [1],
    "word": list(range(1, 65)),
    "word edges": [1, 63, 64, 65, 66, 128, 130],
    "bucket edges": [32_767, 32_768, 32_769, 65_536, 65_538],
    "whole bucket": list(range(32_769, 65_537)),
    "far apart": [5, 6, 7, 40_000_000_000, 40_000_000_002, 2**62],
    "every second": list(range(2, 70_000, 2)),
}


@pytest.mark.parametrize("case", CASES)
def test_maps_and_free_ranges(spark, case):
    ids = table(spark, CASES[case])
    held = idmap.id_map(ids)
    assert ids_of(held) == set(CASES[case])
    assert idmap.count_ids(held).first().n == len(CASES[case])
    assert rows(idmap.free_map_ranges(held)) == gaps(CASES[case])
    assert rows(idmap.free_map_ranges(held, 66)) == gaps(CASES[case], 66)


@pytest.mark.parametrize("next_id", [1, 40_000, 100_000])
def test_ranges_below_the_counter(spark, next_id):
    for case in ("none", "bucket edges"):
        ids = table(spark, CASES[case])
        found = rows(idmap.free_map_ranges(idmap.id_map(ids), next_id))
        assert found == gaps(CASES[case], next_id) == rows(free_ranges(ids, next_id))


def test_odd_ids_are_not_mapped(spark):
    held = idmap.id_map(table(spark, [None, 0, -1, -(2**63), 3, 3, 3]))
    assert ids_of(held) == {3}


def test_maps_are_merged_and_thinned(spark):
    a, b = {1, 64, 65, 32_768, 32_769, 99_999}, {1, 2, 65, 70_000, 99_999}
    held, other = idmap.id_map(table(spark, a)), idmap.id_map(table(spark, b))
    assert ids_of(idmap.with_ids(held, other)) == a | b
    left = idmap.without_ids(held, other)
    assert ids_of(left) == a - b
    # A bucket left empty has no row.
    assert sorted(r.bucket for r in left.collect()) == [1, 2]
    assert idmap.without_ids(held, held).count() == 0


def test_kept_up_from_a_change_feed(spark):
    links, log = data.links(spark, SF), data.commands(spark, SF)
    feed = cmd.change_feed(cmd.outcomes(log, base=links))
    after = idmap.changed_map(idmap.id_map(links), feed)
    assert ids_of(after) == {r.id for r in cmd.current_links(log, links).select("id").collect()}


def test_links_are_not_put_in_order(spark):
    """Only two ids a bucket are range-partitioned, and a task sends one row a bucket."""
    held = idmap.id_map(spark.range(1, 200_001, 1, 16).where("id % 3 > 0"))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "partial_bitmap_construct_agg" in plan
