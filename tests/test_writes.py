"""Bulk writes, ids and the laws that tie them to the table."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from arcloom.operators import ids, writes
from arcloom.schema import LINK


@pytest.mark.parametrize("small", [None, True, False])
def test_bulk_update(spark, edge_links, small):
    updates = spark.createDataFrame(
        [(3, 7, 8), (7, 1, 1), (9, None, 5)], "id bigint, source bigint, target bigint"
    )
    after = dict((r[0], r[1:]) for r in rows(writes.bulk_update(edge_links, updates, small)))
    assert after[3] == (7, 8) and after[9] == (0, 5) and 7 not in after
    assert after[4] == (1, 2) and len(after) == 7
    assert rows(writes.update_feed(edge_links, updates, small)) == [
        (3, "update", 1, 2, 7, 8),
        (9, "update", 9, 9, 0, 5),
    ]
    assert rows(writes.update_rejects(edge_links, updates, small)) == [(7, "update", "not_exists")]


@pytest.mark.parametrize("small", [None, True, False])
def test_bulk_delete(spark, edge_links, small):
    asked = spark.createDataFrame([(3,), (3,), (8,), (8,), (1,)], "id bigint")
    assert [r[0] for r in rows(writes.bulk_delete(edge_links, asked, small))] == [2, 4, 5, 6, 9]
    assert rows(writes.delete_feed(edge_links, asked, small)) == [
        (1, "delete", 1, 1, 0, 0),
        (3, "delete", 1, 2, 0, 0),
    ]
    assert rows(writes.delete_rejects(edge_links, asked, small)) == [(8, "delete", "not_exists")]


def test_create_then_delete_gives_the_table_back(spark, edge_links):
    new = spark.range(10, 20)
    grown = edge_links.unionByName(writes.create_points(new))
    assert grown.count() == 17
    assert rows(writes.bulk_delete(grown, new)) == rows(edge_links)


def test_creates(spark):
    new = spark.createDataFrame([(5,)], "id bigint")
    assert rows(writes.create_empty(new)) == [(5, 0, 0)]
    assert rows(writes.create_points(new)) == [(5, 5, 5)]
    assert rows(writes.create_feed(writes.create_empty(new), empty=True)) == [
        (5, "create_empty", 0, 0, 0, 0)
    ]
    assert rows(writes.create_feed(writes.create_points(new))) == [(5, "create", 0, 0, 5, 5)]


def test_last_update_of_an_id_wins(spark):
    log = spark.createDataFrame(
        [(1, 5, 1, 1), (3, 5, 3, 3), (2, 5, 2, 2), (4, 6, 4, 4)],
        "seq bigint, id bigint, source bigint, target bigint",
    )
    assert rows(writes.last_update(log)) == [(5, 3, 3), (6, 4, 4)]


def test_duplicates_and_taken(spark, edge_links):
    twice = edge_links.unionByName(spark.createDataFrame([(3, 0, 0)], LINK))
    assert rows(writes.duplicate_ids(twice)) == [(3, 2)]
    assert writes.duplicate_ids(edge_links).count() == 0
    asked = spark.createDataFrame([(3,), (7,)], "id bigint")
    for small in (True, False):
        assert rows(writes.fresh_and_taken(edge_links, asked, small)) == [(3, True), (7, False)]


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_ids_are_dense_and_ordered(spark, partitions):
    """A hot leading value is cut over partitions and still numbered in order."""
    pairs = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("bigint").alias("source"),
        F.col("id").alias("target"),
    )
    got = ids.allocate_ids(pairs.repartition(6), ["source", "target"], 101, partitions)
    expected = sorted(tuple(r) for r in pairs.collect())
    assert [r[1:] for r in rows(got)] == expected
    assert [r[0] for r in rows(got)] == list(range(101, 2101))
    assert rows(got) == rows(got)


def test_allocate_for_nothing(spark):
    none = spark.createDataFrame([], "source bigint, target bigint")
    assert ids.allocate_ids(none, ["source", "target"]).count() == 0


def test_free_ids(spark, edge_links):
    assert rows(ids.free_ids(edge_links)) == [(7,), (8,)]
    assert rows(ids.free_ids(edge_links, next_id=12)) == [(7,), (8,), (10,), (11,)]
    assert ids.free_ids(spark.createDataFrame([], LINK)).count() == 0
