"""Versions: isolation, the id counter, and copies that equal the table."""

import pytest
from helpers import rows

from arcloom.operators import commands as cmd
from arcloom.schema import COMMAND
from arcloom.session import scratch_path
from arcloom.sources.snapshots import COPIES, LinkStore, choose_copy


@pytest.fixture
def store(spark):
    return LinkStore(spark, scratch_path(spark, "test-store"))


def test_versions_are_isolated(spark, store, edge_links):
    assert store.version() is None and store.versions().count() == 0
    with pytest.raises(LookupError):
        store.read()
    first = store.publish(edge_links)
    assert (first.version, first.n_links, first.next_id) == (1, 7, 10)
    log = spark.createDataFrame(
        [(1, "delete", 9, None, None), (2, "update", 5, 2, 2), (3, "create", 7, None, None)], COMMAND
    )
    second = store.apply(log)
    # Deleting the highest id does not give it out again.
    assert (second.version, second.n_links, second.next_id) == (2, 7, 10)
    assert rows(store.read(1)) == rows(edge_links)
    assert rows(store.read()) == rows(cmd.current_links(log, edge_links))
    third = store.drop()
    assert (third.n_links, third.next_id) == (0, 1)
    assert store.read().count() == 0
    assert rows(store.read(2)) == rows(cmd.current_links(log, edge_links))
    assert store.version().version == 3


def test_copies_equal_the_table(store, edge_links):
    store.publish(edge_links)
    for copy in COPIES:
        assert rows(store.read(copy=copy)) == rows(edge_links)
    for pattern in ([3], [None, 1, None], [None, None, 2], [None, 1, 2], [], [3, 1, None]):
        kept = [l for l in rows(edge_links) if not pattern or all(p is None or p == v for p, v in zip(pattern, l))]
        assert rows(store.each(pattern)) == kept


def test_choice_of_copy():
    assert choose_copy([4]) == "by_id"
    assert choose_copy([4, 1, 2]) == "by_id"
    assert choose_copy([None, 1, 2]) == choose_copy([None, 1, None]) == "by_source"
    assert choose_copy([None, None, 2]) == "by_target"
    assert choose_copy([]) == "by_id"
    assert choose_copy([None, None, 2], ("by_id",)) == "by_id"


def test_a_write_without_its_row_is_not_a_version(spark, store, edge_links):
    store.publish(edge_links)
    edge_links.limit(2).write.parquet(f"{store.root}/v=2/by_id")
    assert store.version().version == 1
    assert store.publish(edge_links).version == 2
    assert rows(store.read(2)) == rows(edge_links)


def test_create_is_idempotent_and_added_links_continue_the_counter(spark, store):
    assert store.create() == store.create()
    assert store.version().n_links == 0
    pairs = spark.createDataFrame([(9, 1), (3, 4), (3, 2)], "source bigint, target bigint")
    assert store.add(pairs, copies=()).next_id == 4
    assert rows(store.read()) == [(1, 3, 2), (2, 3, 4), (3, 9, 1)]
    store.apply(spark.createDataFrame([(1, "delete", 3, None, None)], COMMAND), copies=())
    assert store.add(pairs.limit(1), copies=()).next_id == 5
    assert rows(store.read().select("id")) == [(1,), (2,), (4,)]


def test_a_deleted_id_is_not_given_again(spark):
    store = LinkStore(spark, scratch_path(spark, "test-counter"))
    store.create()
    log = [(1, "create", 1, None, None), (2, "create", 2, None, None), (3, "delete", 2, None, None)]
    assert store.apply(spark.createDataFrame(log, COMMAND)).next_id == 3
    store.add(spark.createDataFrame([(1, 1)], "source bigint, target bigint"))
    assert [r[0] for r in rows(store.read())] == [1, 3]


def test_counts_are_gathered_by_the_write(spark, store):
    """Many partitions, of which range bounds are drawn first, are counted once."""
    links = spark.range(1, 5001, numPartitions=9).selectExpr("id", "id % 7 as source", "id % 11 as target")
    version = store.publish(links, partitions=6)
    assert (version.n_links, version.next_id) == (5000, 5001)
    log = spark.createDataFrame([(1, "create", 9000, None, None), (2, "delete", 9000, None, None)], COMMAND)
    version = store.apply(log)
    assert (version.n_links, version.next_id) == (5000, 9001)


def test_an_empty_log_changes_nothing(spark, store, edge_links):
    store.publish(edge_links)
    version = store.apply(spark.createDataFrame([], COMMAND))
    assert (version.n_links, version.next_id) == (7, 10)
    assert rows(store.read()) == rows(edge_links)
