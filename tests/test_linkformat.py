"""The ``links`` format: the copy and the files a pattern leads to, and the same rows."""

import pytest
from helpers import rows

from arcloom.operators.reads import each
from arcloom.session import scratch_path
from arcloom.sources import linkformat
from arcloom.sources.linkformat import LinkReader
from arcloom.sources.snapshots import LinkStore


@pytest.fixture(scope="module")
def store(spark):
    store = LinkStore(spark, scratch_path(spark, "test-format"))
    links = spark.range(1, 2001).selectExpr("id", "id % 40 as source", "id % 31 as target")
    store.publish(links, partitions=8)
    store.index_files()
    linkformat.register(spark)
    return store


def test_rows_equal_those_of_the_table(spark, store):
    table = store.read()
    for pattern in ([], [77], [99999], [None, 7, None], [None, None, 4], [None, 7, 4], [47, 7, None], [47, 8, None]):
        assert rows(linkformat.each(spark, store.root, pattern)) == rows(each(table, pattern)), pattern


def test_queries_on_one_load_do_not_disturb_each_other(spark, store):
    links, table = linkformat.each(spark, store.root), store.read()
    assert rows(links.where("source = 7")) == rows(table.where("source = 7"))
    assert links.count() == 2000
    both = links.where("source = 7").unionAll(links.where("source = 8"))
    assert rows(both) == rows(table.where("source in (7, 8)"))


def test_files_are_pruned_and_nothing_is_left_to_spark(spark, store):
    every = store.index_files().where("copy = 'by_id'").count()
    assert linkformat.each(spark, store.root).rdd.getNumPartitions() == every > 1
    for pattern in ([77], [None, 7, None], [None, None, 4], [None, 7, 4]):
        found = linkformat.each(spark, store.root, pattern)
        assert found.rdd.getNumPartitions() == 1, pattern
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan and "Exchange" not in plan, plan


def test_the_copy_follows_the_pattern(store):
    for pattern, copy in (
        ({"source": 7}, "by_source"), ({"target": 7}, "by_target"), ({"source": 7, "target": 7}, "by_source"),
        ({"id": 7, "target": 7}, "by_id"), ({}, "by_id"),
    ):
        assert all(f"/{copy}/" in p.path for p in LinkReader(store.root, None, pattern).partitions())


def test_versions_and_empty_tables(spark, store, edge_links):
    other = LinkStore(spark, scratch_path(spark, "test-format"))
    other.publish(edge_links)
    other.index_files()
    other.drop()
    other.index_files()
    assert rows(linkformat.each(spark, other.root, version=1)) == rows(edge_links)
    assert linkformat.each(spark, other.root).count() == 0
    with pytest.raises(LookupError):
        LinkReader(other.root, 9, {}).partitions()
