"""What the plans must look like for the jobs to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from arcloom.operators import commands as cmd
from arcloom.operators import counts, reads, writes
from arcloom.plans import datasets as data
from arcloom.plans import report
from arcloom.session import scratch_path
from arcloom.sources import benchlog, documents
from arcloom.sources.snapshots import LinkStore

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    store = LinkStore(spark, scratch_path(spark, "plans"))
    store.publish(data.links(spark, SF_DIR))
    return store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "pattern, pushed, copy",
    [
        ([5], ["EqualTo(id,5)"], "by_id"),
        ([None, 5, None], ["EqualTo(source,5)"], "by_source"),
        ([None, None, 5], ["EqualTo(target,5)"], "by_target"),
        ([None, 5, 6], ["EqualTo(source,5)", "EqualTo(target,6)"], "by_source"),
    ],
)
def test_bound_positions_reach_the_scan(store, pattern, pushed, copy):
    df = store.each(pattern)
    text = plan(df)
    filters = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert all(p in filters for p in pushed)
    assert all(f"/{copy}/" in file for file in df.inputFiles())
    assert "Exchange" not in text


def test_counts_read_only_what_they_need(store):
    assert "ReadSchema: struct<>" in plan(counts.count_links(store.read()))
    assert "ReadSchema: struct<target:bigint>" in plan(counts.in_degree(store.read()))


def test_many_patterns_never_use_a_nested_loop(spark, store):
    patterns = data.patterns(spark, SF_DIR)
    for small in (True, False):
        for df in (
            reads.match_patterns(store.read(), patterns, small=small),
            counts.count_patterns(store.read(), patterns, small=small),
        ):
            text = plan(df)
            assert "NestedLoop" not in text and "Cartesian" not in text


def test_few_patterns_leave_the_links_unshuffled(spark, store):
    patterns = spark.createDataFrame([(1, None, 5, None)], "pid bigint, p_id bigint, p_source bigint, p_target bigint")
    text = plan(reads.match_patterns(store.read(), patterns, small=True))
    assert "hashpartitioning" not in text and text.count("FileScan") == 1


def test_fold_reads_the_log_it_laid_out_once_and_cuts_windows_by_piece(spark):
    """One scan of the laid-out log and one of its pieces; no window over a whole id's commands."""
    text = plan(cmd.outcomes(data.commands(spark, SF_DIR)))
    assert text.count("FileScan") == 2
    specs = set(re.findall(r"windowspecdefinition\((.*?) ASC", text))
    shapes = {re.sub(r"#\d+L?", "", spec) for spec in specs}
    assert shapes == {"id, part, seq", "id, part"}


def test_latest_links_combine_map_side(spark):
    text = plan(cmd.latest_links(cmd.outcomes(data.commands(spark, SF_DIR))))
    assert "SortAggregate" not in text and "partial_max_by" in text


def test_many_patterns_are_shuffled(spark, store):
    patterns = spark.createDataFrame([(1, None, 5, None), (2, 3, None, None)], "pid bigint, p_id bigint, p_source bigint, p_target bigint")
    for ask in (reads.match_patterns, counts.count_patterns):
        df = ask(store.read(), patterns, small=False)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_small_plans(spark):
    """The last figures are kept in a hash aggregate; a document is parsed once."""
    lines = data.bench_lines(spark, SF_DIR)
    assert "SortAggregate" not in plan(report.last_figures(benchlog.parse_lines(lines)))
    parsed = documents.parse_documents(data.documents(spark, SF_DIR))
    for read in (documents.document_rejects, documents.document_numbers):
        assert read(parsed)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_bulk_writes_with_few_requests_do_not_shuffle_the_links(spark, store):
    few = spark.createDataFrame([(1, 2, 3)], "id bigint, source bigint, target bigint")
    for df in (
        writes.bulk_update(store.read(), few, small=True),
        writes.bulk_delete(store.read(), few, small=True),
    ):
        assert "hashpartitioning" not in plan(df)


def test_clustered_copy_skips_rows(spark):
    """One source is read from a small part of its clustered copy."""
    links = spark.range(1, 400_001).select(
        "id", (F.col("id") % 1000).alias("source"), (F.col("id") % 77).alias("target")
    )
    store = LinkStore(spark, scratch_path(spark, "plans"))
    store.publish(links, copies=("by_source",), partitions=16)

    def scanned(df):
        df.collect()
        node = df._jdf.queryExecution().executedPlan()
        while not node.nodeName().startswith("Scan"):
            node = node.children().apply(0) if node.children().size() else node.executedPlan()
        return node.metrics().apply("numOutputRows").value()

    plain = scanned(reads.each(store.read(), [None, 7, None]))
    clustered = scanned(store.each([None, 7, None]))
    assert plain == 400_000 and clustered <= 400_000 / 10


def test_a_hub_is_cut_over_files(spark):
    """The copy by source spreads a third of all links over several files."""
    links = spark.range(1, 90_001).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("source"),
        (F.col("id") % 50).alias("target"),
    )
    store = LinkStore(spark, scratch_path(spark, "plans"))
    store.publish(links, copies=("by_source",), partitions=12)
    files = (
        store.read(copy="by_source")
        .where("source = 1")
        .groupBy(F.input_file_name().alias("file"))
        .count()
        .collect()
    )
    assert len(files) >= 4 and max(r["count"] for r in files) < 12_000
