"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions import patterns
from arcloom.operators import commands as cmd
from arcloom.operators import counts, idmap, ids, reads, writes
from arcloom.plans import datasets as data
from arcloom.plans import report
from arcloom.session import scratch_path
from arcloom.sources import benchlog, documents, linkformat
from arcloom.sources.ranges import RangedLinks
from arcloom.sources.snapshots import LinkStore
from arcloom.streaming import stateful
from arcloom.streaming.feed import stream_outcomes
from arcloom.streaming.sinks import FeedSink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# Single patterns


@query
def each_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.each(data.links(spark, sf_dir))


@query
def each_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.each(data.links(spark, sf_dir), [77])


@query
def each_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.each(data.links(spark, sf_dir), [None, 7, None])


@query
def each_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.each(data.links(spark, sf_dir), [None, None, 42])


@query
def each_concrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.each(data.links(spark, sf_dir), [None, 3, 17])


@query
def each_mixed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id with its endpoints, bound the ways no other single-pattern query has."""
    links = data.links(spark, sf_dir)
    nothing = F.lit(None).cast("bigint")
    masks = [("source", None), (None, "target"), ("source", "target"), ("source + 1", None), (None, None)]
    bound = [
        F.struct(
            F.lit(n).cast("bigint").alias("pid"),
            F.col("id").alias("p_id"),
            (F.expr(source) if source else nothing).alias("p_source"),
            (F.expr(target) if target else nothing).alias("p_target"),
        )
        for n, (source, target) in enumerate(masks)
    ]
    patterns = links.where("id = 77").select(F.inline(F.array(*bound)))
    return reads.match_patterns(links, patterns).withColumnRenamed("pid", "mask")


@query
def get_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.get_links(data.links(spark, sf_dir), data.requested_ids(spark, sf_dir))


@query
def each_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = (F.col("target") == 100) & (F.col("source") % 50 == 0)
    return reads.each_until(data.links(spark, sf_dir), stop)


# Many patterns, counts


@query
def match_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.match_patterns(data.links(spark, sf_dir), data.patterns(spark, sf_dir))


@query
def match_patterns_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer by the way that too many patterns for a broadcast take."""
    return reads.match_patterns(
        data.links(spark, sf_dir), data.patterns(spark, sf_dir), small=False
    )


@query
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_links(data.links(spark, sf_dir))


@query
def count_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_links(data.links(spark, sf_dir), [None, 7, None])


@query
def count_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_patterns(
        data.links(spark, sf_dir), data.patterns(spark, sf_dir, with_any=True)
    )


@query
def count_patterns_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_patterns(
        data.links(spark, sf_dir), data.patterns(spark, sf_dir, with_any=True), small=False
    )


@query
def max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.max_id(data.links(spark, sf_dir))


@query
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.out_degree(data.links(spark, sf_dir))


@query
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.in_degree(data.links(spark, sf_dir))


@query
def out_degree_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degrees after a command log, from those before and the log's change feed."""
    links = data.links(spark, sf_dir)
    feed = cmd.change_feed(cmd.outcomes(data.commands(spark, sf_dir), base=links))
    return counts.changed_degrees(counts.out_degree(links), counts.degree_changes(feed, "source"))


@query
def pattern_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that arrive as arrays of no to four positions, or as NULL; those of a wrong length are marked."""
    return patterns.from_arrays(data.pattern_arrays(spark, sf_dir))


@query
def pair_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pair_multiplicity(data.links(spark, sf_dir))


# Writes


@query
def create_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.create_empty(data.order_ids(spark, sf_dir))


@query
def create_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.create_points(data.order_ids(spark, sf_dir))


@query
def create_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.create_feed(writes.create_points(data.order_ids(spark, sf_dir)))


@query
def taken_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.fresh_and_taken(data.links(spark, sf_dir), data.order_ids(spark, sf_dir))


@query
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.bulk_update(data.links(spark, sf_dir), data.updates(spark, sf_dir))


@query
def update_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.update_feed(data.links(spark, sf_dir), data.updates(spark, sf_dir))


@query
def update_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.update_rejects(data.links(spark, sf_dir), data.updates(spark, sf_dir))


@query
def bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.bulk_delete(data.links(spark, sf_dir), data.deletes(spark, sf_dir))


@query
def delete_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.delete_feed(data.links(spark, sf_dir), data.deletes(spark, sf_dir))


@query
def delete_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.delete_rejects(data.links(spark, sf_dir), data.deletes(spark, sf_dir))


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = writes.create_points(data.order_ids(spark, sf_dir))
    return writes.duplicate_ids(data.links(spark, sf_dir).unionByName(points))


@query
def allocate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.allocate_ids(data.pairs(spark, sf_dir), ["source", "target"])


@query
def free_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = data.links(spark, sf_dir)
    return ids.free_ids(writes.bulk_delete(links, data.deletes(spark, sf_dir)))


@query
def free_id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = data.links(spark, sf_dir)
    return ids.free_ranges(writes.bulk_delete(links, data.deletes(spark, sf_dir)))


@query
def free_id_ranges_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranges from a bitmap of the links less one of the deletes."""
    held = idmap.id_map(data.links(spark, sf_dir))
    return idmap.free_map_ranges(idmap.without_ids(held, idmap.id_map(data.deletes(spark, sf_dir))))


@query
def free_id_ranges_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free ranges after a command log, from the bitmap before and the log's change feed."""
    links = data.links(spark, sf_dir)
    feed = cmd.change_feed(cmd.outcomes(data.commands(spark, sf_dir), base=links))
    return idmap.free_map_ranges(idmap.changed_map(idmap.id_map(links), feed))


# Command logs


@query
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmd.change_feed(cmd.outcomes(data.commands(spark, sf_dir)))


@query
def change_feed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed from so many parts that ordinary ids are cut into pieces too."""
    return cmd.change_feed(cmd.outcomes(data.commands(spark, sf_dir), parts=64))


@query
def change_feed_on_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    fates = cmd.outcomes(data.commands(spark, sf_dir), base=data.links(spark, sf_dir))
    return cmd.change_feed(fates)


@query
def command_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmd.rejects(cmd.outcomes(data.commands(spark, sf_dir)))


@query
def command_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmd.status_counts(cmd.outcomes(data.commands(spark, sf_dir)))


@query
def current_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmd.current_links(data.commands(spark, sf_dir))


@query
def current_links_on_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmd.current_links(data.commands(spark, sf_dir), base=data.links(spark, sf_dir))


# Versions and clustered copies


def _published(spark: SparkSession, sf_dir: str, *copies: str) -> LinkStore:
    store = LinkStore(spark, scratch_path(spark, "store"))
    store.publish(data.links(spark, sf_dir), copies=copies)
    return store


@query
def clustered_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "by_source").each([None, 7, None])


@query
def clustered_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "by_target").each([None, None, 42])


@query
def clustered_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).each([77])


@query
def clustered_concrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "by_source").each([None, 3, 17])


@query
def clustered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_links(_published(spark, sf_dir, "by_source").each([None, 7, None]))


@query
def curve_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One copy along a curve over both endpoints, in place of one by each."""
    return _published(spark, sf_dir, "by_curve").each([None, 7, None])


@query
def curve_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "by_curve").each([None, None, 42])


@query
def curve_concrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "by_curve").each([None, 3, 17])


@query
def store_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New links after the link with the highest id was deleted: its id is not given again."""
    store = _published(spark, sf_dir)
    top = counts.max_id(store.read()).select(
        F.lit(1).cast("bigint").alias("seq"), F.lit("delete").alias("op"), F.col("max_id").alias("id"),
        F.lit(None).cast("bigint").alias("source"), F.lit(None).cast("bigint").alias("target"),
    )
    store.apply(top, copies=())
    store.add(data.pairs(spark, sf_dir), copies=())
    return store.read()


@query
def snapshot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version read back after a later one was published over it."""
    store = _published(spark, sf_dir)
    store.apply(data.commands(spark, sf_dir), copies=())
    return store.read(version=1)


@query
def snapshot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a command log leads to."""
    store = _published(spark, sf_dir)
    store.apply(data.commands(spark, sf_dir), copies=())
    return store.read()


@query
def empty_snapshot_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter and size before and after dropping the table."""
    store = _published(spark, sf_dir)
    store.drop()
    return store.versions().select("version", "n_links", "next_id")


# The table as a format of spark.read


def _formatted(spark: SparkSession, sf_dir: str, pattern: list, *copies: str) -> DataFrame:
    store = _published(spark, sf_dir, *copies)
    store.index_files()
    linkformat.register(spark)
    return linkformat.each(spark, store.root, pattern)


@query
def format_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(spark, sf_dir, [None, 7, None], "by_source")


@query
def format_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(spark, sf_dir, [None, None, 42], "by_target")


@query
def format_concrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(spark, sf_dir, [None, 3, 17], "by_source")


# Versions that share id ranges


def _ranged(spark: SparkSession, sf_dir: str) -> RangedLinks:
    store = RangedLinks(spark, scratch_path(spark, "ranged"))
    store.create(data.links(spark, sf_dir), width=1 << 12)
    return store


@query
def ranged_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir).each([77])


@query
def ranged_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a command log leads to; ranges without an id of the log are not rewritten."""
    store = _ranged(spark, sf_dir)
    store.apply(data.commands(spark, sf_dir))
    return store.read()


@query
def ranged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of both versions and which of them wrote each."""
    store = _ranged(spark, sf_dir)
    store.apply(data.commands(spark, sf_dir))
    both = [store.index(v).withColumn("version", F.lit(v).cast("bigint")) for v in (1, 2)]
    return both[0].unionByName(both[1])


# Documents


@query
def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_links(documents.parse_documents(data.documents(spark, sf_dir)))


@query
def document_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_rejects(documents.parse_documents(data.documents(spark, sf_dir)))


@query
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_numbers(documents.parse_documents(data.count_documents(spark, sf_dir)))


# Benchmark logs


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.last_figures(benchlog.parse_lines(data.bench_lines(spark, sf_dir)))


@query
def bench_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.parse_lines(data.bench_lines(spark, sf_dir))


@query
def bench_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.failure_lines(data.bench_lines(spark, sf_dir))


@query
def bench_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of a log read as text files."""
    path = scratch_path(spark, "log")
    data.bench_lines(spark, sf_dir).select("line").write.text(path)
    order = ("file", "block", "row")
    return benchlog.parse_lines(benchlog.read_log(spark, path), order=order).select("op", "backend", "ns", "dev")


@query
def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_lines(report.speedups(report.comparison(_figures(spark, sf_dir))))


@query
def bench_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.comparison(_figures(spark, sf_dir))


@query
def bench_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.speedups(report.comparison(_figures(spark, sf_dir)))


@query
def bench_best_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = report.comparison(_figures(spark, sf_dir))
    return table.select("op", report.best_remote().alias("best_remote"))


@query
def bench_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.highest(report.comparison(_figures(spark, sf_dir)))


@query
def bench_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.visible(report.comparison(_figures(spark, sf_dir)))


@query
def bench_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.missing_figures(_figures(spark, sf_dir))


# Streams


def _command_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = (
        spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return data.as_commands(stream)


@query
def stream_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "feed")
    (
        cmd.change_feed(stream_outcomes(_command_stream(spark, sf_dir)))
        .writeStream.option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/feed")
        .awaitTermination()
    )
    return spark.read.parquet(f"{out}/feed")


@query
def stream_stateful_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed with state in RocksDB, ids drained in slices."""
    out = scratch_path(spark, "stateful-feed")
    with stateful.rocksdb(spark):
        (
            cmd.change_feed(stateful.stateful_outcomes(_command_stream(spark, sf_dir)))
            .writeStream.option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{out}/feed")
            .awaitTermination()
        )
    return spark.read.parquet(f"{out}/feed")


@query
def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream-links")
    sink = FeedSink(spark, out)
    sink.start(
        stream_outcomes(_command_stream(spark, sf_dir)), f"{out}/checkpoint", availableNow=True
    ).awaitTermination()
    return sink.links()


@query
def stream_compacted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a stream whose first half was compacted and whose second has a new checkpoint."""
    out = scratch_path(spark, "stream-compacted")
    sink = FeedSink(spark, out)
    events = data.table(spark, sf_dir, "events")
    middle = events.agg((F.max("event_id") / 2).cast("bigint").alias("m")).scalar()
    for n, half in enumerate((F.col("event_id") <= middle, F.col("event_id") > middle)):
        events.where(half).write.parquet(f"{out}/in-{n}")
        stream = data.as_commands(spark.readStream.schema(events.schema).parquet(f"{out}/in-{n}"))
        sink.start_folding(stream, f"{out}/checkpoint-{n}", availableNow=True).awaitTermination()
        if n == 0:
            sink.compact(copies=())
    return sink.links()


@query
def stream_late_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the commands of a stream fared that came once more in a second micro-batch."""
    out = scratch_path(spark, "stream-late")
    sink = FeedSink(spark, out)
    commands = data.commands(spark, sf_dir)
    for batch in range(2):
        sink.fold_batch(commands, batch, "replay")
    return sink.feed().groupBy("v", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_folded_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of a stream whose micro-batches are folded on the table so far."""
    out = scratch_path(spark, "stream-fold")
    sink = FeedSink(spark, out)
    sink.start_folding(
        _command_stream(spark, sf_dir), f"{out}/checkpoint", availableNow=True
    ).awaitTermination()
    return cmd.change_feed(sink.feed())
