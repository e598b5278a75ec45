"""The streams against the batch fold and the sequential loop."""

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_commands import random_base, random_log, replay

from arcloom.operators import commands as cmd
from arcloom.schema import COMMAND, LINK
from arcloom.session import scratch_path
from arcloom.streaming.feed import stream_outcomes
from arcloom.streaming.sinks import FeedSink


@pytest.fixture(scope="module")
def run(spark):
    """Three files in order, then a replay of the second, one micro-batch each."""
    log = random_log(11, n=240)
    root = scratch_path(spark, "test-stream")
    sink = FeedSink(spark, f"{root}/sink")

    def feed(part):
        spark.createDataFrame(part, COMMAND).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

        def both(fates, batch_id):
            fates.persist()
            fates.write.mode("overwrite").parquet(f"{root}/out/v={batch_id}")
            sink.write_batch(fates, batch_id, "test")
            fates.unpersist()

        (
            stream_outcomes(stream)
            .writeStream.foreachBatch(both)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    for part in (log[:80], log[80:160], log[160:], log[80:130]):
        feed(part)
    return log, sink, spark.read.parquet(f"{root}/out")


def test_stream_equals_batch_and_replays_are_late(spark, run):
    log, _, out = run
    fates, _ = replay(log)
    columns = cmd.outcomes(spark.createDataFrame(log, COMMAND)).columns
    assert rows(out.where("status <> 'late'").select(columns)) == fates
    late = out.where("status = 'late'")
    assert {(r.v, r.seq) for r in late.collect()} == {(3, c[0]) for c in log[80:130]}


def test_sink_gives_the_table_after_every_batch(run):
    log, sink, _ = run
    for version, upto in enumerate((80, 160, 240, 240)):
        assert rows(sink.links(version)) == replay(log[:upto])[1]
    assert rows(sink.links()) == replay(log)[1]


def test_repeated_batch_and_compaction(spark, run):
    log, sink, out = run
    expected = replay(log)[1]
    sink.write_batch(out.where(F.col("v") == 2).drop("v"), 2, "test")
    assert rows(sink.links()) == expected
    version = sink.compact()
    assert version.n_links == len(expected) and version.label == 3
    assert rows(sink.links()) == expected
    assert rows(sink.links(1)) == replay(log[:160])[1]
    made = [(10**6, "create", 500, None, None), (10**6 + 1, "delete", log[-1][2], None, None)]
    sink.write_batch(cmd.outcomes(spark.createDataFrame(made, COMMAND), sink.links()), 4, "test")
    assert rows(sink.links()) == replay([*log, *made])[1]
    assert rows(sink.links(3)) == expected


def test_large_numbers_and_missing_endpoints(spark):
    big = 2**60 + 1
    log = [(1, "create", big, None, None), (2, "update", big, big, None), (3, "update", big, None, big)]
    root = scratch_path(spark, "test-stream")
    spark.createDataFrame(log, COMMAND).write.parquet(f"{root}/in")
    sink = FeedSink(spark, f"{root}/sink")
    fates = stream_outcomes(spark.readStream.schema(COMMAND).parquet(f"{root}/in"))
    sink.start(fates, f"{root}/checkpoint", availableNow=True).awaitTermination()
    assert rows(sink.links()) == [(big, 0, big)]
    assert FeedSink(spark, f"{root}/new").links().count() == 0


def test_folding_batches_equals_the_loop(spark):
    """Three micro-batches on a base, the last one run twice."""
    base = random_base(4)
    log = random_log(21, n=240)
    sink = FeedSink(spark, scratch_path(spark, "test-fold"))
    sink.store.publish(spark.createDataFrame(base, LINK), copies=(), label=-1)
    for batch, part in enumerate((log[:80], log[80:160], log[160:], log[160:])):
        sink.fold_batch(spark.createDataFrame(part, COMMAND), min(batch, 2), "test")
    fates, table = replay(log, base)
    assert rows(sink.feed().drop("v")) == fates
    assert rows(sink.links()) == table
    assert rows(sink.links(0)) == replay(log[:80], base)[1]


@pytest.mark.parametrize("compacted", [False, True])
def test_a_new_checkpoint_neither_overwrites_nor_hides(spark, compacted):
    sink = FeedSink(spark, scratch_path(spark, "test-restart"))

    def stream(part, checkpoint):
        root = scratch_path(spark, "test-in")
        spark.createDataFrame(part, COMMAND).write.parquet(root)
        rows = spark.readStream.schema(COMMAND).parquet(root)
        sink.start(stream_outcomes(rows), scratch_path(spark, checkpoint), availableNow=True).awaitTermination()

    stream([(1, "create", 1, None, None), (2, "create", 2, None, None)], "one")
    if compacted:
        sink.compact()
    stream([(3, "create", 3, None, None)], "two")
    assert [r[0] for r in rows(sink.links())] == [1, 2, 3]
    assert [r[0] for r in rows(sink.links(0))] == [1, 2]


def test_late_commands_of_folded_batches(spark):
    """What comes at or below the last handled command of its id changes nothing, after a rejected one too."""
    sink = FeedSink(spark, scratch_path(spark, "test-late"))
    batches = [
        [(10, "create", 1, None, None), (12, "update", 2, 5, 5)],
        [(5, "delete", 1, None, None), (11, "create", 2, None, None), (10, "create", 1, None, None)],
        [(11, "update", 1, 7, 8), (11, "update", 1, 7, 8), (13, "create", 2, None, None)],
    ]
    for n, part in enumerate(batches):
        sink.fold_batch(spark.createDataFrame(part, COMMAND), n)
        if n == 1:
            sink.compact()
    found = sorted((r.v, r.seq, r.id, r.status) for r in sink.feed().collect())
    assert found == [
        (0, 10, 1, "applied"), (0, 12, 2, "not_exists"), (1, 5, 1, "late"), (1, 10, 1, "late"), (1, 11, 2, "late"),
        (2, 11, 1, "applied"), (2, 11, 1, "late"), (2, 13, 2, "applied"),
    ]
    assert rows(sink.links()) == [(1, 7, 8), (2, 2, 2)]


def test_compaction_never_gives_an_id_twice(spark):
    sink = FeedSink(spark, scratch_path(spark, "test-counter"))
    log = [(1, "create", 1, None, None), (2, "create", 9, None, None), (3, "delete", 9, None, None)]
    sink.fold_batch(spark.createDataFrame(log, COMMAND), 0)
    assert sink.compact().next_id == 10
