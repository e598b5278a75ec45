"""The stream with expiring state against the sequential loop; hot ids in slices."""

import time

from helpers import rows
from test_commands import random_log, replay

from arcloom.schema import COMMAND
from arcloom.session import scratch_path
from arcloom.streaming import stateful

SLICE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark, root, part, **how):
    """One micro-batch; the outcomes so far."""
    spark.createDataFrame(part, COMMAND).repartition(3).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(COMMAND).parquet(f"{root}/in")
    with stateful.rocksdb(spark):
        (
            stateful.stateful_outcomes(stream, **how)
            .writeStream.option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{root}/out")
            .awaitTermination()
        )
    return spark.read.parquet(f"{root}/out")


def test_stream_equals_the_loop_and_replays_are_late(spark):
    log = random_log(12, n=200)
    root = scratch_path(spark, "test-stateful")
    for part in (log[:90], log[90:], log[40:60]):
        out = run(spark, root, part)
    fates, links = replay(log)
    assert rows(out.where("status <> 'late'")) == fates
    assert out.where("status = 'late'").count() == 20
    held = stateful.state_rows(spark, f"{root}/checkpoint", "links").select("key.id", "value.source", "value.target")
    assert rows(held) == links


def test_a_hot_id_is_drained_in_slices(spark):
    """Half of a batch is one id, in slices of 20 and blocks of 7: runs are merged, and none is left behind."""
    log = random_log(13, n=400)
    log = [(s, op, 5 if s % 2 else i, a, b) for s, op, i, a, b in log]
    root = scratch_path(spark, "test-stateful-hot")
    before = spark.conf.get(SLICE)  # rows that Spark hands to Python at once
    spark.conf.set(SLICE, 20)
    try:
        out = run(spark, root, log, block=7)
    finally:
        spark.conf.set(SLICE, before)
    fates, _ = replay(log)
    assert rows(out) == fates
    assert stateful.state_rows(spark, f"{root}/checkpoint", "runs").count() == 0


def test_deleted_ids_expire_and_living_ones_stay(spark):
    log = [(i, "create", i, None, None) for i in range(1, 21)] + [(20 + i, "delete", i, None, None) for i in range(1, 16)]
    root = scratch_path(spark, "test-stateful-expiry")
    run(spark, root, log, forget_after_ms=2000)
    count = lambda state: stateful.state_rows(spark, f"{root}/checkpoint", state).count()
    assert (count("links"), count("gone")) == (5, 15)
    time.sleep(3)
    out = run(spark, root, [(100, "create", 50, None, None)], forget_after_ms=2000)
    assert (count("links"), count("gone")) == (6, 0)
    # Forgotten ids start anew; living ones still tell what is late.
    out = run(spark, root, [(3, "create", 3, None, None), (17, "create", 17, None, None)], forget_after_ms=2000)
    assert {(r.id, r.status) for r in out.where("seq = 3 or seq = 17").collect()} >= {(3, "applied"), (17, "late")}
