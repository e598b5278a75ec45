"""A stream of commands as a stream of outcomes, with state in RocksDB that expires.

Beside ``stream_outcomes`` this form holds little of an id at a time and forgets what is
gone:

* An id's commands arrive in slices. A single slice is put in order in memory. More
  are each put in order, laid down in the state store as runs of blocks, and merged
  with one block per run in memory, as an external sort does; so an id may own any share of a
  micro-batch.
* A living id has a row in ``links``. A deleted one, or one that commands asked for in
  vain, has only the number of its last command, in ``gone``, which expires.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arcloom.schema import (
    ALREADY_EXISTS,
    APPLIED,
    CREATE,
    CREATE_EMPTY,
    DELETE,
    LATE,
    LOAD,
    MIN_LONG,
    NOT_EXISTS,
    OUTCOME,
    UNKNOWN_OP,
    UPDATE,
)

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # State expires by the clock, for which Spark would run batches without data, and without end.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
DAY = 24 * 3600 * 1000
BLOCK = 500  # commands of a run that are in memory at once
COLUMNS = ("seq", "op", "source", "target")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, and end once their data is read; the session's own choice returns afterwards."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class LinkProcessor(StatefulProcessor):
    """Commands of one id, in order of ``seq``, onto its state."""

    def __init__(self, forget_after_ms: int, block: int):
        self.forget_after_ms = forget_after_ms
        self.block = block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.links = handle.getValueState("links", "source bigint, target bigint, seq bigint")
        self.gone = handle.getValueState("gone", "seq bigint", ttlDurationMs=self.forget_after_ms)
        self.runs = handle.getMapState(
            "runs", "run int, block int", "seq array<bigint>, op array<string>, source array<bigint>, target array<bigint>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (link_id,) = key
        link, gone = self.links.get(), self.gone.get()
        self.alive = link is not None
        self.source, self.target, self.last = link or (0, 0, gone[0] if gone else MIN_LONG)
        pending = self._in_order(rows)
        while out := [self._fate(link_id, *command) for command in islice(pending, self.block * 10)]:
            yield pd.DataFrame(out, columns=OUTCOME.names)
        if self.alive:
            self.links.update((self.source, self.target, self.last))
            if gone:
                self.gone.clear()
        else:
            if link is not None:
                self.links.clear()
            self.gone.update((self.last,))

    def close(self) -> None:
        pass

    def _in_order(self, slices: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        first, runs = None, []
        for rows in slices:
            rows = rows.sort_values("seq", kind="stable")
            if first is None:
                first = rows
                continue
            if not runs:
                runs.append(self._lay_down(0, first))
            runs.append(self._lay_down(len(runs), rows))
        if not runs:
            yield from zip(*(first[c].tolist() for c in COLUMNS))
            return
        # Equal numbers keep the order of the slices.
        yield from heapq.merge(*(self._read(run, blocks) for run, blocks in enumerate(runs)), key=lambda command: command[0])

    def _lay_down(self, run: int, rows: pd.DataFrame) -> int:
        for block, at in enumerate(range(0, len(rows), self.block)):
            part = rows.iloc[at : at + self.block]
            self.runs.updateValue((run, block), tuple(part[c].tolist() for c in COLUMNS))
        return -(-len(rows) // self.block)

    def _read(self, run: int, blocks: int) -> Iterator[tuple]:
        for block in range(blocks):
            held = self.runs.getValue((run, block))
            self.runs.removeKey((run, block))
            yield from zip(*held)

    def _fate(self, link_id: int, seq: int, op: str, source: int, target: int) -> tuple:
        before = after = (0, 0)
        if seq < self.last or (seq == self.last and self.last != MIN_LONG):
            return seq, link_id, op, LATE, *before, *after
        self.last = seq
        if op in (CREATE, CREATE_EMPTY, LOAD):
            if self.alive:
                return seq, link_id, op, ALREADY_EXISTS, *before, *after
            after = {CREATE: (link_id, link_id), CREATE_EMPTY: (0, 0), LOAD: (source, target)}[op]
        elif op not in (UPDATE, DELETE):
            return seq, link_id, op, UNKNOWN_OP, *before, *after
        elif not self.alive:
            return seq, link_id, op, NOT_EXISTS, *before, *after
        else:
            before = self.source, self.target
            after = (source, target) if op == UPDATE else (0, 0)
        self.alive = op != DELETE
        self.source, self.target = after
        return seq, link_id, op, APPLIED, *before, *after


def stateful_outcomes(commands: DataFrame, forget_after_ms: int = DAY, block: int = BLOCK) -> DataFrame:
    """Every command of a stream with its status and images, as ``stream_outcomes`` gives. Start it within ``rocksdb``.

    Commands are put in order of ``seq`` per id inside each micro-batch; one at or below
    the last one handled for its id is ``late``. Of an id without a link that is known
    for ``forget_after_ms`` after its last command only: what is older and comes
    once more is then taken as new. Living ids never expire.
    """
    ends = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("source", "target")]
    return (
        commands.select("seq", "op", "id", *ends)
        .groupBy("id")
        .transformWithStateInPandas(LinkProcessor(forget_after_ms, block), OUTCOME, "append", "processingTime")
    )


def state_rows(spark: SparkSession, checkpoint: str, state: str) -> DataFrame:
    """What a query's last batch left in ``links``, ``gone`` or ``runs``, read from its checkpoint."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", state)
    return reader.load()
