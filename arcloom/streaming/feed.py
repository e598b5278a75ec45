"""A stream of commands as a stream of outcomes, with one small state per id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

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

STATE = "alive boolean, source bigint, target bigint, seq bigint"


def stream_outcomes(commands: DataFrame) -> DataFrame:
    """Every command of a stream with its status and images, as ``outcomes`` gives.

    Commands are put in ``seq`` order per id inside each micro-batch. A command at
    or below the last one handled for its id comes out ``late`` and changes
    nothing, so replays are harmless; order across batches is the source's duty.
    A LOAD command seeds an id from an existing table.

    One call holds one id's commands of one micro-batch, which the source's
    trigger options (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bound. A
    backlog with hot ids is better folded as a batch first, and the stream
    started from its result.
    """
    # Endpoints are completed here: a NULL would turn the pandas column into floats.
    ends = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("source", "target")]
    return (
        commands.select("seq", "op", "id", *ends)
        .groupBy("id")
        .applyInPandasWithState(
            _state_function(), OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout
        )
    )


def _state_function():
    # A local function travels to the executors by value, so they need pandas and
    # nothing of this package.
    columns = OUTCOME.names

    def advance(
        key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        (link_id,) = key
        alive, source, target, last = state.get if state.exists else (False, 0, 0, MIN_LONG)
        arrived = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for seq, op, s, t in zip(*(arrived[c].tolist() for c in ("seq", "op", "source", "target"))):
            before, after = (0, 0), (0, 0)
            if seq < last or (seq == last and last != MIN_LONG):
                status = LATE
            elif op in (CREATE, CREATE_EMPTY, LOAD):
                status = ALREADY_EXISTS if alive else APPLIED
                if not alive:
                    alive = True
                    after = {CREATE: (link_id, link_id), CREATE_EMPTY: (0, 0), LOAD: (s, t)}[op]
            elif op in (UPDATE, DELETE):
                status = APPLIED if alive else NOT_EXISTS
                if alive:
                    before = (source, target)
                    alive = op == UPDATE
                    after = (s, t) if alive else (0, 0)
            else:
                status = UNKNOWN_OP
            if status == APPLIED:
                source, target = after
            if status != LATE:
                last = seq
            out.append((seq, link_id, op, status, *before, *after))
        state.update((alive, source, target, last))
        yield pd.DataFrame(out, columns=columns)

    return advance
