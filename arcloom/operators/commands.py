"""Folding an ordered command log into change rows, rejects and the current table.

A command's fate depends on the commands on its id before it, a chain per id.
Both things the chain carries are "the last one before me" scans:

* whether the id exists: the last create (1) or delete (0). That holds even if
  that command was rejected, as the id exists after any create and not after any
  delete.
* its endpoints: the last value that an applied create or update stored. Stale
  values are never seen, since an applied create follows every delete.

A hot id may hold a third of the log, and a window per id would put that in one
task. So the log is laid out once, range-partitioned by ``(id, seq)`` and written
with the number of its part: parts are cut by rows, whatever the ids or the gaps
in ``seq``, and a hot id spans several. The commands of an id within a part are a
piece. Pieces are scanned apart and summed up in one row each, prefix scans over
these few rows per id give every piece its starting state, and that is joined back.

A piece is scanned without knowing whether its id exists when it starts: both
cases are kept side by side (``s0, t0`` if absent, ``s1, t1`` if present; only the
first create of the piece can tell them apart) and the case is chosen later. So a
base table is joined on the pieces, on the ids the log touches; its rows never
enter the sort, and the effect of a log on a table is one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.operators.sizing import is_small, sized
from arcloom.schema import (
    ALREADY_EXISTS,
    APPLIED,
    CREATE,
    CREATE_EMPTY,
    DELETE,
    FEED_COLUMNS,
    LINK_COLUMNS,
    LOAD,
    NOT_EXISTS,
    UNKNOWN_OP,
    UPDATE,
)
from arcloom.session import scratch_path

BIRTHS = (CREATE, CREATE_EMPTY, LOAD)
COMMAND_COLUMNS = ["seq", "op", *LINK_COLUMNS]
ABSENT, PRESENT = 0, 1
# What an id's commands do to it: its last create or delete, and what it holds
# afterwards if it was absent before (s0, t0) or present (s1, t1; NULL = unchanged).
EFFECT = ["life", "s0", "t0", "s1", "t1"]


PIECE = ["id", "part"]


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def laid_out(commands: DataFrame, parts: int | None = None) -> DataFrame:
    """The log with the ``part`` each command is in, stored in order of ``(id, seq)``.

    ``parts`` is the number of parts, by default that of shuffles.
    """
    parts = parts or int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = commands.select(*COMMAND_COLUMNS).repartitionByRange(parts, "id", "seq")
    return stored(ranged.withColumn("part", F.spark_partition_id()), "log")


# The scans are written as SQL text: the same plan as Column objects would give,
# without thousands of driver round trips to assemble them.


def _last_before(value: str, keys: list[str], order: str) -> str:
    return (
        f"last_value({value}) IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


def _stored(endpoint: str, start: int) -> str:
    """The endpoint a command stores if its piece started absent or present, else NULL."""
    existed = f"coalesce(seen, {start})"
    return f"""CASE
        WHEN op = '{UPDATE}' AND {existed} = {PRESENT} OR op = '{LOAD}' AND {existed} = {ABSENT}
            THEN coalesce({endpoint}, 0L)
        WHEN op = '{CREATE}' AND {existed} = {ABSENT} THEN id
        WHEN op = '{CREATE_EMPTY}' AND {existed} = {ABSENT} THEN 0L
    END"""


def _scan(commands: DataFrame, keys: list[str]) -> DataFrame:
    """Commands with ``life``, ``seen`` (existence before, as far as the piece
    tells) and what each stores if its piece started absent or present."""
    life = f"CASE WHEN op IN {BIRTHS} THEN {PRESENT} WHEN op = '{DELETE}' THEN {ABSENT} END"
    return (
        commands.selectExpr("*", f"{life} AS life")
        .selectExpr("*", f"{_last_before('life', keys, 'seq')} AS seen")
        .selectExpr(
            "*",
            *[
                f"{_stored(endpoint, start)} AS {endpoint[0]}{start}"
                for start in (ABSENT, PRESENT)
                for endpoint in ("source", "target")
            ],
        )
    )


def _sum_up(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """The effect of each piece, one row per piece."""
    last = [F.expr(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN seq END) AS {c}") for c in EFFECT]
    return scanned.groupBy(*keys).agg(*last)


def _outcomes(
    scanned: DataFrame, keys: list[str], start: DataFrame | None, on: list[str]
) -> DataFrame:
    """Statuses and images, once ``start`` (``existed, was_s, was_t``) is known."""
    before = scanned.selectExpr(
        "*", *[f"{_last_before(c, keys, 'seq')} AS b{c}" for c in ("s0", "t0", "s1", "t1")]
    )
    if start is None:
        before = before.selectExpr("*", f"{ABSENT} AS existed", "0L AS was_s", "0L AS was_t")
    else:
        before = before.join(start, on, "left")
    status = f"""CASE
        WHEN op IN {BIRTHS} AND coalesce(seen, existed, {ABSENT}) = {PRESENT} THEN '{ALREADY_EXISTS}'
        WHEN op IN ('{UPDATE}', '{DELETE}') AND coalesce(seen, existed, {ABSENT}) = {ABSENT} THEN '{NOT_EXISTS}'
        WHEN op IN {BIRTHS} OR op IN ('{UPDATE}', '{DELETE}') THEN '{APPLIED}'
        ELSE '{UNKNOWN_OP}'
    END"""
    # The case that holds, of the two each piece was scanned for.
    chosen = [f"CASE WHEN existed = {PRESENT} THEN {c}1 ELSE {c}0 END AS {c}" for c in ("bs", "bt", "s", "t")]
    had = f"status = '{APPLIED}' AND op IN ('{UPDATE}', '{DELETE}')"
    has = f"status = '{APPLIED}' AND op <> '{DELETE}'"
    return before.selectExpr(
        "seq", "id", "op", f"{status} AS status", "was_s", "was_t", *chosen
    ).selectExpr(
        "seq",
        "id",
        "op",
        "status",
        f"CASE WHEN {had} THEN coalesce(bs, was_s, 0L) ELSE 0L END AS before_source",
        f"CASE WHEN {had} THEN coalesce(bt, was_t, 0L) ELSE 0L END AS before_target",
        f"CASE WHEN {has} THEN s ELSE 0L END AS after_source",
        f"CASE WHEN {has} THEN t ELSE 0L END AS after_target",
    )


def _piece_starts(pieces: DataFrame, start: DataFrame | None, few: bool) -> DataFrame:
    """The state every piece starts in, from the effects of the pieces of its id before it."""
    if start is None:
        pieces = pieces.selectExpr("*", f"{ABSENT} AS existed", "0L AS was_s", "0L AS was_t")
    else:
        pieces = pieces.join(sized(start, few), "id", "left")
    earlier = _last_before("life", ["id"], "part")
    held = {c: f"CASE WHEN existed = {PRESENT} THEN {c}1 ELSE {c}0 END" for c in "st"}
    return (
        pieces.selectExpr(
            *PIECE, *EFFECT[1:], f"coalesce({earlier}, existed, {ABSENT}) AS existed", "was_s", "was_t"
        )
        .selectExpr(
            *PIECE,
            "existed",
            *[f"coalesce({_last_before(e, ['id'], 'part')}, was_{c}) AS was_{c}" for c, e in held.items()],
        )
    )


def outcomes(
    commands: DataFrame, base: DataFrame | None = None, parts: int | None = None, small: bool | None = None
) -> DataFrame:
    """Every command with its ``status`` and images (zeros unless applied).

    ``base`` is the table the log starts from. If the log touches few ids
    (counted on its pieces, or told by ``small``) only those of the base are picked,
    by a broadcast semi-join; otherwise the base is shuffled once to meet the log.
    """
    scanned = _scan(laid_out(commands, parts), PIECE)
    pieces = stored(_sum_up(scanned, PIECE), "pieces")
    start, few = None, False
    if base is not None:
        few = is_small(pieces, small)
        touched = sized(pieces.select("id").distinct(), few)
        start = base.join(touched, "id", "left_semi") if few else base
        start = start.selectExpr("id", f"{PRESENT} AS existed", "source AS was_s", "target AS was_t")
    return _outcomes(scanned, PIECE, _piece_starts(pieces, start, few), PIECE)


def log_effect(commands: DataFrame, parts: int | None = None) -> DataFrame:
    """What a log does to each id it touches, whatever table it is applied to.

    One row ``(id, life, s0, t0, s1, t1)`` per id, see ``EFFECT``.
    """
    # Both cases of the id, followed through its pieces.
    pieces = stored(_sum_up(_scan(laid_out(commands, parts), PIECE), PIECE), "pieces").selectExpr(
        "*", f"{_last_before('life', ['id'], 'part')} AS earlier"
    )
    last = ["max_by(life, CASE WHEN life IS NOT NULL THEN part END) AS life"]
    for start in (ABSENT, PRESENT):
        for c in "st":
            held = f"CASE WHEN coalesce(earlier, {start}) = {PRESENT} THEN {c}1 ELSE {c}0 END"
            last.append(f"max_by({held}, CASE WHEN {held} IS NOT NULL THEN part END) AS {c}{start}")
    return pieces.groupBy("id").agg(*map(F.expr, last))


def change_feed(fates: DataFrame) -> DataFrame:
    """The before and after image of every applied command."""
    return fates.where((F.col("status") == APPLIED) & (F.col("op") != LOAD)).select(*FEED_COLUMNS)


def rejects(fates: DataFrame) -> DataFrame:
    """Commands that were not applied, and why."""
    return fates.where((F.col("status") != APPLIED) & (F.col("op") != LOAD)).select(
        "seq", "id", "op", "status"
    )


def latest_links(fates: DataFrame) -> DataFrame:
    """The links the given outcomes leave behind.

    ``max_by`` on plain numbers keeps a hash aggregate with map-side combine, so
    a hot id arrives as one row per task.
    """
    alive = (F.col("op") != DELETE).cast("int")
    return (
        fates.where(F.col("status") == APPLIED)
        .groupBy("id")
        .agg(
            F.max_by(alive, "seq").alias("alive"),
            F.max_by("after_source", "seq").alias("source"),
            F.max_by("after_target", "seq").alias("target"),
        )
        .where(F.col("alive") == 1)
        .select(*LINK_COLUMNS)
    )


def current_links(
    commands: DataFrame, base: DataFrame | None = None, parts: int | None = None, small: bool | None = None
) -> DataFrame:
    """The table after all commands.

    The effect of the log is summed up without the base and stored, then joined to
    the base: by broadcast if it touches few ids, else by a full outer join on ``id``.
    """
    effect = log_effect(commands, parts)
    if base is not None:
        return applied(stored(effect, "effect"), base, small)
    return effect.where(F.col("life") == PRESENT).select(
        "id", F.col("s0").alias("source"), F.col("t0").alias("target")
    )


def highest_birth(effect: DataFrame) -> int:
    """The highest id that a log with the stored ``effect`` gives out, 0 if none.

    An id that starts absent has been given an endpoint only if it was created, also
    where it is deleted again.
    """
    return effect.where(F.col("s0").isNotNull()).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def applied(effect: DataFrame, base: DataFrame, small: bool | None = None) -> DataFrame:
    """``base`` after a log with the stored ``effect`` (see ``log_effect``)."""
    made = effect.where(F.col("life") == PRESENT).select(
        "id", F.col("s0").alias("source"), F.col("t0").alias("target")
    )
    survives = F.col("life").isNull() | (F.col("life") == PRESENT)
    if is_small(effect, small):
        kept = (
            base.join(F.broadcast(effect), "id", "left")
            .where(survives)
            .select("id", F.coalesce("s1", "source").alias("source"), F.coalesce("t1", "target").alias("target"))
        )
        held = base.join(F.broadcast(made.select("id")), "id", "left_semi")
        return kept.unionByName(made.join(held, "id", "left_anti"))
    in_base = F.col("held").isNotNull()
    joined = base.select(*LINK_COLUMNS, F.lit(True).alias("held")).join(effect, "id", "full")
    return joined.where((in_base & survives) | (F.col("life") == PRESENT)).select(
        "id",
        F.when(in_base, F.coalesce("s1", "source")).otherwise(F.col("s0")).alias("source"),
        F.when(in_base, F.coalesce("t1", "target")).otherwise(F.col("t0")).alias("target"),
    )


def status_counts(fates: DataFrame) -> DataFrame:
    """How many commands met each fate, per operation."""
    return fates.where(F.col("op") != LOAD).groupBy("op", "status").agg(F.count(F.lit(1)).alias("n"))
