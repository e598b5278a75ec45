"""Bulk create, update and delete on immutable link tables.

Each function returns the new table (or the change rows, or the rejects) as a
DataFrame; ``sources.snapshots`` publishes a table as a new version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.operators.sizing import is_small, sized
from arcloom.schema import CREATE, CREATE_EMPTY, DELETE, LINK_COLUMNS, NOT_EXISTS, UPDATE


def create_empty(ids: DataFrame) -> DataFrame:
    """Links ``(id, 0, 0)`` for new ids."""
    zero = F.lit(0).cast("bigint")
    return ids.select("id", zero.alias("source"), zero.alias("target"))


def create_points(ids: DataFrame) -> DataFrame:
    """Links ``(id, id, id)`` for new ids."""
    return ids.select("id", F.col("id").alias("source"), F.col("id").alias("target"))


def create_feed(created: DataFrame, empty: bool = False) -> DataFrame:
    """Change rows of created links: nothing before, the link after."""
    zero = F.lit(0).cast("bigint")
    return created.select(
        "id",
        F.lit(CREATE_EMPTY if empty else CREATE).alias("op"),
        zero.alias("before_source"),
        zero.alias("before_target"),
        F.col("source").alias("after_source"),
        F.col("target").alias("after_target"),
    )


def last_update(updates: DataFrame, order: str = "seq") -> DataFrame:
    """One update per id, the last by ``order``. Combined map-side, so a hot id is cheap."""
    return updates.groupBy("id").agg(
        F.max_by("source", order).alias("source"), F.max_by("target", order).alias("target")
    )


def _new_values(updates: DataFrame) -> DataFrame:
    return updates.select(
        "id",
        F.coalesce("source", F.lit(0)).alias("new_source"),
        F.coalesce("target", F.lit(0)).alias("new_target"),
    )


def _asked(ids: DataFrame, few: bool) -> DataFrame:
    """Requested ids as the right side of a join: broadcast, or once each, so that
    an id asked for by a third of the requests is one row per task."""
    return F.broadcast(ids.select("id")) if few else ids.select("id").distinct()


def _present(links: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """The part of ``links`` an anti-join against them needs.

    With few requests a broadcast semi-join leaves only the requested ids, so
    the link table is scanned and not shuffled.
    """
    return links.join(F.broadcast(ids.select("id")), "id", "left_semi") if few else links


def bulk_update(links: DataFrame, updates: DataFrame, small: bool | None = None) -> DataFrame:
    """The table after ``updates`` (one row per id): both endpoints replaced.

    Updates of absent ids store nothing; ``update_rejects`` lists them.
    """
    few = is_small(updates, small)
    joined = links.join(sized(_new_values(updates), few), "id", "left")
    return joined.select(
        "id",
        F.coalesce("new_source", "source").alias("source"),
        F.coalesce("new_target", "target").alias("target"),
    )


def update_feed(links: DataFrame, updates: DataFrame, small: bool | None = None) -> DataFrame:
    """Change rows of ``updates``: the old endpoints before, the new after."""
    few = is_small(updates, small)
    return links.join(sized(_new_values(updates), few), "id").select(
        "id",
        F.lit(UPDATE).alias("op"),
        F.col("source").alias("before_source"),
        F.col("target").alias("before_target"),
        F.col("new_source").alias("after_source"),
        F.col("new_target").alias("after_target"),
    )


def update_rejects(links: DataFrame, updates: DataFrame, small: bool | None = None) -> DataFrame:
    """Updates whose id does not exist."""
    few = is_small(updates, small)
    missed = updates.join(_present(links, updates, few), "id", "left_anti")
    return missed.select("id", F.lit(UPDATE).alias("op"), F.lit(NOT_EXISTS).alias("status"))


def bulk_delete(links: DataFrame, ids: DataFrame, small: bool | None = None) -> DataFrame:
    """The table without the given ids."""
    few = is_small(ids, small)
    return links.join(_asked(ids, few), "id", "left_anti").select(*LINK_COLUMNS)


def delete_feed(links: DataFrame, ids: DataFrame, small: bool | None = None) -> DataFrame:
    """Change rows of deletes: the link before, nothing after."""
    few = is_small(ids, small)
    zero = F.lit(0).cast("bigint")
    return links.join(_asked(ids, few), "id", "left_semi").select(
        "id",
        F.lit(DELETE).alias("op"),
        F.col("source").alias("before_source"),
        F.col("target").alias("before_target"),
        zero.alias("after_source"),
        zero.alias("after_target"),
    )


def delete_rejects(links: DataFrame, ids: DataFrame, small: bool | None = None) -> DataFrame:
    """Requested deletes whose id does not exist, once per id."""
    few = is_small(ids, small)
    missed = ids.select("id").distinct().join(_present(links, ids, few), "id", "left_anti")
    return missed.select("id", F.lit(DELETE).alias("op"), F.lit(NOT_EXISTS).alias("status"))


def duplicate_ids(links: DataFrame) -> DataFrame:
    """Ids that break the unique-id rule, with their number of rows."""
    return links.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def fresh_and_taken(links: DataFrame, ids: DataFrame, small: bool | None = None) -> DataFrame:
    """Requested new ids with ``taken``: whether a link already has that id."""
    few = is_small(ids, small)
    held = _present(links, ids, few).select("id", F.lit(True).alias("taken"))
    return ids.join(held, "id", "left").select("id", F.coalesce("taken", F.lit(False)).alias("taken"))
