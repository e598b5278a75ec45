"""Counts, degrees and the highest id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.patterns import Pattern, predicate
from arcloom.operators.reads import (
    BY_ID,
    BY_NOTHING,
    BY_PAIR,
    BY_SOURCE,
    BY_TARGET,
    KEY,
    by_way,
    keyed_links,
    keyed_patterns,
    residual,
)
from arcloom.operators.sizing import is_small
from arcloom.schema import DELETE, PATTERN_COLUMNS, UPDATE
from arcloom.session import scratch_path


def count_links(links: DataFrame, pattern: Pattern = ()) -> DataFrame:
    """The number of links that match one pattern, as one row ``n``."""
    condition = predicate(pattern)
    rows = links if condition is None else links.where(condition)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def max_id(links: DataFrame) -> DataFrame:
    """The highest id, 0 for an empty table, as one row ``max_id``."""
    return links.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))


def out_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def in_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def pair_multiplicity(links: DataFrame) -> DataFrame:
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def degree_changes(feed: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, n)``: what a change feed adds to and takes from the degrees, by ``source``, ``target`` or both.

    An update takes from its old end and adds to its new one. The work is that of the
    feed alone, whose hubs are summed before they are shuffled; on a streaming feed
    this is an aggregate for update or complete mode.
    """

    def end(image: str, sign: int) -> Column:
        return F.struct(*[F.col(f"{image}_{key}").alias(key) for key in keys], F.lit(sign).cast("bigint").alias("n"))

    taken = F.when(F.col("op").isin(UPDATE, DELETE), F.array(end("before", -1)))
    added = F.when(F.col("op") != DELETE, F.array(end("after", 1)))
    none = F.array().cast(f"array<struct<{', '.join(f'{key}: bigint' for key in keys)}, n: bigint>>")
    ends = F.explode(F.concat(F.coalesce(taken, none), F.coalesce(added, none))).alias("end")
    return feed.select(ends).select("end.*").groupBy(*keys).agg(F.sum("n").alias("n"))


def changed_degrees(degrees: DataFrame, changes: DataFrame) -> DataFrame:
    """Degrees after ``changes``, both ``(*keys, n)``; keys that no link has any more are gone."""
    keys = [c for c in degrees.columns if c != "n"]
    return degrees.unionByName(changes).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def count_patterns(links: DataFrame, patterns: DataFrame, small: bool | None = None) -> DataFrame:
    """``(pid, n)`` for every pattern, zeros kept.

    Matches are counted, never listed, so a hub asked for by a million patterns
    costs no more than one asked for once.

    * Few patterns (checked): equal ones are merged and broadcast against one
      scan of the links, and the hits are summed map-side; the link table is
      never shuffled.
    * Many patterns: equal ones are merged, the links are narrowed to the keys asked
      for and counted per key before the shuffle, so a hub is one partial row per
      task. The counts are stored and joined back to the patterns: both sides of
      that join are plain tables, so AQE can split a pattern asked very often.

    An all-ANY pattern takes the table's total from a scalar subquery.
    """
    total = count_links(links).scalar()
    if not is_small(patterns, small):
        return _count_many(links, keyed_patterns(patterns), total)
    distinct = keyed_patterns(patterns.select(*PATTERN_COLUMNS).distinct()).where(
        F.col("how") != BY_NOTHING
    )
    found = (
        keyed_links(links, [BY_ID, BY_PAIR, BY_SOURCE, BY_TARGET])
        .join(F.broadcast(distinct), KEY)
        .where(residual())
        .groupBy(*PATTERN_COLUMNS)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    p, c = patterns.alias("p"), F.broadcast(found).alias("c")  # at most one row per pattern
    same = [F.col(f"p.{name}").eqNullSafe(F.col(f"c.{name}")) for name in PATTERN_COLUMNS]
    unbound = F.coalesce(*[F.col(f"p.{name}") for name in PATTERN_COLUMNS]).isNull()
    return p.join(c, same, "left").select(
        F.col("p.pid").alias("pid"),
        F.when(unbound, total).otherwise(F.coalesce("c.n", F.lit(0))).alias("n"),
    )


def _count_many(links: DataFrame, keyed: DataFrame, total: Column) -> DataFrame:
    distinct = keyed.drop("pid").distinct()
    names = {BY_PAIR: ["source", "target"], BY_SOURCE: ["source"], BY_TARGET: ["target"]}
    parts = []
    for how, columns in names.items():
        asked, equal = by_way(distinct, how)
        per_key = links.join(asked.hint("merge"), equal, "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        parts.append(asked.join(per_key.hint("merge"), equal).select(*PATTERN_COLUMNS, "n"))
    asked, equal = by_way(distinct, BY_ID)
    hits = links.join(asked.hint("merge"), [*equal, residual()])
    parts.append(hits.groupBy(*PATTERN_COLUMNS).agg(F.count(F.lit(1)).alias("n")))
    path = scratch_path(links.sparkSession, "pattern-counts")
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    found = links.sparkSession.read.parquet(path)
    p, c = keyed.alias("p"), found.hint("merge").alias("c")
    same = [F.col(f"p.{name}").eqNullSafe(F.col(f"c.{name}")) for name in PATTERN_COLUMNS]
    return p.join(c, same, "left").select(
        F.col("p.pid").alias("pid"),
        F.when(F.col("p.how") == BY_NOTHING, total).otherwise(F.coalesce("c.n", F.lit(0))).alias("n"),
    )
