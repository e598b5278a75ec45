"""Pattern reads: one pattern as a pushed filter, many patterns as one join."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from arcloom.functions.patterns import Pattern, predicate
from arcloom.operators.commands import stored
from arcloom.operators.sizing import BROADCAST_ROWS, is_small, sized
from arcloom.schema import LINK_COLUMNS, MAX_LONG, PATTERN_COLUMNS

# How a pattern finds its candidates: by the most selective bound positions.
# An id names at most one link, so with an id bound the rest is a residual test.
BY_NOTHING, BY_ID, BY_PAIR, BY_SOURCE, BY_TARGET = 0, 1, 2, 3, 4
KEY = ["how", "k1", "k2"]

# A key's links and patterns are cut into blocks of this many rows where their
# product exceeds a block by a block; keys asked less often are left to AQE.
BLOCK = 2048
OFTEN = 16


def each(links: DataFrame, pattern: Pattern = ()) -> DataFrame:
    """All links that match one pattern of length 0, 1 or 3."""
    condition = predicate(pattern)
    rows = links if condition is None else links.where(condition)
    return rows.select(*LINK_COLUMNS)


def get_link(links: DataFrame, link_id: int) -> Row | None:
    """The link with this id, or ``None``."""
    found = each(links, [link_id]).limit(1).collect()
    return found[0] if found else None


def get_links(links: DataFrame, ids: DataFrame, small: bool | None = None) -> DataFrame:
    """Every row of ``ids`` with its link and a ``found`` flag; absent ids give zeros.

    A small request narrows the link table by a broadcast semi-join first, so the
    links are scanned once and never shuffled. A large request is one shuffled
    left join; a repeated hot id sits on its left side, which AQE may split.
    """
    candidates = links.select(*LINK_COLUMNS)
    if is_small(ids, small):
        candidates = candidates.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
    hits = candidates.withColumn("found", F.lit(True))
    return ids.join(hits, "id", "left").select(
        *[c for c in ids.columns],
        F.coalesce("source", F.lit(0)).alias("source"),
        F.coalesce("target", F.lit(0)).alias("target"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def each_until(links: DataFrame, stop: Column, pattern: Pattern = ()) -> DataFrame:
    """Matching links in id order up to and including the first where ``stop`` holds.

    The cut-off id is a scalar subquery: a distributed minimum, then a plain
    filter, so no total order and no single task is needed.
    """
    rows = each(links, pattern)
    cut = rows.where(stop).agg(F.min("id").alias("cut"))
    return rows.where(F.col("id") <= F.coalesce(cut.scalar(), F.lit(MAX_LONG)))


def each_first(links: DataFrame, n: int, pattern: Pattern = ()) -> DataFrame:
    """At most ``n`` matching links, any of them: an early stop by count."""
    return each(links, pattern).limit(n)


def visit(rows: DataFrame, handler: Callable[[Row], None]) -> None:
    """Run ``handler`` for every row on the executors, for its side effects.

    A retried task calls it again for the same rows, so it must be idempotent.
    """

    def visit_partition(part: Iterable[Row]) -> None:
        for row in part:
            handler(row)

    rows.foreachPartition(visit_partition)


def keyed_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns with the join key ``(how, k1, k2)`` that finds their candidates."""
    how = (
        F.when(F.col("p_id").isNotNull(), BY_ID)
        .when(F.col("p_source").isNotNull() & F.col("p_target").isNotNull(), BY_PAIR)
        .when(F.col("p_source").isNotNull(), BY_SOURCE)
        .when(F.col("p_target").isNotNull(), BY_TARGET)
        .otherwise(BY_NOTHING)
    )
    return patterns.withColumns(
        {
            "how": how,
            "k1": F.coalesce("p_id", "p_source", "p_target", F.lit(0).cast("bigint")),
            "k2": F.when(how == BY_PAIR, F.col("p_target")).otherwise(F.lit(0).cast("bigint")),
        }
    )


def keyed_links(links: DataFrame, hows: Iterable[int]) -> DataFrame:
    """Each link once per way a pattern may look for it, from a single scan."""
    zero = F.lit(0).cast("bigint")
    keys = {
        BY_NOTHING: (zero, zero),
        BY_ID: (F.col("id"), zero),
        BY_PAIR: (F.col("source"), F.col("target")),
        BY_SOURCE: (F.col("source"), zero),
        BY_TARGET: (F.col("target"), zero),
    }
    key = F.array(
        *[
            F.struct(F.lit(how).alias("how"), keys[how][0].alias("k1"), keys[how][1].alias("k2"))
            for how in hows
        ]
    )
    return links.select(*LINK_COLUMNS, F.inline(key))


def residual() -> Column:
    """Bound positions that the join key did not cover (only with an id bound)."""
    return (F.col("p_source").isNull() | (F.col("p_source") == F.col("source"))) & (
        F.col("p_target").isNull() | (F.col("p_target") == F.col("target"))
    )


def by_way(keyed: DataFrame, how: int) -> tuple[DataFrame, list[Column]]:
    """The patterns of one way, and the equalities that join links to them."""
    equal = {
        BY_ID: ["id"],
        BY_PAIR: ["source", "target"],
        BY_SOURCE: ["source"],
        BY_TARGET: ["target"],
    }
    return keyed.where(F.col("how") == how), [F.col(c) == F.col(f"p_{c}") for c in equal[how]]


def heavy_keys(links: DataFrame, keyed: DataFrame, block: int = BLOCK, often: int = OFTEN) -> DataFrame:
    """``(how, k1, k2, link_parts, asked_parts)`` of the keys with more than ``block`` squared matches.

    AQE sizes tasks by the bytes they read, which say nothing of what these keys give out.
    An id names one link, so patterns with an id have none.
    """
    ways = [BY_PAIR, BY_SOURCE, BY_TARGET]
    asked = stored(
        keyed.where(F.col("how").isin(ways)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_asked")).where(F.col("n_asked") >= often),
        "asked-often",
    )
    matched = (
        keyed_links(links, ways).join(sized(asked, is_small(asked)), KEY)
        .groupBy(*KEY, "n_asked").agg(F.count(F.lit(1)).alias("n_links"))
    )

    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / block).alias(n.replace("n_links", "link_parts").replace("n_asked", "asked_parts"))

    heavy = matched.where(F.col("n_asked").cast("double") * F.col("n_links") > float(block) ** 2)
    return stored(heavy.select(*KEY, parts("n_links"), parts("n_asked")), "heavy-keys")


def _shuffled(links: DataFrame, keyed: DataFrame, how: int) -> DataFrame:
    asked, equal = by_way(keyed, how)
    return links.join(asked.hint("merge"), equal)


def _dealt(links: DataFrame, keyed: DataFrame, how: int, heavy: DataFrame, blocks: int) -> DataFrame:
    """As ``_shuffled``, with the matches of ``heavy`` keys (of ``heavy_keys``) dealt over ``blocks``.

    The blocks' shuffles have a fixed number of parts, which AQE doesn't merge by their bytes.
    """
    asked, equal = by_way(keyed, how)
    names = {BY_PAIR: ["source", "target"], BY_SOURCE: ["source"], BY_TARGET: ["target"]}[how]
    # At most one row for each block's worth of matches given out.
    cut = F.broadcast(
        heavy.where(F.col("how") == how).select(*[F.col(k).alias(f"h_{c}") for k, c in zip(KEY[1:], names)], "link_parts", "asked_parts")
    )
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 64)

    def same(prefix: str) -> list[Column]:
        return [F.col(f"{prefix}{c}") == F.col(f"h_{c}") for c in names]

    def block(rows: DataFrame, prefix: str, own: str, other: str, columns: list[str]) -> DataFrame:
        part = F.pmod(F.xxhash64(*columns), F.col(f"{own}_parts")).alias(f"{prefix}{own}_part")
        copies = F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_parts") - 1)
        marked = rows.join(cut, same(prefix)).select(*rows.columns, part, F.explode(copies).alias(f"{prefix}{other}_part"))
        return marked.repartition(parts, *[f"{prefix}{c}" for c in [*names, "link_part", "asked_part"]])

    left = block(links, "", "link", "asked", LINK_COLUMNS)
    right = block(asked, "p_", "asked", "link", ["pid", *PATTERN_COLUMNS])
    places = [F.col(c) == F.col(f"p_{c}") for c in [*names, "link_part", "asked_part"]]
    rest = _shuffled(links.join(cut, same(""), "left_anti"), keyed.join(cut, same("p_"), "left_anti"), how)
    return left.join(right.hint("merge"), places).select(*rest.columns).unionByName(rest)


def match_patterns(
    links: DataFrame, patterns: DataFrame, allow_all: bool = False, small: bool | None = None
) -> DataFrame:
    """All ``(pid, id, source, target)`` with the link matching the pattern.

    ``p IS NULL OR p = column`` can only run as a nested loop. So every pattern is
    looked up by its most selective bound positions, an equality.

    * Few patterns (checked) are broadcast with one key each, and a single scan
      probes each link once per way: no shuffle, and a hub is spread over the
      scan tasks.
    * Many patterns are joined by shuffle, one join per way, which keeps the
      shuffled rows narrow and leaves AQE free to split a hub on either side.
      Keys with very many matches are dealt over blocks by these, see ``heavy_keys``.

    A pattern with every position ANY pairs with the whole table. It is refused
    unless ``allow_all`` is set, and is never dropped silently; with it, any number of
    such patterns is answered, each with a copy of the table.
    """
    unbound = F.coalesce(*PATTERN_COLUMNS).isNull()
    n, n_any = patterns.agg(F.count(F.lit(1)), F.count_if(unbound)).first()
    if n_any and not allow_all:
        raise ValueError(f"{n_any} patterns match every link; see allow_all")
    keyed = keyed_patterns(patterns)

    def probed(ways: list[int]) -> DataFrame:
        asked = F.broadcast(keyed.where(F.col("how").isin(ways)))
        return keyed_links(links, ways).join(asked, KEY).where(residual())

    ways = [BY_ID, BY_PAIR, BY_SOURCE, BY_TARGET]
    few = n <= BROADCAST_ROWS if small is None else small
    if few:
        parts = [probed([*ways, BY_NOTHING] if n_any else ways)]
    else:
        # Only the ways that are asked for; each is a shuffled join, not one that
        # the planner may turn into a broadcast again.
        keyed = stored(keyed, "keyed-patterns")
        asked = [r.how for r in keyed.groupBy("how").count().collect()]
        heavy = heavy_keys(links, keyed)
        per_way = heavy.groupBy("how").agg(F.sum(F.col("link_parts") * F.col("asked_parts")).alias("blocks"))
        blocks = {r.how: r.blocks for r in per_way.collect()}
        parts = [
            (_dealt(links, keyed, how, heavy, blocks[how]) if how in blocks else _shuffled(links, keyed, how)).where(residual())
            for how in ways if how in asked or how == ways[0]
        ]
        if n_any:
            everything = keyed.where(F.col("how") == BY_NOTHING)
            parts.append(links.crossJoin(sized(everything, n_any <= BROADCAST_ROWS)))
    return reduce(DataFrame.unionByName, [p.select("pid", *LINK_COLUMNS) for p in parts])
