"""A Merkle manifest of a dataset, with one proof for every row, by octopus multiproofs.

Rows are leaves of a tree per group, in order; the groups' roots are the leaves of one
more tree, built by the same steps. ``Tree`` does one such level:

* Leaves are range-partitioned by (tree, order) and written; a partition and its
  counts give every leaf its position, without a window over all rows.
* Each partition hashes what lies wholly inside it and publishes only its maximal
  nodes, some two per level. Nodes that span partitions are made of these, ten levels
  a round, in groups of at most a few thousand rows.
* For all its leaves together a partition lacks few nodes: siblings of the path along
  its two edges. Their coordinates follow from its range; they are fetched once, what
  lies between is derived, and each leaf's own proof is cut out of it in place.

Nodes are raw digests of 32 bytes on the way; hashing takes them as lower-case hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm.components import stored

PART_ROWS = 50_000
ROUND = 10  # levels that one round of joining partitions' nodes climbs
NODE = "tree string, level int, idx bigint, hash binary"


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of the concatenated fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def join_hash(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def level_sizes(n: int) -> list[int]:
    """Nodes at each level above ``n`` leaves; the last is one."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    return sizes


def lift(nodes: dict[tuple[int, int], bytes], sizes: list[int], low: int, high: int) -> dict:
    """All parents up to level ``high`` whose children are known, ``nodes`` included."""
    known = dict(nodes)
    row = {i for level, i in known if level == low}
    for level in range(low, min(high, len(sizes) - 1)):
        row |= {i for at, i in nodes if at == level}
        above = set()
        for i in {i >> 1 for i in row}:
            pair = [(level, c) for c in (2 * i, 2 * i + 1) if c < sizes[level]]
            if (level + 1, i) not in known and all(c in known for c in pair):
                known[level + 1, i] = join_hash(*[known[c] for c in pair])
            if (level + 1, i) in known:
                above.add(i)
        row = above
    return known


def covered(start: int, end: int, n: int) -> Iterator[tuple[int, int, int]]:
    """``(level, first, last)``: the nodes that leaves ``start`` to ``end - 1`` make up alone, ``last`` exclusive."""
    for level, size in enumerate(level_sizes(n)):
        first = -(-start >> level)
        last = size if end == n else end >> level
        if first >= last:
            return
        yield level, first, last


def maximal(start: int, end: int, n: int) -> list[tuple[int, int]]:
    """Nodes inside a range whose parents are not: what a partition publishes."""
    inside = list(covered(start, end, n))
    out = []
    for k, (level, first, last) in enumerate(inside):
        if k + 1 < len(inside):
            _, up, down = inside[k + 1]
            # At most one node before the first whole parent and one behind the last.
            edge = [i for i in (first, last - 1) if not up <= i >> 1 < down]
        else:
            edge = range(first, last)
        out += [(level, i) for i in dict.fromkeys(edge)]
    return out


def missing(start: int, end: int, n: int) -> list[tuple[int, int]]:
    """The fewest nodes outside a range that prove all its leaves together."""
    out = []
    low, high = start, end - 1
    for level, size in enumerate(level_sizes(n)[:-1]):
        if low & 1:
            out.append((level, low - 1))
        if not high & 1 and high + 1 < size:
            out.append((level, high + 1))
        low, high = low >> 1, high >> 1
    return out


def climb(leaves: list[bytes], start: int, n: int, fetched: dict[tuple[int, int], bytes]) -> list[dict[int, bytes]]:
    """All nodes that ``leaves`` and the nodes ``fetched`` from elsewhere make up, by level."""
    sizes, levels = level_sizes(n), [dict(enumerate(leaves, start))]
    for level, size in enumerate(sizes[:-1]):
        row = levels[-1]
        row |= {i: h for (at, i), h in fetched.items() if at == level}
        above = {}
        for i, own in row.items():
            if i & 1:
                continue
            if i + 1 == size:
                above[i >> 1] = join_hash(own)
            elif i + 1 in row:
                above[i >> 1] = join_hash(own, row[i + 1])
        levels.append(above)
    return levels


def _joined(low: int, high: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def combine(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        given = {(int(a), int(i)): bytes(h) for a, i, h in zip(frame["level"], frame["idx"], frame["hash"])}
        n = int(frame["n"].iloc[0])
        made = lift(given, level_sizes(n), low, high)
        return pd.DataFrame(
            [(key[0], a, i, h, n) for (a, i), h in made.items() if (a, i) not in given],
            columns=["tree", "level", "idx", "hash", "n"],
        )

    return combine


class Tree:
    """One tree for each value of ``tree`` over rows ``(tree, order.., hash, ..)``.

    ``order`` names the columns that order the leaves, nulls first; rows that agree in
    all of them are in any order. Further columns are carried along.
    """

    def __init__(self, rows: DataFrame, order: list[str], part_rows: int = PART_ROWS):
        spark = rows.sparkSession
        self.columns, count = rows.columns, rows.count()
        parts = max(count // part_rows + 1, min(count // 1000 + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        # Equal rows are told apart by where they stood, so that they need not share a part.
        by = [F.col(c).asc_nulls_first() for c in ["tree", *order, "turn"]]
        placed = stored(
            rows.withColumn("turn", F.monotonically_increasing_id())
            .repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()),
            "leaves",
        )
        counted = placed.groupBy("tree", "part").agg(F.count("*").alias("n_here"))
        whole = Window.partitionBy("tree")
        before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        self.parts = stored(
            counted.withColumn("start", F.coalesce(F.sum("n_here").over(before), F.lit(0)))
            .withColumn("n", F.sum("n_here").over(whole)),
            "parts",
        )
        nth = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*by))
        where = self.parts.select(F.col("tree").alias("of"), F.col("part").alias("at"), "start", "n")
        self.leaves = (
            placed.withColumn("nth", nth)
            .join(where, placed["tree"].eqNullSafe(where["of"]) & (placed["part"] == where["at"]))
            .select(*self.columns, "part", (F.col("start") + F.col("nth") - 1).alias("pos"), "n")
        )
        self.nodes = self._nodes()

    def _nodes(self) -> DataFrame:
        """Every node that lies in no single partition alone, and the partitions' maximal ones."""

        def publish(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("pos")
            start, n = int(frame["pos"].iloc[0]), int(frame["n"].iloc[0])
            levels = climb(list(map(bytes, frame["hash"])), start, n, {})
            return pd.DataFrame(
                [(key[0], level, i, levels[level][i], n) for level, i in maximal(start, start + len(frame), n)],
                columns=["tree", "level", "idx", "hash", "n"],
            )

        keyed = self.leaves.select("tree", "part", "pos", "hash", "n")
        told = stored(keyed.groupBy("tree", "part").applyInPandas(publish, f"{NODE}, n bigint"), "published")
        depth = len(level_sizes(told.agg(F.max("n")).first()[0] or 0)) - 1
        nodes, tops = told.drop("n"), None
        for low in range(0, depth, ROUND):
            high = low + ROUND
            here = told.where((F.col("level") >= low) & (F.col("level") < high))
            here = here if tops is None else here.unionByName(tops)
            # A block holds what lies below one node of level ``high``.
            block = F.expr(f"shiftright(idx, {high} - level)").alias("block")
            made = here.groupBy("tree", block).applyInPandas(_joined(low, high), f"{NODE}, n bigint")
            made = stored(made, "combined")
            nodes, tops = nodes.unionByName(made.drop("n")), made.where(F.col("level") == high)
        return nodes

    def roots(self) -> DataFrame:
        """``(tree, root)``; a lone leaf is its own root."""
        top = F.udf(lambda n: len(level_sizes(n)) - 1, "int")
        of = self.parts.select("tree", "n").distinct().select(F.col("tree").alias("of"), top("n").alias("top"))
        return self.nodes.join(of, F.col("tree").eqNullSafe(F.col("of")) & (F.col("level") == F.col("top"))).select(
            "tree", F.col("hash").alias("root")
        )

    def proofs(self) -> DataFrame:
        """The rows with ``proof`` (siblings from the leaf upwards, 32 bytes each) and ``sides``.

        ``sides`` has a letter per level: where the sibling stands, ``l`` or ``r``, or ``-``
        for a node without one.
        """

        @F.udf("array<struct<level:int,idx:bigint>>")
        def wanted(start: int, count: int, n: int) -> list:
            return missing(start, start + count, n)

        asked = self.parts.select("tree", "part", F.explode(wanted("start", "n_here", "n")).alias("at"))
        asked = asked.select(F.col("tree").alias("of"), "part", "at.level", "at.idx")
        nodes = self.nodes
        same = asked["of"].eqNullSafe(nodes["tree"]) & (asked["level"] == nodes["level"]) & (asked["idx"] == nodes["idx"])
        met = asked.join(nodes, same).select("of", asked["part"].alias("at"), F.struct(nodes["level"], nodes["idx"], "hash").alias("node"))
        # At most two nodes a level.
        fetched = stored(met.groupBy("of", "at").agg(F.collect_list("node").alias("fetched")), "fetched")
        leaves, columns = self.leaves, self.columns
        rows = leaves.join(fetched, leaves["tree"].eqNullSafe(fetched["of"]) & (leaves["part"] == fetched["at"]), "left")
        rows = rows.select(leaves["*"], "fetched")

        def expand(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            start, n, given = table["pos"][0].as_py(), table["n"][0].as_py(), table["fetched"][0].as_py()
            levels = climb(table["hash"].to_pylist(), start, n, {(x["level"], x["idx"]): x["hash"] for x in given or []})
            sizes, end = level_sizes(n), start + len(table)
            # What neighbours share above them is put together once.
            above = {0: (b"", "")}
            for level in range(len(sizes) - 2, -1, -1):
                fresh = {}
                for i in range(start >> level, (end - 1 >> level) + 1):
                    proof, sides = above[i >> 1]
                    if i ^ 1 < sizes[level]:
                        fresh[i] = (levels[level][i ^ 1] + proof, ("l" if i & 1 else "r") + sides)
                    else:
                        fresh[i] = (proof, "-" + sides)
                above = fresh
            made = [above[i] for i in range(start, end)]
            table = table.select(columns)
            table = table.append_column("proof", pa.array([p for p, _ in made], pa.binary()))
            return table.append_column("sides", pa.array([s for _, s in made], pa.string()))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
        return rows.groupBy("tree", "part").applyInArrow(expand, f"{schema}, proof binary, sides string")


def folded(digest: bytes, proof: bytes, sides: str) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for side in sides:
        if side == "-":
            digest = join_hash(digest)
            continue
        other, at = proof[at : at + 32], at + 32
        digest = join_hash(other, digest) if side == "l" else join_hash(digest, other)
    return digest


def fold(digest: Column, proof: Column, sides: Column) -> Column:
    """``folded`` for each row."""

    @F.pandas_udf("binary")
    def climbed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([folded(bytes(a), bytes(b), c) for a, b, c in zip(*rows)], dtype=object)

    return climbed(digest, proof, sides)


def manifest(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``(doc_id, lang, leaf, claimed, subroot, root, proof, sides)`` for each row of ``docs (doc_id, source, lang, n_chars, text[, claim])``.

    A leaf is the digest of the five columns; nulls count as such. Leaves of one
    ``lang`` (null is one of its own) are in order of ``doc_id``, null first, then of
    digest; wholly repeated rows stand in any order. ``claimed`` is the digest of the
    row with ``claim`` for its ``n_chars``: what someone else says the row is. Other
    columns are ignored. Proofs lead from the leaf over the subroot to the root. No
    rows give no rows.
    """
    claim = F.col("claim") if "claim" in docs.columns else F.col("n_chars")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = docs.select(
        "doc_id",
        F.col("lang").alias("tree"),
        leaf(*columns).alias("hash"),
        leaf(*[claim if i == 3 else c for i, c in enumerate(columns)]).alias("claimed"),
    ).withColumn("leaf", F.col("hash"))
    by_lang = Tree(rows, ["doc_id", "leaf"], part_rows)
    subroots = stored(by_lang.roots(), "subroots").select(
        F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("hash")
    )
    langs = Tree(subroots, ["lang"], part_rows)
    root = langs.roots().first()
    upper = langs.proofs().select(
        F.col("lang").alias("of"), F.col("hash").alias("subroot"),
        F.col("proof").alias("upper"), F.col("sides").alias("upper_sides"),
    )
    upper = stored(upper.withColumn("root", F.lit(bytes(root["root"]) if root else None).cast("binary")), "upper")
    lower = by_lang.proofs()
    return lower.join(upper, lower["tree"].eqNullSafe(upper["of"])).select(
        "doc_id",
        F.col("tree").alias("lang"),
        "leaf",
        "claimed",
        "subroot",
        "root",
        F.concat("proof", "upper").alias("proof"),
        F.concat("sides", "upper_sides").alias("sides"),
    )
