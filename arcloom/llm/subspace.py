"""Near copies of embeddings by a pigeonhole join over blocks of rotated vectors.

Unit vectors ``u``, ``v`` have a cosine of at least ``c`` if their squared distance is at most
``2 - 2c``. A fixed rotation spreads every direction over all coordinates; these are
cut into blocks of ``BLOCK``. If two vectors are that close, then some block holds at most
its proportional share of the squared distance. So each block is range-joined by itself,
under its share, and what any block finds is verified on the whole vectors.

* A block's points are dealt into cells of a grid, a point into every cell that its box
  touches, so that two points within the block's radius meet in a cell. The grid has as
  many dimensions as the label's count asks for; a cell of more than ``CELL`` points is cut
  into tiles of pairs of parts.
* Points travel as whole vectors in 16-bit steps. Their distance in steps decides all but a
  thin shell around the threshold; pairs within the shell are decided by the vectors
  themselves, in double precision.
* Every pair is counted in one place only: the first block that holds its share, in the
  cell of the lower corner of their common box. So a task returns sums per point and
  a spanning forest of its links, never all pairs, and nothing has to be made distinct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm.components import components, join_roots, stored
from arcloom.operators.sizing import is_small, sized

COSINE = 0.98
BLOCK = 8
CELL = 4096
SIDE = 4  # a cell's side, in radii
TILE = 1024
STEP = 32767  # steps of one unit


def unit(vector) -> np.ndarray | None:
    """The vector at length one, in double precision; none if it has no direction."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    most = np.abs(v).max(initial=0)
    if not np.isfinite(most) or not most:
        return None
    v = v / most
    return v / np.sqrt(v @ v)


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix, the same wherever it is made."""
    made, upper = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return made * np.sign(np.diag(upper))


def block_starts(dim: int) -> list[int]:
    """Where blocks begin, and ``dim``."""
    return [*range(0, dim, BLOCK), dim]


def budgets(dim: int, cosine: float) -> tuple[np.ndarray, float, float]:
    """Each block's share of the squared distance, and between which totals the steps cannot tell; in squared steps.

    A coordinate is off by half a step and some rounding at most, a distance of ``d`` coordinates by ``sqrt(d)`` steps.
    """
    most = 2 - 2 * cosine
    width = np.diff(block_starts(dim))
    share = (np.sqrt(most * width / dim) * STEP + 1.01 * np.sqrt(width)) ** 2
    length, slack = np.sqrt(most) * STEP, 1.01 * np.sqrt(dim)
    return share, max(0.0, length - slack) ** 2, (length + slack) ** 2


def grid_dims(count: int, width: int, most: int = CELL) -> int:
    """How many coordinates of a block cut the grid, so that cells have about ``most`` points; about 0.6 stay per cut."""
    return int(min(width, max(0, np.ceil(np.log(max(count, 1) / most) / np.log(1 / 0.6)))))


def cells(points: np.ndarray, radius: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, cell)``: for each box of half a radius around a point all cells that it touches; ``cell`` has ``dims`` 16-bit numbers."""
    side = SIDE * radius
    # Cells are centred at 0, where most points are.
    low = np.floor((points[:, :dims] - radius / 2) / side + 0.5).astype(np.int16)
    high = np.floor((points[:, :dims] + radius / 2) / side + 0.5).astype(np.int16)
    rows, at = np.arange(len(points)), low
    for j in range(dims):
        over = np.flatnonzero(high[rows, j] > low[rows, j])
        again = at[over].copy()
        again[:, j] += 1
        rows, at = np.concatenate([rows, rows[over]]), np.concatenate([at, again])
    return rows, at


def link_tile(q: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, cell: np.ndarray,
              cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows ``left`` and ``right`` of ``q`` that this block and cell have to tell: linked ``(i, j)`` and unsure ``(i, j)``."""
    dim = q.shape[1]
    starts, (share, sure, most) = block_starts(dim), budgets(dim, cosine)
    x, y = q[left], q[right]

    def squared(cut: slice) -> np.ndarray:
        a, b = x[:, cut], y[:, cut]
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)

    near = squared(slice(starts[block], starts[block + 1])) <= share[block]
    near &= left[:, None] < right[None]
    total = squared(slice(0, dim)) if near.any() else None
    if total is not None:
        near &= total <= most
    for earlier in range(block if near.any() else 0):
        near &= squared(slice(starts[earlier], starts[earlier + 1])) > share[earlier]
    i, j = np.nonzero(near)
    if len(i) and len(cell):
        radius = np.sqrt(share[block])
        low = np.maximum(x[i, starts[block] :][:, : len(cell)], y[j, starts[block] :][:, : len(cell)]) - radius / 2
        here = (np.floor(low / (SIDE * radius) + 0.5) == cell).all(1)
        i, j = i[here], j[here]
    certain = total[i, j] <= sure if len(i) else np.zeros(0, bool)
    return left[i[certain]], right[j[certain]], left[i[~certain]], right[j[~certain]]


def _in_cell(cosine: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def told(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block, cell, part, other = key[:4]
        frame = frame.sort_values("node")
        q = np.stack([np.frombuffer(b, np.int16) for b in frame["q"]]).astype(np.float64)
        node, weight, own = (frame[c].to_numpy() for c in ("node", "n", "own"))
        cell, n = np.frombuffer(cell, np.int16), len(q)
        links, root, unsure = np.zeros(n, np.int64), np.arange(n), [np.zeros((0, 2), np.int64)]
        # A part with itself, or one part with another, where either may hold the lower row.
        first = np.flatnonzero(own == part)
        second = first if part == other else np.flatnonzero(own == other)
        for a in range(0, len(first), TILE):
            for b in range(a if part == other else 0, len(second), TILE):
                x, y = first[a : a + TILE], second[b : b + TILE]
                for left, right in [(x, y)] if part == other else [(x, y), (y, x)]:
                    i, j, k, m = link_tile(q, left, right, block, cell, cosine)
                    links += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
                    root = join_roots(root, i, j)
                    unsure.append(np.stack([node[k], node[m]], 1))
        has, pairs = np.flatnonzero(links), np.concatenate(unsure)
        return pd.DataFrame({
            "a": np.concatenate([node[has], pairs[:, 0]]),
            "b": np.concatenate([node[root[has]], pairs[:, 1]]),
            "n": np.concatenate([links[has], np.full(len(pairs), -1)]),
        })

    return told


def _units(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, digest, dim, u)``; no digest for a vector without direction or label."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("label").is_valid().to_pylist()
            vectors = batch.column("embedding").to_numpy(zero_copy_only=False)
            units = [unit(v) if k else None for v, k in zip(vectors, known)]
            raw = [None if u is None else u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in raw], pa.binary()),
                    pa.array([None if u is None else len(u) for u in units], pa.int32()),
                    pa.array(raw, pa.binary()),
                ],
                ["vec_id", "label", "digest", "dim", "u"],
            )

    rows = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(made, f"vec_id bigint, label {kind}, digest binary, dim int, u binary")


def _spread(nodes: DataFrame, cosine: float) -> DataFrame:
    """``nodes (label, dim, node, n, u, cut)`` into the cells of every block: ``(label, dim, block, cell, node, n, q)``."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cuts = batch.column("dim").to_numpy(), batch.column("cut").to_numpy()
            raw = batch.column("u").to_pylist()
            for dim, cut in sorted(set(zip(dims.tolist(), cuts.tolist()))):
                at = np.flatnonzero((dims == dim) & (cuts == cut))
                whole = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), dim)
                q = np.rint(whole @ rotation(dim) * STEP).astype(np.int16)
                steps = np.array([r.tobytes() for r in q], object)
                starts, (share, _, _) = block_starts(dim), budgets(dim, cosine)
                for block, radius in enumerate(np.sqrt(share)):
                    points = q[:, starts[block] : starts[block + 1]].astype(np.float64)
                    rows, cell = cells(points, radius, min(cut, points.shape[1]))
                    take = pa.array(at[rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("label").take(take),
                            batch.column("dim").take(take),
                            pa.array(np.full(len(rows), block, np.int32)),
                            pa.array([c.tobytes() for c in cell], pa.binary()),
                            batch.column("node").take(take),
                            batch.column("n").take(take),
                            pa.array(steps[rows], pa.binary()),
                        ],
                        ["label", "dim", "block", "cell", "node", "n", "q"],
                    )

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.mapInArrow(dealt, f"label {kind}, dim int, block int, cell binary, node bigint, n bigint, q binary")


@dataclass(frozen=True)
class NearVectors:
    """``cosine`` is the least likeness of a link, ``cell`` the points that a task compares with each other."""

    cosine: float = COSINE
    cell: int = CELL

    def classes(self, rows: DataFrame) -> DataFrame:
        """``(vec_id, n_links, component_id)`` for each row of ``rows (vec_id, embedding, label)``.

        ``n_links`` counts the other rows of the same label (not null) with a cosine of at least
        ``cosine``; ``component_id`` is the lowest ``vec_id`` that links reach, the row's own
        included. Vectors that are null, empty or zero, or hold a null or a number that
        is not finite, and rows without a label have no links; nor have vectors of
        different lengths. Repeated rows are rows of their own, linked like any others.
        Null ids count as rows; a component of null ids only has none. Other columns are ignored.
        """
        units = _units(rows)
        same = F.struct("label", "dim", "digest")
        kept = units.where("digest is not null")
        merged = kept.groupBy(same.alias("same")).agg(F.count("*").alias("n"), F.min("vec_id").alias("lowest"), F.first("u").alias("u"))
        # Written once, so that a node keeps its number.
        nodes = stored(merged.select("same.*", "n", "lowest", "u").withColumn("node", F.monotonically_increasing_id()), "nodes")
        counts = stored(nodes.groupBy("label", "dim").agg(F.count("*").alias("points")), "labels")
        few = is_small(counts)
        most, width = self.cell, BLOCK
        cut = F.udf(lambda points: grid_dims(points, width, most), "int")
        placed = nodes.join(sized(counts.withColumn("cut", cut("points")), few), ["label", "dim"])
        spread = _spread(placed.select("label", "dim", "node", "n", "u", "cut"), self.cosine)
        where = ["label", "dim", "block", "cell"]
        full = stored(
            spread.groupBy(where).agg(F.count("*").alias("held")).where(F.col("held") > most)
            .withColumn("parts", F.ceil(F.col("held") / most).cast("int")).drop("held"),
            "full-cells",
        )
        dealt = spread.join(sized(full, is_small(full)), where, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        dealt = dealt.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = dealt.select(
            "label", "dim", "block", "cell", "node", "n", "q", "own",
            F.least("own", "to").alias("part"), F.greatest("own", "to").alias("other"),
        )
        told = stored(
            asked.groupBy("block", "cell", "part", "other", "label", "dim")
            .applyInPandas(_in_cell(self.cosine), "a bigint, b bigint, n bigint"),
            "told",
        )
        sums = told.where("n > 0").select(F.col("a").alias("node"), "n")
        forest = told.where("n > 0 and a <> b").select("a", "b")
        sure = stored(self._decide(told.where("n < 0").select("a", "b"), nodes), "unsure")
        size = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
        size_a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
        more = sure.join(size, "b").join(size_a, "a")
        sums = sums.unionByName(more.select(F.col("a").alias("node"), F.col("n_b").alias("n"))).unionByName(
            more.select(F.col("b").alias("node"), F.col("n_a").alias("n"))
        )
        links = sums.groupBy("node").agg(F.sum("n").alias("others"))
        roots = components(forest.unionByName(sure.select("a", "b")))
        rooted = nodes.drop("u").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
        of = stored(
            rooted.join(links, "node", "left").join(lowest, "root")
            .select("label", "dim", "digest", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"),
            "vectors",
        )
        found = kept.select("vec_id", "label", "dim", "digest").join(of, ["label", "dim", "digest"]).select("vec_id", "n_links", "component_id")
        alone = units.where("digest is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return found.unionByName(alone)

    def _decide(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Of pairs within the shell around the threshold those that are linked."""

        @F.pandas_udf("double")
        def cosine(left: pd.Series, right: pd.Series) -> pd.Series:
            return pd.Series([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(left, right)], dtype=float)

        left, right = nodes.select(F.col("node").alias("a"), F.col("u").alias("u_a")), nodes.select(F.col("node").alias("b"), F.col("u").alias("u_b"))
        few = is_small(pairs)
        both = left.join(sized(pairs, few), "a")
        asked = stored(both.select("a", "b", "u_a"), "unsure-left")
        return right.join(sized(asked, few and is_small(asked, rows=50_000)), "b").where(cosine("u_a", "u_b") >= self.cosine).select("a", "b")

