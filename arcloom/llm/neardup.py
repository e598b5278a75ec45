"""Near copies of documents by weighted MinHash.

A document is the bag of its shingles (five consecutive words, all words for fewer).
BagMinHash: every shingle owns Poisson processes over its weight axis, cut into units
and grouped into blocks that double in width: [0, 1), [1, 2), [2, 4), ... A block's
points come in order of time; each falls on one register and one unit, and counts if
the document's weight covers that unit. A register keeps its earliest point. Two
documents keep the same point with a probability equal to their weighted Jaccard
likeness, sum of minima over sum of maxima. Processes stop as soon as they are later
than all registers, so the work is about one point per shingle.

Registers are cut into bands; documents that share a band are candidates, and every
candidate link is checked on the whole bags. A bucket's rows are first compared with a
few pivots, which joins most of what belongs together. Only buckets that still hold
several components are compared as a whole, component against component: in tiles of a
few hundred rows by one product of set matrices, which return a spanning forest of the
links they find and never list pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import keep_rows, same_row, texts, words
from arcloom.llm.components import components, join_roots, stored
from arcloom.operators.sizing import is_small, sized

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 40, 6  # at a likeness of 0.8 a link escapes all bands once in 190,000
TILE = 512  # rows of a bucket that are compared with as many others at once
SLICE = 4096  # shingles that such a comparison holds at once
LOT_ROWS = 2000  # about so many rows of tiles are handed to Python at once
# Bits that are turned before a bucket's lowest node is taken: one pivot each.
PIVOTS = (0, 0x5DEECE66D2F1A7B3, 0x2545F4914F6CDD1D)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _nth(n: int) -> np.uint64:
    return np.uint64(n * int(_ODD) % 2**64)


def shingle_hashes(word_hashes: np.ndarray, size: int = SHINGLE, at: np.ndarray | None = None) -> np.ndarray:
    """A hash for each run of ``size`` words, or those that start ``at`` some; one for a shorter text; none for no words."""
    h = np.asarray(word_hashes, np.int64).view(np.uint64)
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    out = np.zeros(n if at is None else len(at), np.uint64)
    for j in range(size):
        out = _mix((out + (h[j : j + n] if at is None else h[at + j])) * _ODD + np.uint64(j + 1))
    return out


def bag_min_hash(bags: list[np.ndarray], registers: int) -> np.ndarray:
    """One row of ``registers`` times for each bag of hashes (repeats are weight)."""
    hashes, weights = zip(*[np.unique(b, return_counts=True) for b in bags]) if bags else ((), ())
    doc = np.repeat(np.arange(len(bags)), [len(h) for h in hashes])
    hashes = np.concatenate(hashes) if bags else np.zeros(0, np.uint64)
    weights = np.concatenate(weights).astype(np.float64) if bags else np.zeros(0)
    # One process per block that the weight reaches into.
    parts, low, width, block = [], 0.0, 1.0, 0
    reach = np.arange(len(hashes))
    while len(reach):
        seed = _mix(hashes[reach] + _nth(block))
        parts.append((doc[reach], seed, np.full(len(reach), low), np.full(len(reach), width), weights[reach]))
        low, width, block = low + width, max(1.0, low + width), block + 1
        reach = reach[weights[reach] > low]
    times = np.full((len(bags), registers), np.inf)
    if not parts:
        return times
    doc, seed, low, width, weight = (np.concatenate(x) for x in zip(*parts))
    at = np.zeros(len(doc))
    flat, step = times.reshape(-1), 0
    while len(doc):
        step += 1
        chance = _mix(seed + _nth(2 * step))
        place = _mix(seed + _nth(2 * step + 1))
        at = at - np.log(((chance >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / width
        on = at < times.max(axis=1)[doc]
        doc, seed, low, width, weight, at, place = (x[on] for x in (doc, seed, low, width, weight, at, place))
        unit = low + np.floor((place >> np.uint64(32)) * 2.0**-32 * width)
        register = ((place & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
        hit = unit < weight
        np.minimum.at(flat, doc[hit] * registers + register[hit], at[hit])
    return times


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row of ``bag_min_hash``."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(rows):
        key = _mix((key + bits[:, :, j]) * _ODD)
    return key.view(np.int64)


def bag_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two sorted bags."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.minimum(n[i], m[j]).sum()
    total = len(a) + len(b) - shared
    return float(shared / total) if total else 1.0


def bag_set(bag: np.ndarray) -> np.ndarray:
    """A bag as a sorted set that tells repeats apart: minima of weights become an intersection."""
    bag = np.sort(bag)
    first = np.concatenate([np.ones(min(1, len(bag)), bool), bag[1:] != bag[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(bag)), 0))
    return np.sort(_mix(bag + (np.arange(len(bag)) - start).astype(np.uint64) * _ODD))


def set_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all elements of two sorted sets."""
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``, by products of 0/1 matrices."""
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    value = [np.concatenate(x) for x in (left, right)]
    # What one side lacks is shared by no pair.
    both = np.intersect1d(*value)
    at = [np.searchsorted(both, v) for v in value]
    known = [(k < len(both)) & (both[np.minimum(k, max(len(both) - 1, 0))] == v) if len(both) else np.zeros(len(v), bool) for k, v in zip(at, value)]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(both), SLICE):
        cut = []
        for side, n in enumerate((len(left), len(right))):
            here = known[side] & (at[side] >= low) & (at[side] < low + SLICE)
            held = np.zeros((n, SLICE), np.float32)
            held[row[side][here], at[side][here] - low] = 1
            cut.append(held)
        out += cut[0] @ cut[1].T
    return out


def _tile_links(least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between components within each tile of a lot, as few as join what hangs together."""

    def linked(main: int, x: int, y: int, root: np.ndarray, part: np.ndarray, is_main: np.ndarray, bags: list[np.ndarray]) -> np.ndarray:
        if main >= 0:
            left, right = np.flatnonzero(~is_main), np.flatnonzero(is_main)
        elif x == y:
            left = right = np.arange(len(root))
        else:
            left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
        if not len(left) or not len(right):
            return np.zeros((0, 2), np.int64)
        shared = shared_counts([bags[i] for i in left], [bags[i] for i in right])
        sizes = np.array([len(b) for b in bags], np.float64)
        total = sizes[left][:, None] + sizes[right][None] - shared
        alike = (shared / np.maximum(total, 1) >= least) & (root[left][:, None] != root[right][None])
        i, j = np.nonzero(alike)
        names, number = np.unique(root, return_inverse=True)
        low = join_roots(np.arange(len(names)), number[left[i]], number[right[j]])
        joined = np.flatnonzero(low != np.arange(len(names)))
        return np.stack([names[joined], names[low[joined]]], 1)

    def of_lot(frame: pd.DataFrame) -> pd.DataFrame:
        cell = frame[["key", "main", "x", "y"]].to_numpy(np.int64)
        order = np.lexsort(cell.T)
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)]))
        root, part, is_main = (frame[c].to_numpy()[order] for c in ("root", "part", "is_main"))
        bags = [frame["bag"].iloc[i] for i in order]
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(starts, [*starts[1:], len(cell)]):
            found.append(linked(*cell[a, 1:].tolist(), root[a:b], part[a:b], is_main[a:b], bags[a:b]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return of_lot


@dataclass(frozen=True)
class NearCopies:
    """How near copies are found. ``classes`` does the work."""

    shingle: int = SHINGLE
    likeness: float = LIKENESS
    bands: int = BANDS
    rows: int = ROWS

    def _bands(self, word_hashes: Column) -> Column:
        bands, rows, size = self.bands, self.rows, self.shingle

        @F.pandas_udf("array<bigint>")
        def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                out: list = []
                for at in range(0, len(batch), 512):
                    bags = [shingle_hashes(h, size) for h in batch.iloc[at : at + 512]]
                    made = band_keys(bag_min_hash(bags, bands * rows), bands, rows)
                    out += [m if len(b) else np.zeros(0, np.int64) for m, b in zip(made, bags)]
                yield pd.Series(out)

        return keys(word_hashes)

    def _bags(self, word_hashes: Column) -> Column:
        size = self.shingle

        @F.pandas_udf("array<bigint>")
        def bags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([bag_set(shingle_hashes(h, size)).view(np.int64) for h in batch])

        return bags(word_hashes)

    def _compare(self, pairs: DataFrame, bags: DataFrame) -> DataFrame:
        """Of distinct pairs ``(a, b)`` those alike enough."""

        @F.pandas_udf("double")
        def likeness(left: pd.Series, right: pd.Series) -> pd.Series:
            return pd.Series([set_likeness(x, y) for x, y in zip(left, right)], dtype=float)

        left, right = bags.toDF("a", "bag_a"), bags.toDF("b", "bag_b")
        both = pairs.join(left, "a").join(right, "b")
        return both.where(likeness("bag_a", "bag_b") >= self.likeness).select("a", "b")

    def _roots(self, buckets: DataFrame, bags: DataFrame) -> DataFrame:
        """``(node, root)`` of nodes that links join to others; ``buckets (key, node, pivots)``, ``bags (node, bag)``."""
        pivot = F.explode(F.array_distinct("pivots")).alias("pivot")
        pairs = buckets.select("node", pivot).where("node <> pivot")
        pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        roots = stored(components(stored(self._compare(pairs, bags), "links")), "roots")
        rows = stored(
            buckets.join(roots, "node", "left")
            .select("key", "node", F.coalesce("root", "node").alias("root"), F.get("pivots", 0).alias("pivot")),
            "rooted",
        )
        # Most of a bucket hangs on its pivot; ``others`` counts what does not.
        main = F.max(F.when(F.col("node") == F.col("pivot"), F.col("root")))
        held = rows.groupBy("key").agg(
            main.alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi"),
            F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print"),
        ).where("lo <> hi")
        # Bands of one group often hold the same rows: one of them is enough.
        held = stored(held.groupBy("print", "n", "lo", "hi").agg(F.min(F.struct("key", "main")).alias("x")).select("x.*"), "open")
        open_rows = rows.join(held, "key").withColumn("other", F.col("root") != F.col("main"))
        sizes = stored(
            open_rows.groupBy("key").agg(F.count_if("other").alias("n_other"), F.count_if(~F.col("other")).alias("n_main")),
            "open-sizes",
        )
        open_rows = open_rows.join(sizes, "key").select(
            "key", "node", "root", "other",
            F.ceil(F.col("n_other") / TILE).cast("int").alias("others"), F.ceil(F.col("n_main") / TILE).cast("int").alias("mains"),
        )
        # A row of the main component meets each part of the others; a row of these, each part of both.
        part = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains"))).cast("int")
        within = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(F.lit(-1).alias("main"), F.least(i, part).alias("x"), F.greatest(i, part).alias("y")))
        to_main = F.transform(
            F.when(F.col("mains") > 0, F.sequence(F.lit(0), F.col("mains") - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(i.alias("main"), part.alias("x"), F.lit(-1).alias("y")),
        )
        from_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(part.alias("main"), i.alias("x"), F.lit(-1).alias("y")))
        cells = F.when(F.col("other"), F.concat(within, to_main)).otherwise(from_main)
        copies = F.sum(F.expr("n_main * others + n_other * (others + mains)"))
        counted = sizes.withColumns({"others": F.ceil(F.col("n_other") / TILE), "mains": F.ceil(F.col("n_main") / TILE)})
        lots = (counted.agg(copies).first()[0] or 0) // LOT_ROWS + 1
        dealt = open_rows.select("key", "node", "root", (~F.col("other")).alias("is_main"), part.alias("part"), F.explode(cells).alias("cell"))
        lot = F.pmod(F.xxhash64("key", "cell"), F.lit(lots)).alias("lot")
        tiles = dealt.join(bags, "node").select(lot, "key", "cell.*", "root", "part", "is_main", "bag")
        more = stored(
            tiles.groupBy("lot").applyInPandas(_tile_links(self.likeness), "a bigint, b bigint").distinct(),
            "tile-links",
        )
        upper = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        below = roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        # Roots that no pivot joined to anything.
        alone = upper.join(roots, F.col("node") == upper["root"], "left_anti")
        return below.unionByName(alone.select(F.col("root").alias("node"), F.col("top").alias("root")))

    def classes(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, version, root, class_id, class_size, copies)`` for each row of ``docs (doc_id, text)``.

        ``root`` tells classes apart. ``class_id`` is the lowest ``doc_id`` among all rows that near-copy links join,
        directly or through others; ``class_size`` counts those rows, ``copies`` the
        rows of the same text. Equal texts are one class, without words too (null is
        an empty text); a text without words is alike to no other text. Ids may be
        null or repeated; a class of null ids only has a null ``class_id``.
        """
        # Texts are told apart by 128 bits.
        text = ["version", "check"]
        docs = texts(docs).withColumn("check", F.xxhash64(F.lit(1), "text"))
        hashed = docs.select("doc_id", *text, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
        signed = hashed.select("doc_id", *text, self._bands(F.col("h")).alias("keys"))
        # Written once, so that a node keeps its number.
        nodes = stored(
            signed.groupBy(*text).agg(F.min("doc_id").alias("lowest"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
            .withColumn("node", F.monotonically_increasing_id()),
            "nodes",
        )
        keyed = nodes.select("node", F.explode("keys").alias("key"))
        turned = [F.min(F.col("node").bitwiseXOR(F.lit(bits))).bitwiseXOR(F.lit(bits)) for bits in PIVOTS]
        shared = keyed.groupBy("key").agg(F.count("*").alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(turned)]).where("n > 1")
        shared = stored(shared.select("key", F.array(*[f"p{i}" for i in range(len(PIVOTS))]).alias("pivots")), "buckets")
        buckets = stored(keyed.join(shared, "key"), "bucket-rows")
        asked = nodes.select("node", *text).join(buckets.select("node").distinct(), "node", "left_semi")
        asked = stored(asked, "asked")
        bags = stored(
            hashed.join(sized(asked, is_small(asked)), text)
            .select("node", self._bags(F.col("h")).alias("bag"))
            .groupBy("node").agg(F.first("bag").alias("bag")),
            "bags",
        )
        roots = self._roots(buckets, bags)
        placed = stored(nodes.drop("keys").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        whole = placed.groupBy("root").agg(F.min("lowest").alias("class_id"), F.sum("copies").alias("class_size"))
        of_text = stored(placed.join(whole, "root").select(*text, "root", "class_id", "class_size", "copies"), "of-text")
        return docs.select("doc_id", *text).join(of_text, text).select(
            "doc_id", "version", "root", "class_id", "class_size", "copies"
        )

    def first_of_each(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` without near copies: of each class the row with the lowest
        ``doc_id`` (a null one before all; of several texts under it, the one whose hash
        is lowest). Of wholly repeated ids and texts, one row stays.
        """
        found = self.classes(docs)
        first = found.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("first")).select("first.*")
        times = found.groupBy("doc_id", "version").agg(F.count("*").alias("times"))
        first = stored(
            first.join(times, same_row(first, times)).select(first["doc_id"], first["version"], "times"), "first"
        )
        once = keep_rows(docs, first.where("times = 1"))
        # Rows that repeat id and text are told apart by nothing.
        again = keep_rows(docs, first.where("times > 1"))
        again = texts(again, carry=True).dropDuplicates(["doc_id", "version"]).select("row.*")
        return once.unionByName(again)
