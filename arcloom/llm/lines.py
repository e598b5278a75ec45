"""Lines that many documents share, found by probing a minimal perfect hash.

Each line's key is hashed twice (128 bits in all). The keys found in at least
``min_docs`` documents are counted with map-side sums and dealt into shards by hash.
Every shard becomes a minimal perfect hash: levels of bit arrays give each key its
own place in an array of 64-bit fingerprints and one of counts. Documents probe these
arrays; a key that was never stored meets a foreign fingerprint and is told apart.

Arrays of at most ``broadcast_bytes`` in all (measured, not guessed) are broadcast.
Beyond that, the keys of the documents travel to their shards instead, hot shards
being salted by rows, and the hits travel back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import lower_ascii, same_row, texts
from arcloom.session import scratch_path

# Stripped at both ends of a line. (Fixed by contract.)
BLANK = " \t\n\v\f\r"
SHARD_KEYS = 200_000
ROOM = 2.0  # bits per key at each level
INDEX = "shard int, n bigint, levels array<binary>, prints binary, counts binary"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANK)))


def _hash(line: Column) -> Column:
    """``(h, f)``: place and fingerprint; null for a line whose key is empty.

    The fingerprint hashes the key from another seed, so that it is no function of the place.
    """
    key = line_key(line)
    both = F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("f"))
    return F.when(key != "", both)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash for each level."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """The arrays of one shard: place of a key, its fingerprint, its count.

    Keys whose first hashes are equal cannot be told apart by place; such keys (about
    none in 2**32) stand at the end and are looked up by their fingerprint alone.
    """

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        self.before = []
        total = 0
        for bits in levels:
            upto = np.concatenate(([0], np.cumsum(bits)))
            self.before.append(total + upto)
            total += int(upto[-1])

    @staticmethod
    def build(h: np.ndarray, f: np.ndarray, counts: np.ndarray) -> PerfectHash:
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        left, aside = np.flatnonzero(times[back] == 1), np.flatnonzero(times[back] > 1)
        levels, order = [], []
        while len(left):
            size = int(len(left) * ROOM) // 64 * 64 + 64
            at = (_mix(h[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            mine = alone[at]
            levels.append(alone)
            order.append(left[mine][np.argsort(at[mine])])
            left = left[~mine]
        order = np.concatenate([*order, aside])
        return PerfectHash(levels, f[order], counts[order].astype(np.uint32))

    def count(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The stored count of each key, 0 for keys not stored."""
        out = np.zeros(len(h), np.int64)
        left = np.arange(len(h))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(h[left], level) % np.uint64(len(bits))).astype(np.int64)
            placed = bits[at]
            rank = self.before[level][at[placed]]
            here = left[placed]
            out[here] = np.where(self.prints[rank] == f[here], self.counts[rank], 0)
            left = left[~placed]
        rest = int(self.before[-1][-1]) if self.levels else 0
        if rest < len(self.prints):
            extra = dict(zip(self.prints[rest:].tolist(), self.counts[rest:].tolist()))
            for i in np.flatnonzero((out == 0) & np.isin(f, self.prints[rest:])).tolist():
                out[i] = extra[int(f[i])]
        return out

    def to_row(self, shard: int) -> dict:
        return {
            "shard": shard,
            "n": len(self.prints),
            "levels": [np.packbits(b).tobytes() for b in self.levels],
            "prints": self.prints.tobytes(),
            "counts": self.counts.tobytes(),
        }

    @staticmethod
    def from_row(row) -> PerfectHash:
        levels = [np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for b in row["levels"]]
        return PerfectHash(
            levels, np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32)
        )


def _build_shard(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    keys = keys.sort_values(["h", "f"])
    made = PerfectHash.build(
        keys["h"].to_numpy().view(np.uint64), keys["f"].to_numpy().view(np.uint64), keys["n"].to_numpy()
    )
    return pd.DataFrame([made.to_row(int(key[0]))])


def _shard(h: Column, shards: int) -> Column:
    # The high bits: the low ones choose the place within a shard.
    return F.pmod(F.shiftright(h, 32), F.lit(shards)).cast("int")


def _line_hashes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``keys``: one hash pair for each line, null for blank lines."""
    return docs.withColumn("keys", F.transform(split_lines(F.col("text")), _hash))


def line_index(docs: DataFrame, min_docs: int = 10, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The stored arrays over keys found in at least ``min_docs`` rows of ``docs``, and their shards.

    Every row of ``docs (.., text)`` counts as a document, repeated rows too.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "line-keys")
    (
        _line_hashes(docs)
        .select(F.explode(F.array_distinct("keys")).alias("key"))
        .where("key is not null")
        .groupBy("key.h", "key.f")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_docs)
        .write.parquet(path)
    )
    keys = spark.read.parquet(path)
    shards = keys.count() // shard_keys + 1
    index = (
        keys.withColumn("shard", _shard(F.col("h"), shards))
        .groupBy("shard")
        .applyInPandas(_build_shard, INDEX)
    )
    stored = scratch_path(spark, "line-index")
    index.write.parquet(stored)
    return spark.read.parquet(stored), shards


def _flags(parts: dict[int, PerfectHash], shards: int, h: np.ndarray, f: np.ndarray) -> np.ndarray:
    found = np.zeros(len(h), bool)
    shard = ((h.view(np.int64) >> 32) % shards).astype(np.int64)
    for s, part in parts.items():
        mine = np.flatnonzero(shard == s)
        found[mine] = part.count(h[mine], f[mine]) > 0
    return found


def _probe_broadcast(docs: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    rows = index.collect()
    shared = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])
    held: dict[str, dict[int, PerfectHash]] = {}

    @F.pandas_udf("array<boolean>")
    def flags(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        parts = held.setdefault("parts", {r["shard"]: PerfectHash.from_row(r) for r in shared.value})
        for hs, fs in batches:
            if not len(hs):
                yield pd.Series([], dtype=object)
                continue
            ends = np.cumsum([len(x) for x in hs])
            h = np.concatenate(hs.to_list()).astype(np.int64).view(np.uint64)
            f = np.concatenate(fs.to_list()).astype(np.int64).view(np.uint64)
            yield pd.Series(np.split(_flags(parts, shards, h, f), ends[:-1]))

    # A blank line has no key: its hashes are passed as 0 and its flag is not used.
    part = lambda name: F.transform("keys", lambda k: F.coalesce(k[name], F.lit(0)))
    return docs.withColumn("hit", flags(part("h"), part("f")))


def _probe_routed(docs: DataFrame, index: DataFrame, shards: int, task_rows: int = 500_000) -> DataFrame:
    """The keys of the documents go to their shard, the hits come back by document."""
    lines = (
        docs.select("doc_id", "version", F.explode(F.array_distinct("keys")).alias("key"))
        .where("key is not null")
        .select("doc_id", "version", "key.h", "key.f")
        .withColumn("shard", _shard(F.col("h"), shards))
    )
    # One row per shard: how many parts its rows are cut into.
    parts = lines.groupBy("shard").agg((F.count("*") / task_rows + 1).cast("int").alias("parts"))
    path = scratch_path(docs.sparkSession, "line-parts")
    parts.write.parquet(path)
    parts = docs.sparkSession.read.parquet(path)
    salt = F.pmod(F.xxhash64("doc_id", "version"), F.col("parts")).cast("int")
    asked = lines.join(parts, "shard").withColumn("salt", salt).drop("parts")
    arrays = index.join(parts, "shard").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )

    def probe(asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if arrays.empty or asked.empty:
            return asked[["doc_id", "version", "h", "f"]].iloc[:0]
        found = PerfectHash.from_row(arrays.iloc[0]).count(
            asked["h"].to_numpy().view(np.uint64), asked["f"].to_numpy().view(np.uint64)
        )
        return asked.loc[found > 0, ["doc_id", "version", "h", "f"]]

    hits = (
        asked.groupBy("shard", "salt")
        .cogroup(arrays.groupBy("shard", "salt"))
        .applyInPandas(probe, "doc_id bigint, version bigint, h bigint, f bigint")
        .groupBy("doc_id", "version")
        .agg(F.collect_set(F.struct("h", "f")).alias("hits"))
    )
    found = F.transform("keys", lambda k: F.coalesce(F.array_contains("hits", k), F.lit(False)))
    return (
        docs.alias("d").join(hits.alias("h"), same_row(docs, hits), "left")
        .select("d.*", "hits").withColumn("hit", found).drop("hits")
    )


def drop_shared_lines(
    docs: DataFrame,
    min_docs: int = 10,
    broadcast_bytes: int = 64 << 20,
    shard_keys: int = SHARD_KEYS,
    carry: bool = False,
) -> DataFrame:
    """``(doc_id, version, text, n_lines, n_dropped, kept)`` for each row of ``docs``.

    A text is cut at ``\\n``; a null or empty one is one empty line. A line's key is
    the line stripped of blanks and with A-Z lower-cased. Keys found in ``min_docs``
    or more documents lose all their lines; lines with an empty key always stay.
    Repeated rows are documents of their own and get equal results. With ``carry``, a
    column ``row`` holds the columns of ``docs``.
    """
    docs = _line_hashes(texts(docs, carry=carry))
    index, shards = line_index(docs, min_docs, shard_keys)
    size = F.length("prints") + F.length("counts") + F.aggregate(
        "levels", F.lit(0), lambda n, b: n + F.length(b)
    ) * F.lit(8)
    held = index.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    probe = _probe_broadcast if held <= broadcast_bytes else _probe_routed
    lines = split_lines(F.col("text"))
    drop = F.zip_with("keys", "hit", lambda k, hit: k.isNotNull() & hit)
    kept = F.filter(lines, lambda _, i: ~F.get("drop", i))
    return (
        probe(docs, index, shards)
        .withColumn("drop", drop)
        .select(
            "doc_id",
            "version",
            "text",
            F.size("drop").cast("long").alias("n_lines"),
            F.size(F.filter("drop", lambda d: d)).cast("long").alias("n_dropped"),
            F.array_join(kept, "\n").alias("kept"),
            *(["row"] if carry else []),
        )
    )
