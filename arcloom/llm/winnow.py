"""Document fingerprints by winnowing.

A text is taken as its words (runs of non-blank characters); of a word longer than
``LONG`` code points every code point is a unit of its own, but for the last ``LONG``.
Every ``gram`` consecutive units get their Karp-Rabin value, made from the values of
shorter runs, and of every ``window`` consecutive values the lowest is chosen, the
rightmost among equals. The chosen values with their positions are the fingerprint.
Whatever ``gram + window - 1`` consecutive units two texts share, they share a chosen
value for it, at positions that line up. Texts of at most ``SHORT`` code points, which
have too few words for that, are winnowed by their non-blank code points as well.

Everything is an expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm.common import texts
from arcloom.session import scratch_path

GRAM = 5
WINDOW = 4
# Values are taken modulo a Mersenne prime, so that products stay below 2**62.
PRIME = 2**31 - 1
BASE = 1_000_003
LONG = 24
# Half of a longer text holds ``GRAM + WINDOW - 1`` words of up to ``LONG`` code points.
SHORT = 2 * (GRAM + WINDOW - 1) * (LONG + 1)
# A word whole if it ends within LONG code points, else one code point.
UNIT = f"\\S{{1,{LONG}}}+(?!\\S)|\\S"


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """An array of ``(value << 31) | (2**31 - 1 - position)``, in order of position.

    Texts of fewer than ``gram`` units have one value for all of them; texts of fewer
    than ``window`` values have their lowest. An empty (or null) text, or one of
    blanks, has an empty fingerprint. Positions count units from 0; the code points of
    a short text count on from its words.
    """
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    signs = F.regexp_extract_all(text, F.lit("\\S"), F.lit(0))

    def both(units: Column) -> Column:
        short = F.when(F.char_length(text) <= SHORT, _winnowed(signs, F.size(units), gram, window))
        none = F.array().cast("array<bigint>")
        return F.concat(_winnowed(units, F.lit(0), gram, window), F.coalesce(short, none))

    return F.coalesce(_bound(units, both), F.array().cast("array<bigint>"))


def _bound(value: Column, step) -> Column:
    """``step(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def _beside(left: Column, right: Column, shift: int, join) -> Column:
    """``join(left[i], right[i + shift])`` for every ``i`` that has both."""
    n = F.least(F.size(left), F.size(right) - shift)
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + shift), n), join)


def _winnowed(units: Column, start: Column, gram: int, window: int) -> Column:
    """The chosen keys of a list of units, whose positions count from ``start``."""
    hashed = F.transform(units, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))

    def padded(a: Column, size: int, filler: int) -> Column:
        missing = F.greatest(F.lit(size) - F.size(a), F.lit(0))
        return F.concat(a, F.array_repeat(F.lit(filler).cast("bigint"), missing))

    def valued(runs: Column, h: Column, size: int) -> Column:
        """Values of ``gram`` units from those of ``size``: doubled while that fits, then one unit more."""
        if size == gram:
            return runs
        more, other = (size, runs) if 2 * size <= gram else (1, h)
        power = F.lit(pow(BASE, more, PRIME)).cast("bigint")
        longer = _beside(runs, other, size, lambda a, b: (a * power + b) % F.lit(PRIME))
        return _bound(longer, lambda r: valued(r, h, size + more))

    def lowest(keys: Column, size: int) -> Column:
        """Minima of ``window`` keys from those of ``size``, which may overlap."""
        if size == window:
            return keys
        more = min(size, window - size)
        return _bound(_beside(keys, keys, more, lambda a, b: F.least(a, b)), lambda k: lowest(k, size + more))

    def keyed(values: Column) -> Column:
        return F.transform(values, lambda v, i: F.shiftleft(v, 31) + (F.lit(PRIME) - start - i))

    chosen = _bound(
        padded(hashed, gram, 0),
        lambda h: _bound(padded(keyed(valued(h, h, 1)), window, 2**63 - 1), lambda k: F.array_distinct(lowest(k, 1))),
    )
    return F.when(F.size(units) > 0, chosen).otherwise(F.array().cast("array<bigint>"))


def values(prints: Column) -> Column:
    return F.transform(prints, lambda p: F.shiftright(p, 31).cast("int"))


def positions(prints: Column) -> Column:
    return F.transform(prints, lambda p: F.lit(PRIME) - F.pmod(p, F.lit(2**31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of values; 1 for two empty ones."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def followers(docs: DataFrame) -> DataFrame:
    """``(key, version, doc_id, n, next_key, next_version)`` for the distinct rows of ``docs (key, version, doc_id, n)``.

    Rows are in order of ``doc_id``, null first, then of ``version``; the first follows
    the last. The keys are range-partitioned and written, each partition is put in
    order by itself, and its last row is joined to the first of the next partition.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("version")]
    (
        docs.distinct()
        .repartitionByRange(parts, *order)
        .withColumn("part", F.spark_partition_id())
        .write.parquet(path)
    )
    rows = spark.read.parquet(path)
    after = F.lead(F.struct("key", "version")).over(Window.partitionBy("part").orderBy(*order))
    inside = rows.withColumn("next", after)
    # One row per partition.
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "version", "key")).alias("head"))
    turn = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(turn))
    heads = heads.select("part", F.struct(following["key"].alias("key"), following["version"].alias("version")).alias("head"))
    return inside.join(F.broadcast(heads), "part").withColumn("next", F.coalesce("next", "head")).select(
        "key", "version", "doc_id", "n", F.col("next.key").alias("next_key"), F.col("next.version").alias("next_version")
    )


def edited(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, edited, next_values)``: each text, and the same with its end replaced.

    The last ``floor(n / 2)`` of its ``n`` code points give way to as many of the
    first of the next document (to all, if it has fewer). ``next_values`` are the
    values of the next document's fingerprint. A single document follows itself; rows
    that agree in id and text follow the next other row.
    """
    spark = docs.sparkSession
    # Null ids share a key with an ordinary one, but no version.
    keyed = texts(docs).select(
        F.coalesce("doc_id", F.lit(0)).alias("key"),
        F.xxhash64("version", F.col("doc_id").isNull()).alias("version"),
        "doc_id",
        "text",
    )
    path = scratch_path(spark, "followers")
    followers(keyed.select("key", "version", "doc_id", F.char_length("text").alias("n"))).write.parquet(path)
    wanted = spark.read.parquet(path).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    # The same columns on both sides of the way, so that the texts are shuffled once.
    whole = keyed.select("key", "version", "text")
    given = (
        whole.withColumnsRenamed({"key": "next_key", "version": "next_version"})
        .join(wanted, ["next_key", "next_version"])
        .select(
            "key", "version", "doc_id", "half",
            F.substring("text", F.lit(1), F.col("half")).alias("start"),
            values(fingerprint(F.col("text"))).alias("next_values"),
        )
        .groupBy("key", "version")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "half", "start", "next_values")])
    )
    kept = F.substring("text", F.lit(1), F.char_length("text") - F.col("half"))
    return whole.join(given, ["key", "version"]).select(
        "doc_id", "text", F.concat(kept, "start").alias("edited"), "next_values"
    )
