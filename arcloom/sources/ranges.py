"""Versions of a link table that share what did not change.

The table is cut by id into ranges of fixed width; a range is a folder. A version lists
the folders it consists of and adds only those that its log touches, so a short log
costs the ranges of its ids, not the table. Layout below a root folder::

    v=3/range=17/       links 17 * width to 18 * width - 1, as version 3 left them
    index/v=3/          one row per range that is not empty: who wrote it, how many links
    ranged/             one small row per published version

Ids are given out densely from a counter and are unique, so a range holds at most
``width`` links and none can grow hot. As with ``LinkStore``, a version counts once its
row is there, nothing is changed in place, and one writer at a time is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.functions.patterns import Pattern, normalise
from arcloom.operators.commands import applied, highest_birth, log_effect, stored
from arcloom.operators.reads import each
from arcloom.operators.sizing import is_small, sized
from arcloom.schema import LINK, LINK_COLUMNS

WIDTH = 1 << 22
LINK_AND_RANGE = T.StructType([*LINK.fields, T.StructField("range", T.LongType())])
INDEX = "range bigint, written bigint, n bigint"
VERSIONS = "version bigint, n_links bigint, next_id bigint, width bigint"


@dataclass(frozen=True)
class RangedVersion:
    version: int
    n_links: int
    next_id: int
    width: int


class RangedLinks:
    """Versioned link table below ``root`` whose versions share untouched id ranges."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self) -> DataFrame:
        """All published versions."""
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.root}/ranged")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], VERSIONS)

    def version(self, version: int | None = None) -> RangedVersion:
        """One published version, the latest by default."""
        rows = self.versions()
        if version is not None:
            rows = rows.where(F.col("version") == version)
        row = rows.orderBy(F.desc("version")).first()
        if row is None:
            raise LookupError(f"no published version {'' if version is None else version}")
        return RangedVersion(*row)

    def index(self, version: int | None = None) -> DataFrame:
        """The ranges of a version, which version wrote each, and their numbers of links."""
        return self.spark.read.schema(INDEX).parquet(f"{self.root}/index/v={self.version(version).version}")

    def create(self, links: DataFrame, width: int = WIDTH) -> RangedVersion:
        """Publish ``links`` as the first version, cut into ranges of ``width`` ids."""
        if self.versions().head(1):
            raise ValueError(f"{self.root} already holds a table")
        top = self._write(links, 1, width)
        return self._publish(RangedVersion(1, 0, top + 1, width), self._written(1))

    def read(self, version: int | None = None) -> DataFrame:
        """All links of a version."""
        return self._read(self.index(version))

    def each(self, pattern: Pattern = (), version: int | None = None) -> DataFrame:
        """Links that match one pattern; one with an id reads that id's range alone."""
        index, p_id = self.index(version), normalise(pattern)[0]
        if p_id is not None:
            index = index.where(F.col("range") == F.lit(p_id // self.version(version).width))
        return each(self._read(index), pattern)

    def apply(self, commands: DataFrame, parts: int | None = None) -> RangedVersion:
        """Fold a command log into the latest version and publish the result.

        Reads and writes only ranges that hold an id of the log; ranges left empty drop
        out of the index. Ids the log creates count as given out, also those that it
        deletes again.
        """
        last = self.version()
        effect = stored(log_effect(commands, parts), "effect")
        touched = stored(effect.select(_range(last.width).alias("range")).distinct(), "touched")
        number, index = last.version + 1, self.index()
        few = is_small(touched)
        base = self._read(index.join(sized(touched, few), "range", "left_semi"))
        self._write(applied(effect, base), number, last.width)
        kept = index.join(sized(touched, few), "range", "left_anti")
        fresh = RangedVersion(number, 0, max(last.next_id, highest_birth(effect) + 1), last.width)
        return self._publish(fresh, kept.unionByName(self._written(number)))

    def _read(self, index: DataFrame) -> DataFrame:
        # One row per range, at most ids / width: the list of files a driver plans with anyway.
        paths = [f"{self.root}/v={r.written}/range={r.range}" for r in index.select("range", "written").collect()]
        if not paths:
            return self.spark.createDataFrame([], LINK)
        return self.spark.read.schema(LINK).parquet(*paths)

    def _write(self, links: DataFrame, number: int, width: int) -> int:
        """Write ``links`` by range; the highest id, gathered by the write."""
        seen = Observation()
        # Behind the shuffle by range each range is one task's, so a range is one file.
        ranged = links.select(*LINK_COLUMNS, _range(width).alias("range")).repartition("range")
        top = F.coalesce(F.max("id"), F.lit(0)).alias("top")
        ranged.sortWithinPartitions("range", "id").observe(seen, top).write.mode("overwrite").partitionBy(
            "range"
        ).parquet(f"{self.root}/v={number}")
        return seen.get["top"]

    def _written(self, number: int) -> DataFrame:
        """The index rows of what a version wrote, from the parquet footers' row counts."""
        made = self.spark.read.schema(LINK_AND_RANGE).parquet(f"{self.root}/v={number}")
        return made.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
            "range", F.lit(number).cast("bigint").alias("written"), "n"
        )

    def _publish(self, made: RangedVersion, index: DataFrame) -> RangedVersion:
        seen = Observation()
        counted = index.coalesce(1).observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{self.root}/index/v={made.version}")
        made = RangedVersion(made.version, seen.get["n"], made.next_id, made.width)
        row = self.spark.createDataFrame([(made.version, made.n_links, made.next_id, made.width)], VERSIONS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/ranged")
        return made


def _range(width: int) -> Column:
    return F.expr(f"(id - pmod(id, {width}L)) div {width}L")
