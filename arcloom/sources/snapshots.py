"""Immutable versions of a link table, each with clustered copies.

Layout below a root folder::

    v=3/by_id  v=3/by_source  v=3/by_target      the links, ordered three ways
    v=3/by_curve                                 the links along a curve over both endpoints
    versions/                                    one small row per published version

A version counts once its row is in ``versions``; files of a write that failed
midway are never read. Nothing is changed in place, so a reader of version 3 is
not disturbed by the writer of version 4. One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.curve import morton
from arcloom.functions.patterns import Pattern, normalise
from arcloom.operators.commands import applied, highest_birth, log_effect, stored
from arcloom.operators.ids import allocate_ids
from arcloom.operators.reads import each
from arcloom.schema import LINK, LINK_COLUMNS

# The order of each copy. Endpoints are followed by the other columns, so that
# the range partitioning can cut a hub over many files, and so that within a hub
# the other endpoint is clustered too.
ORDERS: dict[str, Callable[[], list[Column]]] = {
    "by_id": lambda: [F.col("id")],
    "by_source": lambda: [F.col(c) for c in ("source", "target", "id")],
    "by_target": lambda: [F.col(c) for c in ("target", "source", "id")],
    # In place of the two above, at half their storage: of n files a pattern on one
    # endpoint meets about the square root of n, one on both endpoints a single one.
    "by_curve": lambda: [*morton(F.col("source"), F.col("target")), F.col("id")],
}
# The copies of a table that does not choose.
COPIES = ("by_id", "by_source", "by_target")

# ``label`` is free for the publisher, e.g. the last stream batch a version covers.
VERSIONS = "version bigint, n_links bigint, next_id bigint, copies array<string>, label bigint"


@dataclass(frozen=True)
class Version:
    version: int
    n_links: int
    next_id: int
    copies: tuple[str, ...]
    label: int | None = None


def choose_copy(pattern: Pattern, available: tuple[str, ...] = COPIES) -> str:
    """The copy on which a pattern reads least: by id, else source, else target, else along the curve."""
    p_id, p_source, p_target = normalise(pattern)
    wanted = []
    if p_id is None:
        if p_source is not None:
            wanted.append("by_source")
        if p_target is not None:
            wanted.append("by_target")
        if wanted:
            wanted.append("by_curve")
    return next((copy for copy in wanted if copy in available), "by_id")


def write_clustered(
    links: DataFrame, path: str, order: list[Column], partitions: int | None = None
) -> tuple[int, int]:
    """Links sorted by ``order`` across and within files, for row-group skipping; their number and highest id.

    Both are gathered by the write. They are observed behind the range partitioning,
    as what lies before it runs once more for its bounds.
    """
    ranged = (
        links.repartitionByRange(partitions, *order)
        if partitions
        else links.repartitionByRange(*order)
    )
    seen = Observation()
    made = ranged.sortWithinPartitions(*order).select(*LINK_COLUMNS)
    made = made.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made.write.mode("overwrite").parquet(path)
    return seen.get["n"], seen.get["top"]


def read_links(spark: SparkSession, *paths: str) -> DataFrame:
    """Links from parquet, with the fixed schema (nothing inferred)."""
    return spark.read.schema(LINK).parquet(*paths)


def file_bounds(links: DataFrame, copy: str) -> DataFrame:
    """The lowest and highest value of every column in each file ``links`` is read from.

    Combined within tasks, so a row per file and task is shuffled.
    """
    bounds = [f(c).alias(f"{c}_{n}") for c in LINK_COLUMNS for n, f in (("min", F.min), ("max", F.max))]
    return (
        links.groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count(F.lit(1)).alias("n"), *bounds)
        .withColumn("copy", F.lit(copy))
    )


class LinkStore:
    """Versioned link table below ``root``, a folder all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self) -> DataFrame:
        """All published versions."""
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], VERSIONS)

    def version(self, version: int | None = None) -> Version | None:
        """One published version, the latest by default; ``None`` if there is none."""
        rows = self.versions()
        if version is not None:
            rows = rows.where(F.col("version") == version)
        row = rows.orderBy(F.desc("version")).first()
        return row and Version(row.version, row.n_links, row.next_id, tuple(row.copies), row.label)

    def _require(self, version: int | None) -> Version:
        found = self.version(version)
        if found is None:
            raise LookupError(f"no published version {'' if version is None else version}")
        return found

    def create(self) -> Version:
        """The latest version, after publishing an empty first one if there is none."""
        return self.version() or self.publish(self.spark.createDataFrame([], LINK), partitions=1)

    def publish(
        self,
        links: DataFrame,
        copies: tuple[str, ...] = COPIES,
        partitions: int | None = None,
        next_id: int | None = None,
        label: int | None = None,
        given: int = 0,
    ) -> Version:
        """Write ``links`` as the next version and make it visible.

        The id counter never goes back: it is the highest of the last version's
        counter, ``max(id) + 1`` and ``given + 1``, unless ``next_id`` is set. ``given`` is
        the highest id ever given out that ``links`` may no longer hold.
        """
        last = self.version()
        number = last.version + 1 if last else 1
        base = f"{self.root}/v={number}"
        n, top = write_clustered(links, f"{base}/by_id", ORDERS["by_id"](), partitions)
        # The other copies come from the written one, so `links` is computed once.
        written = read_links(self.spark, f"{base}/by_id")
        for copy in copies:
            if copy != "by_id":
                write_clustered(written, f"{base}/{copy}", ORDERS[copy](), partitions)
        if next_id is None:
            next_id = max(top + 1, given + 1, last.next_id if last else 1)
        held = tuple(dict.fromkeys(("by_id", *copies)))
        row = self.spark.createDataFrame([(number, n, next_id, list(held), label)], VERSIONS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return Version(number, n, next_id, held, label)

    def read(self, version: int | None = None, copy: str = "by_id") -> DataFrame:
        """All links of a version."""
        found = self._require(version)
        return read_links(self.spark, f"{self.root}/v={found.version}/{copy}")

    def each(self, pattern: Pattern = (), version: int | None = None) -> DataFrame:
        """Links that match one pattern, read from the copy that skips most."""
        found = self._require(version)
        copy = choose_copy(pattern, found.copies)
        return each(read_links(self.spark, f"{self.root}/v={found.version}/{copy}"), pattern)

    def index_files(self, version: int | None = None) -> DataFrame:
        """Keep the bounds of a version's files in ``v=N/files``, for the ``links`` format to plan with."""
        found = self._require(version)
        base = f"{self.root}/v={found.version}"
        made = [file_bounds(read_links(self.spark, f"{base}/{copy}"), copy) for copy in found.copies]
        reduce(DataFrame.unionByName, made).coalesce(1).write.mode("overwrite").parquet(f"{base}/files")
        return self.spark.read.parquet(f"{base}/files")

    def apply(self, commands: DataFrame, parts: int | None = None, **publish) -> Version:
        """Fold a command log into the latest version and publish the result.

        Ids the log creates count as given out, also those it deletes again. (A create
        that is rejected names an id that exists.)
        """
        effect = stored(log_effect(commands, parts), "effect")
        return self.publish(applied(effect, self.read()), given=highest_birth(effect), **publish)

    def add(self, endpoints: DataFrame, order: Sequence[str] = ("source", "target"), **publish) -> Version:
        """Publish the links ``endpoints`` describes beside the present ones.

        Their ids continue the counter densely, in the given order.
        """
        last = self._require(None)
        new = allocate_ids(endpoints, order, start=last.next_id).select(*LINK_COLUMNS)
        return self.publish(self.read().unionByName(new), **publish)

    def drop(self) -> Version:
        """Publish an empty table and set the id counter back to 1."""
        return self.publish(self.spark.createDataFrame([], LINK), partitions=1, next_id=1)
