"""A published link table as a format of ``spark.read``, asked by pattern.

::

    register(spark)
    store.index_files()
    spark.read.format("links").options(root=store.root, source=7).load()

The reader picks the copy that is clustered for the pattern, prunes that copy's files by
the bounds kept in ``v=N/files``, makes one partition per file that is left, and applies
the pattern while it reads: row groups are skipped by their statistics, and rows leave a
task as Arrow batches, already filtered.

The pattern comes by options, not by pushed filters: in Spark 4.1 what is pushed into a
Python source belongs to the loaded table, so that a second query on the same DataFrame
(or the other side of a self-join) is read with the filters of the first and loses
rows. ``where`` works as on any table, by Spark, after reading.

Planning reads two small tables (versions, and one row per file) and opens no data
file. Paths are opened by pyarrow's file systems, so ``root`` needs a scheme that both
Spark and pyarrow know, or must be a folder that all executors mount.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arcloom.functions.patterns import Pattern, normalise
from arcloom.schema import LINK, LINK_COLUMNS
from arcloom.sources.snapshots import choose_copy


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(LinkFormat)


def each(spark: SparkSession, root: str, pattern: Pattern = (), version: int | None = None) -> DataFrame:
    """Links of the table at ``root`` that match one pattern, by the format."""
    bound = {c: str(v) for c, v in zip(LINK_COLUMNS, normalise(pattern)) if v is not None}
    asked = {} if version is None else {"version": str(version)}
    return spark.read.format("links").options(root=root, **bound, **asked).load()


@dataclass
class LinkFile(InputPartition):
    path: str


class LinkReader(DataSourceReader):
    def __init__(self, root: str, version: int | None, pattern: dict[str, int]):
        self.root, self.version, self.pattern = root.rstrip("/"), version, pattern

    def partitions(self) -> list[LinkFile]:
        found = _dataset(f"{self.root}/versions").to_table(columns=["version", "copies"]).to_pylist()
        found = [r for r in found if self.version in (None, r["version"])]
        if not found:
            raise LookupError(f"no published version {'' if self.version is None else self.version}")
        row = max(found, key=lambda r: r["version"])
        copy = choose_copy([self.pattern.get(c) for c in LINK_COLUMNS], tuple(row["copies"]))
        base = f"{self.root}/v={row['version']}"
        wanted = ds.field("copy") == copy
        for c, value in self.pattern.items():
            wanted &= (ds.field(f"{c}_min") <= value) & (ds.field(f"{c}_max") >= value)
        files = _dataset(f"{base}/files").to_table(columns=["file"], filter=wanted)["file"].to_pylist()
        return [LinkFile(f"{base}/{copy}/{name}") for name in sorted(files)]

    def read(self, partition: LinkFile | None) -> Iterator[pa.RecordBatch]:
        # Without files Spark asks once, for no partition.
        if partition is None:
            return
        wanted = [ds.field(c) == value for c, value in self.pattern.items()]
        batches = _dataset(partition.path).to_batches(
            columns=LINK_COLUMNS, filter=reduce(and_, wanted) if wanted else None
        )
        yield from (batch for batch in batches if batch.num_rows)


class LinkFormat(DataSource):
    """Options: ``root`` of a ``LinkStore``; ``version``, by default the latest; ``id``, ``source``
    and ``target``, each any value where it is left out."""

    @classmethod
    def name(cls) -> str:
        return "links"

    def schema(self):
        return LINK

    def reader(self, schema) -> LinkReader:
        version = self.options.get("version")
        pattern = {c: int(self.options[c]) for c in LINK_COLUMNS if c in self.options}
        return LinkReader(self.options["root"], None if version is None else int(version), pattern)


def _dataset(path: str) -> ds.Dataset:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    where, inner = fs.FileSystem.from_uri(path)
    return ds.dataset(inner, filesystem=where, format="parquet")
