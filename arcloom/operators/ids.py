"""Dense id allocation and the report of free ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from arcloom.session import scratch_path

# monotonically_increasing_id() puts the partition above and the row below bit 33.
ROW_BITS = 33


def allocate_ids(
    rows: DataFrame, order: Sequence[str], start: int = 1, partitions: int | None = None
) -> DataFrame:
    """``rows`` with a dense ``id``: ``start``, ``start + 1``, ... in the given order.

    The rows are range-partitioned on the whole order key (so one hot leading
    value is cut over several partitions), sorted within partitions and written
    once with their partition and position. The ids are then the position plus
    the number of rows in earlier partitions, a table of one row per partition.
    One shuffle of the data; no window over the rows and no single-task numbering.

    The write pins partition and position, so a lost executor cannot renumber
    rows between the two reads. Rows that are equal in ``order`` get their ids in
    any order, so name enough columns to make it total.
    """
    keys = list(order)
    ranged = (
        rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    )
    path = scratch_path(rows.sparkSession, "numbered")
    ranged.sortWithinPartitions(*keys).withColumn(
        "_slot", F.monotonically_increasing_id()
    ).write.parquet(path)

    staged = rows.sparkSession.read.parquet(path).withColumn(
        "_part", F.shiftright("_slot", ROW_BITS)
    )
    # One row per partition: as many as the shuffle had partitions.
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    position = F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return staged.join(F.broadcast(offsets), "_part").select(
        (F.col("_before") + position + F.lit(start)).cast("bigint").alias("id"), *rows.columns
    )


def free_ranges(links: DataFrame, next_id: int | None = None, partitions: int | None = None) -> DataFrame:
    """Runs ``(first, last)`` of ids that no link holds, below ``next_id`` or the highest id.

    The ids are range-partitioned and stored; each part compares neighbours, and the
    first id of every part is met by the last before it, one row per part. The work
    follows the number of links, however far apart their ids are.
    """
    spark = links.sparkSession
    path = scratch_path(spark, "id-parts")
    ids = links.select("id").where("id > 0")
    ranged = ids.repartitionByRange(partitions, "id") if partitions else ids.repartitionByRange("id")
    ranged.withColumn("part", F.spark_partition_id()).write.parquet(path)
    staged = spark.read.parquet(path)
    before = F.lag("id").over(Window.partitionBy("part").orderBy("id"))
    inner = staged.select(before.alias("low"), F.col("id").alias("high"))
    # One row per part.
    edges = staged.groupBy("part").agg(F.min("id").alias("high"), F.max("id").alias("top"))
    low = F.coalesce(F.lag("top").over(Window.orderBy("part")), F.lit(0))
    pairs = inner.where("low IS NOT NULL").unionByName(edges.select(low.alias("low"), "high"))
    if next_id is not None:
        end = staged.agg(F.coalesce(F.max("id"), F.lit(0)).alias("low")).withColumn("high", F.lit(next_id))
        pairs = pairs.withColumn("high", F.least("high", F.lit(next_id))).unionByName(end)
    gaps = pairs.select((F.col("low") + 1).alias("first"), (F.col("high") - 1).alias("last"))
    return gaps.where("first <= last")


def free_ids(links: DataFrame, next_id: int | None = None) -> DataFrame:
    """Ids below ``next_id`` that no link holds; by default up to the highest id.

    One row per free id. ``free_ranges`` tells the same in as many rows as there are gaps.
    """
    block = 1 << 20
    blocks = free_ranges(links, next_id).select(
        "last", F.explode(F.sequence("first", "last", F.lit(block).cast("bigint"))).alias("first")
    )
    last = F.least(F.col("last"), F.col("first") + (block - 1))
    return blocks.select(F.explode(F.sequence("first", last)).alias("id"))
