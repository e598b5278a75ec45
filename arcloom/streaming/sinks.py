"""A change feed kept as a readable link table.

Rewriting the whole table per micro-batch would cost the table's size each time.
So a batch writes only the last change of each id it touched, as ``delta/v=<version>``,
and a reader lays the deltas over the last compacted table. ``compact`` folds
them in on whatever schedule suits.

Versions are the sink's own: a small ``batches`` table names the stream and batch of
each. A batch that is repeated finds its version again and rewrites its own delta;
a stream with a new checkpoint counts its batches from 0 but gets new versions, so it
overwrites and hides nothing. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from arcloom.operators.commands import outcomes
from arcloom.schema import APPLIED, DELETE, LATE, LINK, LINK_COLUMNS, OUTCOME
from arcloom.sources.snapshots import LinkStore, Version

# ``handled`` is the last command of the id that was not late; the rest is the last
# applied one, NULL if none was.
DELTA = "id bigint, handled bigint, seq bigint, alive int, source bigint, target bigint, v bigint"
BATCHES = "v bigint, run string, batch bigint"
HANDLED = "id bigint, handled bigint"


class FeedSink:
    """Deltas and compacted tables below ``root``, a folder all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.store = LinkStore(spark, f"{self.root}/base")

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def last_version(self) -> int:
        """The version of the last batch written, -1 if there is none."""
        return self._read("batches", BATCHES).agg(F.coalesce(F.max("v"), F.lit(-1))).first()[0]

    def _version(self, run: str, batch_id: int) -> tuple[int, bool]:
        """The version of a batch, and whether it is new."""
        known = self._read("batches", BATCHES).where((F.col("run") == run) & (F.col("batch") == batch_id)).first()
        return (known.v, False) if known else (self.last_version() + 1, True)

    def _run(self) -> str:
        """The stream this call belongs to: its id lives in its checkpoint."""
        return self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""

    def write_batch(self, fates: DataFrame, batch_id: int, run: str | None = None) -> None:
        """The ``foreachBatch`` function. A repeated batch rewrites its own delta only.

        ``run`` names the stream where it is called by hand.
        """
        run = self._run() if run is None else run
        version, new = self._version(run, batch_id)
        applied = F.col("status") == APPLIED

        def last(value):
            return F.max_by(value, F.when(applied, F.col("seq")))

        delta = (
            fates.where(F.col("status") != LATE)
            .groupBy("id")
            .agg(
                F.max("seq").alias("handled"),
                F.max(F.when(applied, F.col("seq"))).alias("seq"),
                last((F.col("op") != DELETE).cast("int")).alias("alive"),
                last(F.col("after_source")).alias("source"),
                last(F.col("after_target")).alias("target"),
            )
        )
        delta.write.mode("overwrite").parquet(f"{self.root}/delta/v={version}")
        if new:
            row = self.spark.createDataFrame([(version, run, batch_id)], BATCHES)
            row.coalesce(1).write.mode("append").parquet(f"{self.root}/batches")

    def start(self, fates: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run a stream of outcomes into this sink."""
        return self._start(fates, self.write_batch, checkpoint, trigger)

    def start_folding(self, commands: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run a stream of commands into this sink, see ``fold_batch``."""
        return self._start(commands, self.fold_batch, checkpoint, trigger)

    @staticmethod
    def _start(stream: DataFrame, write, checkpoint: str, trigger: dict) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    def fold_batch(self, commands: DataFrame, batch_id: int, run: str | None = None) -> None:
        """A ``foreachBatch`` function for *commands*, without per-id stream state.

        The micro-batch is folded as a batch on the table below it, so a hot id is
        cut into pieces there too. A command at or below the last one handled for its
        id is ``late``, as in ``stream_outcomes``. Outcomes go to ``feed/v=<version>``. It
        reads the table once per batch: meant for large, infrequent batches, where
        ``stream_outcomes`` would hold too much of one id at a time. A repeated
        batch starts from the same version again and rewrites its own output.
        """
        run = self._run() if run is None else run
        version, _ = self._version(run, batch_id)
        feed = f"{self.root}/feed/v={version}"
        commands.persist()  # the micro-batch is read for both parts
        try:
            handled = self.handled(version - 1)
            again = F.row_number().over(Window.partitionBy("id", "seq").orderBy("op", "source", "target"))
            marked = (
                commands.join(handled, "id", "left")
                .withColumn("late", F.coalesce(F.col("seq") <= F.col("handled"), F.lit(False)) | (again > 1))
            )
            fresh = outcomes(marked.where("NOT late"), self.links(version - 1))
            zeros = [F.lit(0).cast("bigint").alias(c) for c in fresh.columns[4:]]
            late = marked.where("late").select("seq", "id", "op", F.lit(LATE).alias("status"), *zeros)
            fresh.unionByName(late).write.mode("overwrite").parquet(feed)
        finally:
            commands.unpersist()
        self.write_batch(self.spark.read.schema(OUTCOME).parquet(feed), batch_id, run)

    def feed(self) -> DataFrame:
        """All outcomes that ``fold_batch`` has written, with their version ``v``."""
        schema = StructType([*OUTCOME.fields, StructField("v", LongType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/feed")
        return rows.where(F.col("v") <= self.last_version())

    def _base(self, version: int) -> Version | None:
        rows = self.store.versions().where(F.col("label") <= version)
        row = rows.orderBy(F.desc("version")).first()
        return row and self.store.version(row.version)

    def _deltas(self, after: int, upto: int) -> DataFrame:
        deltas = self._read("delta", DELTA)
        return deltas.where((F.col("v") > after) & (F.col("v") <= upto))

    def handled(self, version: int | None = None) -> DataFrame:
        """``(id, handled)``: the last command handled of every id, up to ``version``."""
        version = self.last_version() if version is None else version
        base = self._base(version)
        after = base.label if base else -1
        known = self._deltas(after, version).select("id", "handled")
        if base is not None and after >= 0:
            known = known.unionByName(self._read(f"handled/v={after}", HANDLED))
        return known.groupBy("id").agg(F.max("handled").alias("handled"))

    def links(self, version: int | None = None) -> DataFrame:
        """The table after version ``version``, by default after the last one."""
        version = self.last_version() if version is None else version
        base = self._base(version)
        deltas = self._deltas(base.label if base else -1, version).where("seq IS NOT NULL")
        last = deltas.groupBy("id").agg(
            *[F.max_by(c, F.struct("v", "seq")).alias(c) for c in ("alive", "source", "target")]
        )
        changed = last.where(F.col("alive") == 1).select(*LINK_COLUMNS)
        if base is None:
            return changed
        kept = self.store.read(base.version).join(last.select("id"), "id", "left_anti")
        return kept.select(*LINK_COLUMNS).unionByName(changed)

    def compact(self, **publish) -> Version:
        """Publish the table after the last batch as the new base.

        Ids that were given out and deleted again keep the id counter up. Older bases
        and deltas stay readable; removing them is a retention decision for the
        owner of the folder.
        """
        upto = self.last_version()
        if upto < 0:
            return self.store.publish(self.spark.createDataFrame([], LINK), label=-1, **publish)
        self.handled(upto).write.mode("overwrite").parquet(f"{self.root}/handled/v={upto}")
        given = self._deltas(-1, upto).where("seq IS NOT NULL").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return self.store.publish(self.links(upto), label=upto, given=given, **publish)
