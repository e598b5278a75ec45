"""Degrees kept up from the change feed against a recount."""

from helpers import rows
from test_commands import random_base, random_log

from arcloom.operators import commands as cmd
from arcloom.operators import counts
from arcloom.schema import COMMAND, LINK
from arcloom.session import scratch_path


def test_kept_up_equals_a_recount(spark):
    base = spark.createDataFrame(random_base(3), LINK)
    degrees = {keys: base.groupBy(*keys).count().withColumnRenamed("count", "n") for keys in (("source",), ("target",), ("source", "target"))}
    for seed in (3, 4):
        log = spark.createDataFrame(random_log(seed, n=150), COMMAND)
        feed, base = cmd.change_feed(cmd.outcomes(log, base=base)), cmd.current_links(log, base=base)
        for keys, held in degrees.items():
            degrees[keys] = counts.changed_degrees(held, counts.degree_changes(feed, *keys))
            recount = base.groupBy(*keys).count()
            assert rows(degrees[keys]) == rows(recount)


def test_a_streaming_feed_gives_the_same_changes(spark):
    log = spark.createDataFrame(random_log(5, n=150), COMMAND)
    feed, root = cmd.change_feed(cmd.outcomes(log)), scratch_path(spark, "test-degrees")
    feed.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = counts.degree_changes(stream, "source").writeStream.outputMode("complete").format("memory").queryName("degree_changes")
    query.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("degree_changes")) == rows(counts.degree_changes(feed, "source"))
