"""The given tables seen as links, patterns, commands, documents and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.schema import CREATE, DELETE, LINK_COLUMNS, UPDATE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a link from its user to its ``k``; 0 stays free for "none"."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("id"),
        (F.col("user_id") + 1).alias("source"),
        (_k() + 1).alias("target"),
    )


def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of new links, one per order."""
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("id"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part and supplier pairs, links that still need an id."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") + 1).alias("source"), (F.col("l_suppkey") + 1).alias("target")
    ).distinct()


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per order: its id to its customer and itself."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("id"),
        (F.col("o_custkey") + 1).alias("source"),
        (F.col("o_orderkey") + 1).alias("target"),
    )


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to delete: every order that has a line item, as often as it has one."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("id"))


def requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids asked for, one request per order; a third of them do not exist."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request"), (F.col("o_orderkey") + 1).alias("id")
    )


def patterns(spark: SparkSession, sf_dir: str, with_any: bool = False) -> DataFrame:
    """One pattern per customer over all masks, all-ANY among them if asked.

    Customer ``c`` takes its values from link ``c + 1``. Two nations in five ask
    for a target that no link has.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = c.join(links(spark, sf_dir), F.col("id") == F.col("c_custkey") + 1)
    mask = F.col("c_custkey") % 8 if with_any else F.col("c_custkey") % 7 + 1

    def bound(bit: int, value):
        return F.when(mask.bitwiseAND(bit) != 0, value)

    shift = F.when(F.col("c_nationkey") % 5 < 2, 1000).otherwise(0)
    return joined.select(
        F.col("c_custkey").alias("pid"),
        bound(1, F.col("id")).alias("p_id"),
        bound(2, F.col("source")).alias("p_source"),
        bound(4, F.col("target") + shift).alias("p_target"),
    )


def pattern_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns as arrays cut to none to four positions, every sixth one NULL."""
    whole = F.array("p_id", "p_source", "p_target", F.lit(0))
    cut = F.slice(whole, F.lit(1), (F.col("pid") % 6).cast("int"))
    return patterns(spark, sf_dir).select("pid", F.when(F.col("pid") % 6 < 5, cut).alias("pattern"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a command on its user's link."""
    return as_commands(table(spark, sf_dir, "events"))


def as_commands(events: DataFrame) -> DataFrame:
    op = (
        F.when(F.col("event_type") == "signup", CREATE)
        .when(F.col("event_type") == "error", DELETE)
        .otherwise(UPDATE)
    )
    updating = op == UPDATE
    return events.select(
        F.col("event_id").alias("seq"),
        op.alias("op"),
        (F.col("user_id") + 1).alias("id"),
        F.when(updating, _k()).alias("source"),
        F.when(updating, F.col("event_id")).alias("target"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links packed into response documents of a hundred rows, some of them failed.

    ``doc_id`` 0 modulo 10 carries an error beside its rows, and every document
    has chunk sizes around it.
    """
    packed = (
        links(spark, sf_dir)
        .groupBy(F.floor(F.col("id") / 100).alias("doc_id"))
        .agg(F.collect_list(F.struct(F.array(*LINK_COLUMNS).alias("row"))).alias("data"))
    )
    result = F.struct(F.array(*[F.lit(c) for c in LINK_COLUMNS]).alias("columns"), F.col("data"))
    errors = F.when(
        F.col("doc_id") % 10 == 0,
        F.array(F.struct(F.lit("Busy").alias("code"), F.concat(F.lit("try "), "doc_id").alias("message"))),
    ).otherwise(F.array().cast("array<struct<code:string,message:string>>"))
    body = F.to_json(F.struct(F.array(result).alias("results"), errors.alias("errors")))
    return packed.select("doc_id", F.concat(F.lit("1f4\r\n"), body, F.lit("\r\n0\r\n")).alias("body"))


def count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count response for every source: its number of links; some are none, text or negative."""
    counted = links(spark, sf_dir).groupBy(F.col("source").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    cell = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('"'), F.col("n"), F.lit('"')))
        .when(F.col("doc_id") % 7 == 0, F.concat(F.lit("-"), F.col("n")))
        .otherwise(F.col("n").cast("string"))
    )
    rows = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('{"row":['), cell, F.lit("]}")))
    body = F.concat(F.lit('{"results":[{"columns":["count"],"data":['), rows, F.lit(']}],"errors":[]}'))
    return counted.select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit("{")).otherwise(body).alias("body"))


def bench_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of a benchmark log: a figure, noise or a failure."""
    raw_ops = [
        "Create", "Update", "Delete", "Each_All",
        "Each_Identity", "Each_Concrete", "Each_Outgoing", "Each_Incoming",
    ]
    backends = [
        "Local_United_Volatile", "Local_United_NonVolatile", "Local_Split_Volatile",
        "Local_Split_NonVolatile", "Remote_NonTransaction", "Remote_Transaction",
    ]
    op_no, backend_no = (F.col("user_id") % 8).cast("int"), (_k() % 6).cast("int")
    base = F.abs(F.floor(F.col("value") * 1000)).cast("bigint")
    ns = F.when(backend_no >= 4, base * 1000 + 7).otherwise(base)
    figure = F.format_string(
        "test %s/%s ... bench: %11d ns/iter (+/- %d)",
        F.get(F.array(*map(F.lit, raw_ops)), op_no),
        F.get(F.array(*map(F.lit, backends)), backend_no),
        ns,
        F.col("event_id"),
    )
    line = (
        F.when((op_no == 2) & (backend_no == 5), F.lit("thread 'main' panicked at 'NotExists'"))
        .when(F.col("event_type") == "error", F.lit("Warning: Unable to complete 100 samples in 5.0s."))
        .when(F.col("event_type") == "view", F.concat(F.lit("run\tSTEP\t"), figure))
        .otherwise(figure)
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), line.alias("line"))
