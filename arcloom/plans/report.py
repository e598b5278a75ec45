"""From parsed benchmark figures to the comparison table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.columns import tenths
from arcloom.sources.benchlog import BACKENDS, IN_PROCESS, REMOTE, Families

# The operations in report order, the visible share of the maximum.
OPERATIONS = [
    "Create",
    "Update",
    "Delete",
    "Each All",
    "Each Identity",
    "Each Concrete",
    "Each Outgoing",
    "Each Incoming",
]
VISIBLE_SHARE = 0.005
MISSING = "N/A"


def operations(spark: SparkSession) -> DataFrame:
    """The report's row dimension: ``rank`` and ``op``."""
    names = F.array(*[F.lit(op) for op in OPERATIONS])
    return spark.range(1).select(F.posexplode(names).alias("rank", "op"))


def last_figures(parsed: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """One figure per operation and backend: the last in the log.

    ``order`` is one rising number per line, or several columns. A number and the
    place within the line are packed into one decimal, which a hash aggregate can
    hold; several columns are compared as a struct, by sorting.
    """
    if len(order) == 1:
        place = F.col(order[0]).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("pos")
        place = place.cast("decimal(38,0)")
    else:
        place = F.struct(*order, "pos")
    return parsed.groupBy("op", "backend").agg(F.max_by("ns", place).alias("ns"))


def comparison(figures: DataFrame) -> DataFrame:
    """Operations by backends, missing figures 0, in report order."""
    wide = figures.groupBy("op").pivot("backend", BACKENDS).agg(F.max("ns"))
    ops = operations(figures.sparkSession)
    return ops.join(wide, "op", "left").select(
        F.col("rank").cast("bigint").alias("rank"),
        "op",
        *[F.coalesce(b, F.lit(0)).alias(b) for b in BACKENDS],
    ).orderBy("rank")


def best_remote() -> Column:
    """The lowest remote figure; NULL when neither is present."""
    return F.least(*[F.nullif(F.col(b), F.lit(0)) for b in REMOTE])


def speedups(table: DataFrame) -> DataFrame:
    """The table as text, in-process figures with their gain on the best remote."""

    def annotated(name: str) -> Column:
        value = F.col(name)
        gain = F.concat(value.cast("string"), F.lit(" ("), tenths(best_remote() / value), F.lit("x faster)"))
        return (
            F.when(value == 0, MISSING)
            .when(best_remote().isNull(), value.cast("string"))
            .otherwise(gain)
        )

    def plain(name: str) -> Column:
        return F.when(F.col(name) == 0, MISSING).otherwise(F.col(name).cast("string"))

    return table.select(
        "rank",
        "op",
        *[annotated(b).alias(b) for b in IN_PROCESS],
        *[plain(b).alias(b) for b in REMOTE],
    )


def highest(table: DataFrame) -> DataFrame:
    """The highest figure of all series, as one row ``highest``."""
    return table.agg(F.max(F.greatest(*BACKENDS)).alias("highest"))


def visible(table: DataFrame) -> DataFrame:
    """Figures for plotting: positive ones raised to a visible share of the highest."""
    floor = highest(table).scalar() * F.lit(VISIBLE_SHARE)
    return table.select(
        "rank",
        "op",
        *[
            F.when(F.col(b) > 0, F.greatest(F.col(b).cast("double"), floor)).otherwise(F.lit(0.0)).alias(b)
            for b in BACKENDS
        ],
    )


def missing_figures(figures: DataFrame) -> DataFrame:
    """Cells of the report that the log has no figure for."""
    grid = operations(figures.sparkSession).select(
        "op", F.explode(F.array(*[F.lit(b) for b in BACKENDS])).alias("backend")
    )
    return grid.join(figures, ["op", "backend"], "left_anti")


def report_lines(texts: DataFrame, families: Families = Families()) -> DataFrame:
    """The report as lines of a markdown table, ``(n, line)``."""
    labels = [
        "Operation",
        *(f"{families.local} {name}" for name in (
            "United Volatile", "United NonVolatile", "Split Volatile", "Split NonVolatile"
        )),
        *(f"{families.remote} {name}" for name in ("NonTransaction", "Transaction")),
    ]
    widths = [max(map(len, OPERATIONS)), *map(len, labels[1:])]

    def cell(value: Column, width: int) -> Column:
        return F.rpad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))

    cells = [cell(F.col(c), w) for c, w in zip(["op", *BACKENDS], widths)]
    rows = texts.select(
        (F.col("rank") + 2).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    )
    head = [
        (0, "| " + " | ".join(label.ljust(width) for label, width in zip(labels, widths)) + " |"),
        (1, "|" + "|".join("-" * (width + 2) for width in widths) + "|"),
    ]
    return texts.sparkSession.createDataFrame(head, "n bigint, line string").unionByName(rows)


def markdown(texts: DataFrame, families: Families = Families()) -> str:
    """The report as a markdown table. Collects its lines: one per operation, and two."""
    return "\n".join(r.line for r in report_lines(texts, families).orderBy("n").collect())
