"""Benchmark logs as rows."""

from __future__ import annotations

from dataclasses import dataclass
from re import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the log format. Groups: operation, mode of a remote backend,
# layout and storage of an in-process one, figure, deviation.
FIGURE = (
    r"test\s+(\w+)/(?:{remote}_(\w+)|{local}_(\w+)_(\w+))\s+\.\.\."
    r"\s+bench:\s+(\d+)\s+ns/iter\s+\(\+/-\s+(\d+)\)"
)
TRANSACTION, UNITED, VOLATILE = "Transaction", "United", "Volatile"
FAILURE = r"panicked|bench failed"
# A test whose figure does not follow on its line.
CUT_SHORT = r"test\s+\w+/\w+\s+\.\.\.\s*(?:bench:\s*)?$"
NUMBERS = r"bench:\s+(\d+)\s+ns/iter\s+\(\+/-\s+(\d+)\)"
TERMINAL_CODE = r"\x1B?\[[0-9;]*m"

# Backends in report order: in-process by layout and storage, then remote.
BACKENDS = [
    "united_volatile",
    "united_nonvolatile",
    "split_volatile",
    "split_nonvolatile",
    "remote_nontransaction",
    "remote_transaction",
]
IN_PROCESS, REMOTE = BACKENDS[:4], BACKENDS[4:]


@dataclass(frozen=True)
class Families:
    """The names the log uses for the two families of backends."""

    local: str = "Local"
    remote: str = "Remote"


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Log lines with their place ``(file, block, row)``.

    ``block`` is the byte offset of the file split and ``row`` rises within it, so
    the three order the lines of each file, however the file is split.
    """
    return spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def parse_lines(
    lines: DataFrame, families: Families = Families(), order: tuple[str, ...] = ("line_no",)
) -> DataFrame:
    """Every figure in the log: order columns, ``pos``, ``op``, ``backend``, ``ns``, ``dev``.

    Lines without a figure give nothing, figures beyond a bigint neither: see
    ``unread_lines``. In-process backends carry a layout and a
    storage part, remote ones a mode; unknown values fall to split, non-volatile
    and non-transaction.
    """
    figure = FIGURE.format(remote=escape(families.remote), local=escape(families.local))
    # One search per line, one split per hit; the words hold no blanks.
    words = F.split(F.regexp_replace("hit", figure, "$1 $2 $3 $4 $5 $6"), " ")
    op, mode, layout, storage, ns, dev = (F.get("words", F.lit(n)) for n in range(6))
    in_process = F.concat(
        F.when(layout == UNITED, "united").otherwise("split"),
        F.when(storage == VOLATILE, "_volatile").otherwise("_nonvolatile"),
    )
    backend = (
        F.when(mode == TRANSACTION, "remote_transaction")
        .when(mode != "", "remote_nontransaction")
        .otherwise(in_process)
    )
    return (
        lines.where(F.col("line").contains("ns/iter"))
        .select(
            *order,
            F.posexplode(F.regexp_extract_all("line", F.lit(figure), F.lit(0))).alias("pos", "hit"),
        )
        .select(*order, "pos", words.alias("words"))
        .select(
            *order,
            F.col("pos").cast("bigint").alias("pos"),
            F.regexp_replace(op, "_", " ").alias("op"),
            backend.alias("backend"),
            ns.try_cast("bigint").alias("ns"),
            dev.try_cast("bigint").alias("dev"),
        )
        .where(F.col("ns").isNotNull() & F.col("dev").isNotNull())
    )


def failure_lines(lines: DataFrame) -> DataFrame:
    """Lines that tell of a failed run; terminal colour codes do not hide them."""
    return lines.where(F.regexp_replace("line", TERMINAL_CODE, "").rlike(FAILURE))


def unread_lines(lines: DataFrame) -> DataFrame:
    """Lines whose figure ``parse_lines`` could not read, so that none is lost without a trace.

    A test that ends before its figure (it may follow on the next line), and a figure
    beyond a bigint.
    """

    def too_large(group: int):
        found = F.regexp_extract_all("line", F.lit(NUMBERS), F.lit(group))
        return F.exists(found, lambda n: n.try_cast("bigint").isNull())

    cut_short = F.regexp_replace("line", TERMINAL_CODE, "").rlike(CUT_SHORT)
    return lines.where(cut_short | too_large(1) | too_large(2))
