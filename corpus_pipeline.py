"""From raw documents to piece ids: filter, clean, deduplicate, decontaminate, encode.

Each stage works on what the one before kept, written as Parquet to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm import decontaminate as passages
from arcloom.llm import lines, neardup, pieces, quality
from arcloom.llm.common import keep_rows, words
from arcloom.llm.queries import PIECES, table
from arcloom.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes accept; learnt from the labelled ones among them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.scores(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.where(F.col("quality_score") >= quality.THRESHOLD).select("row.*")


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that ten or more share; ``n_chars`` follows the text."""
    cut = lines.drop_shared_lines(docs, carry=True)
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("kept").cast("long"))
    return cut.select(row.alias("row")).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.NearCopies().first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A passage is a whole window: an item of fewer words says too little to drop what
    holds it ("yes" stands in many a clean document), so such items decide nothing.
    """
    items = table(spark, sf_dir, "benchmark").where(F.size(words(F.coalesce("text", F.lit("")))) >= passages.WINDOW)
    found = passages.contamination(docs, items)
    return keep_rows(docs, found.where("n_hit > 0").select("doc_id", "version").distinct(), "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_pieces, pieces, round_trip)``: the ids, and whether they decode to the text."""
    made = pieces.encode(docs, PIECES, decoded="decoded")
    return made.select(
        "doc_id",
        "lang",
        "source",
        F.size("pieces").cast("long").alias("n_pieces"),
        "pieces",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality", good_quality),
    ("lines", without_shared_lines),
    ("near copies", without_near_copies),
    ("decontamination", decontaminated),
    ("pieces", encoded),
]

# A classifier and an encoder stand among the stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
