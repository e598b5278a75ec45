"""What the text operators share: reading a document table, and marking copies of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of letters and digits: what is not ASCII counts as a letter. (Fixed by contract.)
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``(doc_id, text, version)``; a null text is an empty one.

    With ``carry``, one more column ``row`` holds all columns as they came, whatever
    their names.

    ``version`` hashes the text. Rows are told apart by ``(doc_id, version)``, so
    that a null or repeated ``doc_id`` with several texts does no harm; rows that
    agree in both are copies, and every operator gives all of them the same result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"), *row
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """The join condition of two tables made by ``texts``; null ids are equal."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["version"] == right["version"])


def keep_rows(docs: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs``, with their own columns, that ``wanted (doc_id, version)`` names.

    ``how="left_anti"`` gives the other rows.
    """
    rows = texts(docs, carry=True).select("doc_id", "version", "row")
    return rows.join(wanted, same_row(rows, wanted), how).select("row.*")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order; none for an empty one."""
    return F.filter(F.split(lower_ascii(text), NO_WORD), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has; to count them no letter need be lowered."""
    return F.size(F.filter(F.split(text, NO_WORD.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")), lambda w: w != ""))
