"""Exported query responses, one JSON text per document, as links.

A document is ``{results: [{columns, data: [{row: [cell, ...]}]}], errors:
[{code, message}]}``. Cells are parsed as variants: only a JSON integer that fits
a bigint counts as a number, so ``"5"``, ``5.0`` and ``null`` all decode to 0, and
one odd cell cannot spoil its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE = (
    "results array<struct<columns: array<string>, data: array<struct<row: array<variant>>>>>, "
    "errors array<struct<code: string, message: string>>, "
    "_corrupt_record string"
)

OK, FAILED, MALFORMED = "ok", "failed", "malformed"


def _cell(row: Column, position: int) -> Column:
    cell = F.get(row, F.lit(position))
    number = F.when(
        F.schema_of_variant(cell) == "BIGINT", F.try_variant_get(cell, "$", "bigint")
    )
    return F.greatest(F.coalesce(number, F.lit(0)), F.lit(0))


def parse_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, status, message, data)`` from ``(doc_id, body)``.

    Text before the first and after the last brace (chunk sizes) is cut off.
    ``data`` holds the rows of the first result only. A non-empty ``errors`` makes
    the document ``failed`` with its first message; a document without results,
    or with a row or an error that lacks a required field, is ``malformed``.
    """
    body = F.regexp_extract("body", r"(?s)\{.*\}", 0)
    parsed = documents.select(
        "doc_id",
        F.from_json(body, RESPONSE, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"),
    )
    errors = F.coalesce("d.errors", F.array().cast("array<struct<code:string,message:string>>"))

    def broken(result: Column) -> Column:
        rowless = F.exists(result["data"], lambda d: d["row"].isNull())
        return result.isNull() | F.coalesce(rowless, F.lit(False))  # no data means no rows

    whole = (
        F.col("d._corrupt_record").isNull()
        & F.col("d.results").isNotNull()
        & ~F.exists("d.results", broken)
        & ~F.exists(errors, lambda e: e["code"].isNull() | e["message"].isNull())
    )
    status = (
        F.when(~F.coalesce(whole, F.lit(False)), MALFORMED)
        .when(F.size(errors) > 0, FAILED)
        .otherwise(OK)
    )
    return parsed.select(
        "doc_id",
        status.alias("status"),
        F.when(status == FAILED, F.get(errors, F.lit(0))["message"]).alias("message"),
        F.when(status == OK, F.get("d.results", F.lit(0))["data"]).alias("data"),
    )


def _rows(parsed: DataFrame) -> DataFrame:
    # Only good documents have data. A filter on the status would be pushed below
    # the parsing and so parse every document again.
    return parsed.select("doc_id", F.explode("data.row").alias("row"))


def _one_each(parsed: DataFrame, value: Column) -> DataFrame:
    # What is exploded is computed once; a filter on it stays above.
    return parsed.select("doc_id", F.explode(F.array(value)).alias("d"))


def document_links(parsed: DataFrame) -> DataFrame:
    """The links of all good documents; rows of fewer than three cells are skipped."""
    rows = _rows(parsed).where(F.size("row") >= 3)
    return rows.select(
        "doc_id",
        _cell(F.col("row"), 0).alias("id"),
        _cell(F.col("row"), 1).alias("source"),
        _cell(F.col("row"), 2).alias("target"),
    )


def document_numbers(parsed: DataFrame) -> DataFrame:
    """The single number of a count response: first cell of the first row, else 0."""
    first = F.get(F.get("data", F.lit(0))["row"], F.lit(0))
    number = F.when(F.schema_of_variant(first) == "BIGINT", F.try_variant_get(first, "$", "bigint"))
    one = F.struct("status", F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)).alias("n"))
    return _one_each(parsed, one).where(F.col("d.status") == OK).select("doc_id", "d.n")


def document_rejects(parsed: DataFrame) -> DataFrame:
    """Documents that gave no links because they failed or could not be read."""
    told = _one_each(parsed, F.struct("status", "message"))
    return told.where(F.col("d.status") != OK).select("doc_id", "d.status", "d.message")
