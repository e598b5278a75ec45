"""Response documents, with every odd case."""

import json

from helpers import rows
from pyspark.sql import functions as F

from arcloom.sources import documents as docs


def body(*results, errors=None, **other):
    out = {"results": [{"data": [{"row": r} for r in result]} for result in results], **other}
    if errors is not None:
        out["errors"] = errors
    return json.dumps(out)


CASES = {
    1: body([[1, 2, 3], [4, 5, 6, 7]]),
    2: body([[1, None, "9"], [-4, 2.0, 10**30], [True, {"a": 1}, [1]]]),
    3: body([[1, 2], [8, 8, 8]], [[9, 9, 9]]),
    4: body(),
    5: '{"results": [{"columns": ["id"]}]}',
    6: body([[1, 1, 1]], errors=[{"code": "A", "message": "first"}, {"code": "B", "message": "second"}]),
    7: "1f4\r\n" + body([[7, 7, 7]]) + "\r\n0\r\n",
    8: "no braces at all",
    9: '{"results": [',
    10: '{"results": [{"data": [{"cells": [1, 2, 3]}]}]}',
    11: None,
    12: '{"errors": []}',
    13: body([[5, 5, 5]], errors=[{"code": "A"}]),
    14: body([[2**53 + 1, 2**63 - 1, 0]], errors=[]),
}


def parsed(spark):
    return docs.parse_documents(spark.createDataFrame(list(CASES.items()), "doc_id bigint, body string"))


def test_links(spark):
    assert rows(docs.document_links(parsed(spark))) == [
        (1, 1, 2, 3),
        (1, 4, 5, 6),
        (2, 0, 0, 0),
        (2, 0, 0, 0),
        (2, 1, 0, 0),
        (3, 8, 8, 8),
        (7, 7, 7, 7),
        (14, 2**53 + 1, 2**63 - 1, 0),
    ]


def test_rejects(spark):
    got = {r.doc_id: (r.status, r.message) for r in docs.document_rejects(parsed(spark)).collect()}
    assert got == {
        6: ("failed", "first"),
        **{n: ("malformed", None) for n in (8, 9, 10, 11, 12, 13)},
    }


def test_every_document_is_accounted_for(spark):
    assert parsed(spark).count() == len(CASES)


def test_numbers(spark):
    given = spark.createDataFrame(
        [(1, body([[42]])), (2, body([])), (3, body()), (4, body([["x"]])), (5, body([[-1]]))],
        "doc_id bigint, body string",
    )
    assert rows(docs.document_numbers(docs.parse_documents(given))) == [(1, 42), (2, 0), (3, 0), (4, 0), (5, 0)]


def test_round_trip(spark, edge_links):
    data = F.collect_list(F.struct(F.array("id", "source", "target").alias("row"))).alias("data")
    packed = edge_links.groupBy((F.col("id") % 2).alias("doc_id")).agg(data)
    given = packed.select("doc_id", F.to_json(F.struct(F.array(F.struct("data")).alias("results"))).alias("body"))
    back = docs.document_links(docs.parse_documents(given)).drop("doc_id")
    assert rows(back) == rows(edge_links)
