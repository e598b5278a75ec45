"""The stages one after another, against what is known of a small made corpus."""

import __spark_entry__ as entry_points
import compare
import pytest
from data import prose

import corpus_pipeline
from arcloom.llm import pieces
from arcloom.llm.queries import ORACLE, PIECES, QUERIES

SF_DIR = f"{compare.SF_ROOT}/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    good = [prose(n, 120) for n in range(40)]
    bad = [prose(n, 120).upper().replace(" ", "!! ") for n in range(100, 140)]
    texts = [t + ("\nsubscribe now" if n % 2 else "") for n, t in enumerate(good)] + bad
    texts += [good[3] + " more", prose(300, 60) + " " + prose(999, 20) + " " + prose(301, 60), None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 40), 0) for i in range(80) if i % 4]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(999, 20)), (2, good[0].split()[0]), (3, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = {r.doc_id: r for r in pieces.decode(out, PIECES).collect()}
    assert all(r.round_trip for r in rows.values())
    assert set(range(40)) <= set(rows) <= set(range(40)) | {82}
    assert all(rows[i].decoded == good[i] for i in range(40))


def test_registered_queries(spark):
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries()) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op2_decontaminate", "op10_lines", "op12_embeddings", "op13_manifest"])
def test_query_equals_sql(spark, name):
    db = compare.database(SF_DIR)
    result = entry_points.queries()[name](spark, SF_DIR)
    assert compare.difference(result, db, entry_points.oracle_sql()[name]) is None
