"""Shared lines against a plain count, both ways of probing, and the perfect hash alone."""

import numpy as np
import pytest
from data import docs_of, no_docs, odd_docs
from pyspark.sql import functions as F

from arcloom.llm import lines


def brute(texts, min_docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    cut = [(t or "").split("\n") for t in texts]
    seen = {}
    for ls in cut:
        for k in {key(x) for x in ls}:
            seen[k] = seen.get(k, 0) + 1
    return ["\n".join(x for x in ls if not key(x) or seen[key(x)] < min_docs) for ls in cut]


TEXTS = (
    ["Shared LINE\nown %d\n\n shared line\t" % n for n in range(12)]
    + ["rare\nShared line", None, "", "\n\n", "é É\nonly", "É É\nonly"]
    + ["most\n" * 5 + "end %d" % n for n in range(9)]
)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_same_as_a_plain_count(spark, bound):
    docs = docs_of(spark, TEXTS)
    rows = sorted(lines.drop_shared_lines(docs, 10, bound, shard_keys=1).collect(), key=lambda r: r.doc_id)
    assert [r.kept for r in rows] == brute(TEXTS, 10)
    assert rows[0].n_lines == 4 and rows[0].n_dropped == 2 and rows[13].n_lines == 1
    rows = sorted(lines.drop_shared_lines(docs, 2, bound, shard_keys=2).collect(), key=lambda r: r.doc_id)
    assert [r.kept for r in rows] == brute(TEXTS, 2)


def test_perfect_hash_places_every_key_and_rejects_others():
    rng = np.random.default_rng(1)
    h, f = (rng.integers(0, 2**63, 50_000, dtype=np.uint64) for _ in "hf")
    h[1] = h[0]  # cannot be told apart by place
    counts = rng.integers(10, 1000, 50_000)
    made = lines.PerfectHash.build(h, f, counts)
    read = lines.PerfectHash.from_row(made.to_row(0))
    assert (read.count(h, f) == counts).all()
    assert not read.count(h, f + np.uint64(1)).any()
    assert not read.count(h + np.uint64(1), f ^ h).any()
    assert len(made.prints) == 50_000


def test_fingerprints_are_no_function_of_the_place(spark):
    """A hash of the first hash would tell nothing more; keys that share a place are still told apart."""
    row = spark.sql("select 'some line' as line").select(lines._hash(F.col("line")).alias("k"), F.xxhash64(F.lit(1)).alias("x")).select("k.h", "k.f", "x").first()
    again = spark.createDataFrame([(row.h,)], "h bigint").select(F.xxhash64("h", F.lit(1)), F.xxhash64(F.lit(1), "h"), F.xxhash64("h")).first()
    assert row.f not in again
    h = np.array([9, 9, 5], np.uint64)
    f = np.array([1, 2, 3], np.uint64)
    made = lines.PerfectHash.build(h, f, np.array([10, 20, 30]))
    assert made.count(h, f).tolist() == [10, 20, 30] and not made.count(h[:1], np.array([4], np.uint64)).any()


def test_odd_rows_repeats_and_no_documents(spark):
    docs = odd_docs(spark)
    rows = lines.drop_shared_lines(docs, 2, carry=True).collect()
    assert len(rows) == docs.count()
    assert {r.kept for r in rows if r.doc_id in (1, 2)} == {""}  # repeated rows are documents of their own
    assert all(r.row["keys"] == 7 for r in rows)
    assert lines.drop_shared_lines(no_docs(spark)).count() == 0
