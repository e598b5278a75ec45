"""Single and many-pattern reads against brute force and against each other."""

from itertools import product

import pytest
from helpers import rows
from pyspark.sql import functions as F

from arcloom.functions.patterns import from_arrays, normalise, predicate
from arcloom.operators import counts, reads
from arcloom.schema import LINK, PATTERN


def brute(links, pattern):
    return sorted(l for l in links if all(p is None or p == v for p, v in zip(pattern, l)))


def all_masks():
    """Each mask with a hit and a miss; 0 is an ordinary value."""
    hit, miss, zero = (3, 1, 2), (3, 1, 77), (2, 0, 0)
    out = []
    for values in (hit, miss, zero):
        for bound in product([False, True], repeat=3):
            out.append(tuple(v if b else None for v, b in zip(values, bound)))
    return out


def pattern_table(spark, patterns):
    return spark.createDataFrame([(n, *p) for n, p in enumerate(patterns)], PATTERN)


@pytest.mark.parametrize("pattern", sorted(set(all_masks()), key=str))
def test_each_and_count_on_every_mask(edge_links, pattern):
    expected = brute(rows(edge_links), pattern)
    assert rows(reads.each(edge_links, pattern)) == expected
    assert counts.count_links(edge_links, pattern).first().n == len(expected)


def test_short_patterns(edge_links):
    everything = rows(edge_links)
    for pattern in ([], [None], [None, None, None]):
        assert rows(reads.each(edge_links, pattern)) == everything
    assert rows(reads.each(edge_links, [4])) == [(4, 1, 2)]
    assert predicate([]) is None


@pytest.mark.parametrize("pattern", [[1, 2], [1, 2, 3, 4]])
def test_other_lengths_are_refused(pattern):
    with pytest.raises(ValueError):
        normalise(pattern)


def test_arrays_as_patterns(spark):
    given = spark.createDataFrame(
        [(0, []), (1, [5]), (2, [1, None, 2]), (3, [1, 2]), (4, [1, 2, 3, 4]), (5, None)],
        "pid bigint, pattern array<bigint>",
    )
    got = {r.pid: (r.ok, r.p_id, r.p_source, r.p_target) for r in from_arrays(given).collect()}
    assert got[0] == (True, None, None, None)
    assert got[1] == (True, 5, None, None)
    assert got[2] == (True, 1, None, 2)
    assert [got[n][0] for n in (3, 4, 5)] == [False, False, False]


def test_get_link_and_links(spark, edge_links):
    assert tuple(reads.get_link(edge_links, 6)) == (6, 1, 6)
    assert reads.get_link(edge_links, 7) is None
    asked = spark.createDataFrame([(6,), (7,), (6,), (2,)], "id bigint")
    expected = [(2, 0, 0, True), (6, 1, 6, True), (6, 1, 6, True), (7, 0, 0, False)]
    for small in (None, True, False):
        assert rows(reads.get_links(edge_links, asked, small)) == expected


def test_early_stop(edge_links):
    assert rows(reads.each_until(edge_links, F.col("target") == 2)) == [(1, 1, 1), (2, 0, 0), (3, 1, 2)]
    assert rows(reads.each_until(edge_links, F.lit(False))) == rows(edge_links)
    got = rows(reads.each_until(edge_links, F.col("id") >= 4, [None, 1, None]))
    assert got == [(1, 1, 1), (3, 1, 2), (4, 1, 2)]
    assert reads.each_first(edge_links, 3).count() == 3


@pytest.mark.parametrize("small", [None, True, False])
def test_many_patterns_are_the_union_of_single_reads(spark, edge_links, small):
    patterns = all_masks()
    bound = [p for p in patterns if p != (None, None, None)]
    links = rows(edge_links)
    expected = sorted((n, *l) for n, p in enumerate(bound) for l in brute(links, p))
    got = reads.match_patterns(edge_links, pattern_table(spark, bound), small=small)
    assert rows(got) == expected
    everything = sorted((n, *l) for n, p in enumerate(patterns) for l in brute(links, p))
    got = reads.match_patterns(edge_links, pattern_table(spark, patterns), allow_all=True, small=small)
    assert rows(got) == everything
    counted = counts.count_patterns(edge_links, pattern_table(spark, patterns), small=small)
    assert rows(counted) == [(n, len(brute(links, p))) for n, p in enumerate(patterns)]


@pytest.mark.parametrize("small", [True, False])
def test_all_any_needs_opt_in(spark, edge_links, small):
    with pytest.raises(ValueError, match="allow_all"):
        reads.match_patterns(edge_links, pattern_table(spark, [(1, None, None), (None,) * 3]), small=small)


@pytest.mark.parametrize("small", [True, False])
def test_hub_with_a_third_of_the_links(spark, small):
    """A hub asked for by many equal patterns is counted right, by either way."""
    links = spark.range(1, 3001).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("source"),
        (F.col("id") % 10).alias("target"),
    )
    patterns = spark.range(500).select(
        F.col("id").alias("pid"),
        F.lit(None).cast("bigint").alias("p_id"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).cast("bigint").alias("p_source"),
        F.lit(None).cast("bigint").alias("p_target"),
    )
    got = {r.pid: r.n for r in counts.count_patterns(links, patterns, small=small).collect()}
    assert len(got) == 500
    assert {got[n] for n in range(0, 500, 2)} == {1001}
    assert got[7] == 1 and got[9] == 0
    few = patterns.where("pid < 4")
    assert reads.match_patterns(links, few, small=small).count() == 1001 * 3


def test_empty_tables(spark, edge_links):
    none = spark.createDataFrame([], LINK)
    assert counts.max_id(none).first().max_id == 0
    assert counts.count_links(none).first().n == 0
    no_patterns = spark.createDataFrame([], PATTERN)
    assert reads.match_patterns(edge_links, no_patterns).count() == 0
    assert counts.count_patterns(none, pattern_table(spark, [(None, 1, None), (None,) * 3])).collect() == [
        (0, 0),
        (1, 0),
    ]


def test_degrees(edge_links):
    assert rows(counts.out_degree(edge_links)) == [(0, 1), (1, 4), (5, 1), (9, 1)]
    assert rows(counts.in_degree(edge_links)) == [(0, 1), (1, 2), (2, 2), (6, 1), (9, 1)]
    assert (1, 2, 2) in rows(counts.pair_multiplicity(edge_links))


def test_visit_runs_on_every_row(spark, edge_links):
    seen = spark.sparkContext.accumulator(0)
    reads.visit(edge_links, lambda row: seen.add(row["id"]))
    assert seen.value == 1 + 2 + 3 + 4 + 5 + 6 + 9


def test_a_key_asked_often_is_matched_in_many_places(spark):
    """A target of 3,000 links and 3,000 patterns, and one of 2,500 links asked 2,000 times with its source."""
    links = spark.range(1, 6001).select(
        "id", F.when(F.col("id") <= 3000, F.col("id")).otherwise(7).cast("bigint").alias("source"),
        F.when(F.col("id") <= 3000, 1).otherwise(F.when(F.col("id") <= 5500, 2).otherwise(F.col("id"))).cast("bigint").alias("target"),
    )
    nothing = F.lit(None).cast("bigint")
    one = spark.range(3000).select(F.col("id").alias("pid"), nothing.alias("p_id"), nothing.alias("p_source"), F.lit(1).cast("bigint").alias("p_target"))
    two = spark.range(3000, 5000).select(
        F.col("id").alias("pid"), nothing.alias("p_id"), F.lit(7).cast("bigint").alias("p_source"), F.lit(2).cast("bigint").alias("p_target")
    )
    patterns = one.unionByName(two)
    assert {(r.k1, r.k2, r.link_parts, r.asked_parts) for r in reads.heavy_keys(links, reads.keyed_patterns(patterns)).collect()} == {
        (1, 0, 2, 2), (7, 2, 2, 1)
    }
    found = reads.match_patterns(links, patterns, small=False)
    per = found.groupBy("target", "pid").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count_distinct("id").alias("d"))
    sums = {(r.target, r.n, r.d, r.ids): r.pids for r in per.groupBy("target", "n", "d", "ids").agg(F.count("*").alias("pids")).collect()}
    assert sums == {(1, 3000, 3000, sum(range(1, 3001))): 3000, (2, 2500, 2500, sum(range(3001, 5501))): 2000}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = reads.match_patterns(links, patterns, small=False)
        places = found.where("target = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(places) > 1 and sum(r["count"] for r in places) == 9_000_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
