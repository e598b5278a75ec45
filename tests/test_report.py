"""The benchmark report: published figures, a broken run, and the table text."""

import random

import pytest
from helpers import rows

from arcloom.plans import report
from arcloom.session import scratch_path
from arcloom.sources import benchlog
from arcloom.sources.benchlog import BACKENDS, Families

PUBLISHED = {
    "Create": ([84823, 86001, 84120, 83188, 3159452615, 3107071983], "36630.1 36128.3 36936.2 37350.0"),
    "Update": ([1484, 1539, 833, 836, 38993916, 39342594], "26276.2 25337.2 46811.4 46643.4"),
    "Delete": ([143527, 153180, 145585, 143649, 1989558566, 1966720201], "13702.8 12839.3 13509.1 13691.2"),
    "Each All": ([74, 77, 78, 77, 943914, 925040], "12500.5 12013.5 11859.5 12013.5"),
    "Each Identity": ([348, 348, 348, 348, 8801871, 8759426], "25170.8 25170.8 25170.8 25170.8"),
    "Each Concrete": ([439, 438, 470, 451, 8816664, 8780803], "20001.8 20047.5 18682.6 19469.6"),
    "Each Outgoing": ([677, 493, 422, 408, 8729692, 8753819], "12894.7 17707.3 20686.5 21396.3"),
    "Each Incoming": ([671, 487, 411, 411, 8742366, 8792452], "13028.9 17951.5 21271.0 21271.0"),
}
NAMES = [
    "Local_United_Volatile", "Local_United_NonVolatile", "Local_Split_Volatile",
    "Local_Split_NonVolatile", "Remote_NonTransaction", "Remote_Transaction",
]


def figure(op, backend, ns, dev=3):
    return f"test {op.replace(' ', '_')}/{backend} ... bench: {ns:>11} ns/iter (+/- {dev})"


def log(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string").repartition(3)


@pytest.fixture(scope="module")
def published(spark):
    lines = [
        figure(op, name, ns)
        for op, (values, _) in PUBLISHED.items()
        for name, ns in zip(NAMES, values)
    ]
    random.Random(3).shuffle(lines)
    return report.comparison(report.last_figures(benchlog.parse_lines(log(spark, lines))))


def test_published_table_recomputes(published):
    got = report.speedups(published).orderBy("rank").collect()
    assert [r.op for r in got] == list(PUBLISHED)
    for row in got:
        values, gains = PUBLISHED[row.op]
        wanted = [f"{v} ({g}x faster)" for v, g in zip(values, gains.split())] + [str(v) for v in values[4:]]
        assert [row[b] for b in BACKENDS] == wanted


def test_markdown(published):
    lines = report.markdown(report.speedups(published), Families("Embedded", "Graph")).split("\n")
    assert len(lines) == 10 and all(l.count("|") == 8 for l in lines)
    assert lines[0].startswith("| Operation     | Embedded United Volatile | Embedded United NonVolatile |")
    assert lines[0].endswith("| Graph NonTransaction | Graph Transaction |")
    assert lines[1].startswith("|---------------|--------------------------|")
    assert lines[2].startswith("| Create        | 84823 (36630.1x faster)  | ")


def test_visible_floor(published):
    top = report.highest(published).first().highest
    assert top == 3159452615
    for row in report.visible(published).collect():
        for b, raw in zip(BACKENDS, PUBLISHED[row.op][0]):
            assert row[b] == max(float(raw), top * 0.005)


def test_gaps_in_the_table(spark):
    lines = [figure("Update", NAMES[0], 0), figure("Update", NAMES[1], 10), figure("Delete", NAMES[5], 25),
             figure("Delete", NAMES[0], 20)]
    table = report.comparison(report.last_figures(benchlog.parse_lines(log(spark, lines))))
    got = {r.op: r for r in report.speedups(table).collect()}
    assert len(got) == 8
    assert got["Update"].united_volatile == "N/A"
    assert got["Update"].united_nonvolatile == "10"
    assert got["Update"].remote_transaction == "N/A"
    assert got["Delete"].united_volatile == "20 (1.2x faster)"
    assert got["Delete"].remote_nontransaction == "N/A"
    assert {r.op: r.united_volatile for r in report.visible(table).collect()}["Create"] == 0.0


def test_later_lines_win_and_odd_names_fall_to_defaults(spark):
    lines = [
        figure("Create", NAMES[0], 1),
        figure("Create", NAMES[0], 2) + " " + figure("Create", NAMES[0], 3),
        figure("Create", "Local_Other_Volatile", 4),
        figure("Create", "Local_United_Other", 5),
        figure("Create", "Remote_Other", 6),
        figure("Create", "Local_Alone", 7),
        figure("Create", "Unknown_United_Volatile", 8),
        "test Create/Local_United_Volatile ... bench: 9 ns/iter",
        "test Create/Local_United_Volatile ... ",
    ]
    parsed = benchlog.parse_lines(log(spark, lines))
    assert rows(report.last_figures(parsed)) == [
        ("Create", "remote_nontransaction", 6),
        ("Create", "split_volatile", 4),
        ("Create", "united_nonvolatile", 5),
        ("Create", "united_volatile", 3),
    ]
    assert {r.dev for r in parsed.collect()} == {3}


BROKEN_RUN = [
    "Warning: Unable to complete 100 samples in 5.0s. You may wish to increase target time to 2246.0s.",
    "run\tSTEP\t" + figure("Create", NAMES[4], 3263324097),
    "run\tSTEP\t" + figure("Create", NAMES[5], 3125736807),
    *("run\tSTEP\t" + figure("Create", n, v) for n, v in zip(NAMES, (97099, 99055, 84602, 83718))),
    "run\tSTEP\t" + figure("Delete", NAMES[4], 1988067696),
    "run\tSTEP\tthread 'main' panicked at 'called `Result::unwrap()` on an `Err` value: NotExists(4000)'",
    "run\tSTEP\ttest Delete/Remote_Transaction ... ",
    "run\tSTEP\t\x1b[0m\x1b[0m\x1b[1m\x1b[31merror\x1b[0m\x1b[1m:\x1b[0m bench\x1b[0m failed",
]


def test_a_broken_run_is_not_complete(spark):
    lines = log(spark, BROKEN_RUN)
    figures = report.last_figures(benchlog.parse_lines(lines))
    assert figures.count() == 7
    assert report.missing_figures(figures).count() == 41
    assert benchlog.failure_lines(lines).count() == 2


def test_lines_of_a_split_file_keep_their_order(spark):
    path = scratch_path(spark, "log")
    many = [figure("Create", NAMES[0], n) for n in range(20000)]
    spark.createDataFrame([(l,) for l in many], "line string").coalesce(1).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        lines = benchlog.read_log(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        place = ("file", "block", "row")
        got = report.last_figures(benchlog.parse_lines(lines, order=place), place).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == [("Create", "united_volatile", 19999)]


def test_figures_that_cannot_be_read_are_told(spark):
    lines = [
        (1, "test Create/Local_United_Volatile ... bench: 99999999999999999999 ns/iter (+/- 1)"),
        (2, "test Update/Local_United_Volatile ..."),
        (3, "test Delete/Local_United_Volatile ... bench: 12 ns/iter (+/- 1)"),
        (4, "plain"),
    ]
    df = spark.createDataFrame(lines, "line_no bigint, line string")
    assert [r.line_no for r in benchlog.parse_lines(df).collect()] == [3]
    assert sorted(r.line_no for r in benchlog.unread_lines(df).collect()) == [1, 2]
