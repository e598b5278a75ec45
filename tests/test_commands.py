"""The fold of a command log against a sequential loop."""

import random

import pytest
from helpers import rows

from arcloom.operators import commands as cmd
from arcloom.schema import COMMAND, FEED_COLUMNS, LINK

OPS = ["create", "create", "create_empty", "update", "update", "update", "delete", "bogus"]


def random_log(seed, n=300, ids=12, hot_share=0.4, start=0):
    """Duplicate creates, writes to absent ids, re-creation, a hot id, gaps in ``seq``."""
    rng = random.Random(seed)
    seq, log = start, []
    for _ in range(n):
        seq += rng.choice([1, 1, 1, 5, 40])
        op = rng.choice(OPS)
        link = 1 if rng.random() < hot_share else rng.randint(1, ids)
        ends = (rng.randint(0, 99), rng.randint(0, 99)) if op == "update" else (None, None)
        log.append((seq, op, link, *ends))
    return log


def replay(log, base=()):
    """One command at a time: outcomes and the final table."""
    table = {i: (s, t) for i, s, t in base}
    fates = []
    for seq, op, link, s, t in sorted(log):
        before = after = (0, 0)
        if op in ("create", "create_empty"):
            status = "already_exists" if link in table else "applied"
            if status == "applied":
                after = table[link] = (link, link) if op == "create" else (0, 0)
        elif op in ("update", "delete"):
            status = "applied" if link in table else "not_exists"
            if status == "applied":
                before = table.pop(link)
                if op == "update":
                    after = table[link] = (s or 0, t or 0)
        else:
            status = "unknown_op"
        fates.append((seq, link, op, status, *before, *after))
    return sorted(fates), sorted((i, *v) for i, v in table.items())


def random_base(seed):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 9), rng.randint(0, 9)) for i in range(1, 31) if rng.random() < 0.5]


SPLITS = [dict(parts=1), {}, dict(parts=20), dict(parts=90)]


@pytest.mark.parametrize("split", SPLITS, ids=str)
@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_the_loop(spark, seed, split):
    log = random_log(seed)
    fates, table = replay(log)
    commands = spark.createDataFrame(log, COMMAND).repartition(5)
    got = cmd.outcomes(commands, **split).persist()
    assert rows(got) == fates
    assert rows(cmd.latest_links(got)) == table
    assert rows(cmd.current_links(commands, **split)) == table
    feed = [(f[0], f[1], f[2], *f[4:]) for f in fates if f[3] == "applied"]
    assert rows(cmd.change_feed(got)) == feed
    assert cmd.change_feed(got).columns == FEED_COLUMNS
    assert rows(cmd.rejects(got)) == [f[:4] for f in fates if f[3] != "applied"]
    got.unpersist()


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("split", [SPLITS[0], SPLITS[3]], ids=str)
def test_fold_on_a_base(spark, split, small):
    log, base = random_log(5), random_base(5)
    fates, table = replay(log, base)
    commands = spark.createDataFrame(log, COMMAND)
    links = spark.createDataFrame(base, LINK)
    assert rows(cmd.outcomes(commands, links, small=small, **split)) == fates
    assert rows(cmd.current_links(commands, links, small=small, **split)) == table
    assert rows(links) == sorted(base)


def test_two_runs_from_one_base_agree(spark):
    commands = spark.createDataFrame(random_log(8), COMMAND)
    links = spark.createDataFrame(random_base(8), LINK)
    assert rows(cmd.current_links(commands, links)) == rows(cmd.current_links(commands, links))


def test_update_toggle_and_descending_deletes_restore_the_table(spark):
    points = [(i, i, i) for i in range(1, 11)]
    links = spark.createDataFrame(points, LINK)
    toggles, seq = [], 0
    for i in range(1, 11):
        for end in (0, i):
            toggles.append((seq, "update", i, end, end))
            seq += 1
    got = cmd.outcomes(spark.createDataFrame(toggles, COMMAND), links)
    assert cmd.change_feed(got).count() == 20
    assert rows(cmd.current_links(spark.createDataFrame(toggles, COMMAND), links)) == points
    made = [(n, "create", i, None, None) for n, i in enumerate(range(11, 31))]
    undone = [(100 + n, "delete", i, None, None) for n, i in enumerate(range(30, 10, -1))]
    assert rows(cmd.current_links(spark.createDataFrame(made + undone, COMMAND), links)) == points


def test_created_ids_are_stored(spark):
    """The state after creates holds exactly the ids of the feed, so a delete finds them."""
    log = [(n, "create", 4000 - n, None, None) for n in range(50)]
    got = cmd.outcomes(spark.createDataFrame(log, COMMAND))
    assert sorted(r.id for r in cmd.change_feed(got).collect()) == [
        r[0] for r in rows(cmd.latest_links(got))
    ]
    log.append((99, "delete", 4000, None, None))
    assert cmd.rejects(cmd.outcomes(spark.createDataFrame(log, COMMAND))).count() == 0


@pytest.mark.parametrize("gap, far", [(1, 0), (10**14, 0), (1, 9 * 10**18)])
def test_a_hot_id_is_cut_by_rows(spark, gap, far):
    """Whatever the gaps in ``seq``, and with one far-off number."""
    log = [(n * gap, "update", 1 if n % 4 else n, 0, 0) for n in range(4000)] + [(far, "create", 1, None, None)] * bool(far)
    laid = cmd.laid_out(spark.createDataFrame(log, COMMAND), parts=8)
    sizes = [r["count"] for r in laid.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(log) / 8
    assert laid.where("id = 1").select("part").distinct().count() >= 6


def test_empty_log(spark):
    none = spark.createDataFrame([], COMMAND)
    assert cmd.outcomes(none).count() == 0
    links = spark.createDataFrame(random_base(3), LINK)
    assert rows(cmd.current_links(none, links)) == rows(links)
