"""Versions that share id ranges: results, isolation, and what a short log costs."""

import pytest
from helpers import rows

from arcloom.operators import commands as cmd
from arcloom.schema import COMMAND
from arcloom.session import scratch_path
from arcloom.sources.ranges import RangedLinks


@pytest.fixture
def store(spark):
    return RangedLinks(spark, scratch_path(spark, "test-ranged"))


def log_of(spark, *commands):
    return spark.createDataFrame(commands, COMMAND)


def test_a_log_leads_to_the_same_table_and_old_versions_stay(spark, store, edge_links):
    with pytest.raises(LookupError):
        store.read()
    first = store.create(edge_links, width=3)
    assert (first.version, first.n_links, first.next_id) == (1, 7, 10)
    with pytest.raises(ValueError):
        store.create(edge_links)
    log = log_of(
        spark, (1, "delete", 9, None, None), (2, "update", 5, 2, 2), (3, "create", 40, None, None),
        (4, "create", 50, None, None), (5, "delete", 50, None, None), (6, "update", 77, 1, 1),
    )
    second = store.apply(log)
    after = rows(cmd.current_links(log, edge_links))
    assert rows(store.read()) == after
    # 50 was given out, though no link holds it any longer.
    assert (second.n_links, second.next_id) == (len(after), 51)
    assert rows(store.read(1)) == rows(edge_links)
    for pattern in ([5], [40], [50], [1000], [None, 1, None], [5, 2, None], []):
        kept = [l for l in after if not pattern or all(p is None or p == v for p, v in zip([*pattern, None, None], l))]
        assert rows(store.each(pattern)) == kept


def test_a_short_log_writes_little(spark, store):
    links = spark.range(1, 200_001).selectExpr("id", "id % 7 as source", "id % 11 as target")
    store.create(links, width=1000)
    log = log_of(spark, *[(n, "update", 20_000 + n, 1, n) for n in range(9)], (9, "delete", 199_999, None, None))
    version = store.apply(log)
    assert version.n_links == 199_999
    written = {r["range"]: r.n for r in store.index().where("written = 2").collect()}
    assert written == {20: 1000, 199: 999}
    assert sum(written.values()) < 0.05 * version.n_links
    # What is shared is read from where the first version put it.
    files = store.read().inputFiles()
    assert sum("/v=2/" in f for f in files) == 2 and sum("/v=1/" in f for f in files) == 199
    assert {f.split("/range=")[1].split("/")[0] for f in store.each([20_003]).inputFiles()} == {"20"}
    assert rows(store.each([20_003])) == [(20_003, 1, 3)]
    assert rows(store.each([20_003], version=1)) == [(20_003, 20_003 % 7, 20_003 % 11)]


def test_ranges_come_and_go(spark, store):
    store.create(spark.createDataFrame([], "id bigint, source bigint, target bigint"), width=10)
    assert store.read().count() == 0 and store.version().next_id == 1
    store.apply(log_of(spark, (1, "create", 5, None, None), (2, "create", 25, None, None)))
    assert [r["range"] for r in store.index().orderBy("range").collect()] == [0, 2]
    store.apply(log_of(spark, (1, "delete", 25, None, None)))
    assert [tuple(r) for r in store.index().collect()] == [(0, 2, 1)]
    version = store.apply(log_of(spark, (1, "delete", 5, None, None)))
    assert (version.n_links, version.next_id, store.read().count()) == (0, 26, 0)
    assert store.apply(log_of(spark)).n_links == 0
