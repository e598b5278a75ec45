"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs whole
into a sink that discards rows; the figure is the best of BENCH_RUNS runs after
one to warm up. BENCH_SHARED_DIR holds intermediate tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from arcloom.operators import reads, writes  # noqa: E402
from arcloom.plans import datasets  # noqa: E402
from arcloom.plans.catalog import QUERIES  # noqa: E402
from arcloom.session import build_session, scratch_path  # noqa: E402
from arcloom.sources.snapshots import LinkStore  # noqa: E402

HEADLINE = [
    "each_all",
    "each_identity",
    "each_outgoing",
    "each_incoming",
    "each_concrete",
    "get_links",
    "match_patterns",
    "match_patterns_shuffled",
    "count_patterns",
    "count_patterns_shuffled",
    "out_degree",
    "in_degree",
    "pair_multiplicity",
    "create_points",
    "bulk_update",
    "bulk_delete",
    "allocate_ids",
    "free_ids",
    "change_feed",
    "change_feed_split",
    "current_links",
    "current_links_on_base",
    "clustered_outgoing",
    "decode_documents",
    "bench_speedup",
    "stream_change_feed",
    "stream_links",
    "stream_folded_feed",
]
# Runs once: each run sets up a stream of its own.
ONCE = {"stream_change_feed", "stream_links", "stream_folded_feed"}


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def ns_per_link(spark, sf_dir: str, copies: int) -> dict[str, float]:
    """The eight basic operations in bulk, per link handled or returned.

    They run on the given links repeated ``copies`` times under new ids, so that
    the figures show throughput and not the cost of starting a job.
    """
    repeat = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    many = (
        datasets.links(spark, sf_dir)
        .select("*", repeat.alias("i"))
        .select(((F.col("id") - 1) * copies + F.col("i") + 1).alias("id"), "source", "target")
        .repartition(spark.sparkContext.defaultParallelism * 2)
    )
    store = LinkStore(spark, scratch_path(spark, "bench"))
    store.publish(many, copies=())
    links = store.read()
    n = links.count()
    third = links.where(F.col("id") % 3 == 0)

    def asked(*bound: str):
        """One pattern per value (or pair of values) the links have."""
        return links.select(*bound).distinct().select(
            F.monotonically_increasing_id().alias("pid"),
            *[
                (F.col(c) if c in bound else F.lit(None).cast("bigint")).alias(f"p_{c}")
                for c in ("id", "source", "target")
            ],
        )

    runs = {
        "create": (lambda: writes.create_points(links.select("id")), n),
        "update": (lambda: writes.bulk_update(links, links.select("id", "target", F.col("id").alias("source"))), n),
        "delete": (lambda: writes.bulk_delete(links, third), third.count()),
        "each_all": (lambda: reads.each(links), n),
        "each_identity": (lambda: reads.match_patterns(links, asked("id")), n),
        "each_concrete": (lambda: reads.match_patterns(links, asked("source", "target")), n),
        "each_outgoing": (lambda: reads.match_patterns(links, asked("source")), n),
        "each_incoming": (lambda: reads.match_patterns(links, asked("target")), n),
    }
    out = {"links": n}
    for name, (run, handled) in runs.items():
        seconds(run)
        out[name] = round(seconds(run) * 1e9 / handled, 1)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        # One machine, one process: a folder of its own is shared by all there is.
        spark__checkpoint__dir=os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names.split(",") if names else HEADLINE:
        query = lambda: QUERIES[name](spark, sf_dir)  # noqa: B023, E731
        if name in ONCE:
            times[name] = round(seconds(query), 3)
        else:
            seconds(query)
            times[name] = round(min(seconds(query) for _ in range(runs)), 3)
    rows = {
        "links": datasets.links(spark, sf_dir).count(),
        "pairs": datasets.pairs(spark, sf_dir).count(),
        "patterns": datasets.patterns(spark, sf_dir).count(),
    }
    copies = int(os.environ.get("BENCH_COPIES", "50"))
    per_link = ns_per_link(spark, sf_dir, copies) if copies else {}
    print(
        json.dumps(
            {
                "metric": "link_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "rows": rows,
                "ns_per_link": per_link,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
