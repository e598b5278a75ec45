"""Benchmark passages in documents, found through a positional inverted index.

The index holds a posting ``(term, doc_id, version, pos)`` for every place of every
document where a term of the test items stands, written once by the tasks that cut
the documents into words: no shuffle, and a document's postings lie together.

A test item becomes windows of consecutive words. The terms of a window are ranked by
how often they occur in all documents. The postings of the rarest, moved back by its
offset, are the places where the window may begin; each following list is intersected
with these, rarest first, so that frequent terms are only looked up where all the rarer
ones agree. What is left are exact phrase matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm.common import same_row, texts, words
from arcloom.operators.sizing import BROADCAST_ROWS, sized
from arcloom.session import scratch_path

WINDOW = 10
# Lists intersected one at a time before the rest is checked in one step.
LEADS = (1, 2, 3)


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(window, item_ids, terms)``: the distinct windows of ``items (item_id, text)``.

    An item of fewer than ``size`` words, but not none, is one window. Equal windows
    of several items are one row that lists the items.
    """
    terms = words(F.coalesce("text", F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return (
        items.select("item_id", terms.alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("terms"))
        .groupBy("terms")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .select(F.xxhash64("terms").alias("window"), "item_ids", "terms")
    )


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``(term, doc_id, version, pos)`` of the given terms in all of ``docs``.

    ``docs`` is made by ``texts``; ``terms (term)`` are distinct. Positions count words from 0.
    """
    few = terms.count() <= BROADCAST_ROWS
    places = docs.select("doc_id", "version", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return _stored(places.join(sized(terms, few), "term"), "postings")


def _ranked(windows: DataFrame, index: DataFrame) -> DataFrame:
    """``(window, size, term, at, rank)``: the terms of each window, rarest first."""
    often = index.groupBy("term").agg(F.count("*").alias("places"))
    by_rarity = Window.partitionBy("window").orderBy("places", "at")
    return (
        windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
        .join(often, "term", "left")
        .withColumn("places", F.coalesce("places", F.lit(0)))
        .withColumn("rank", F.row_number().over(by_rarity))
        .select("window", "size", "term", "at", "rank")
    )


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``(window, size, doc_id, version, start)``: every place where a whole window stands."""
    ranked = _stored(_ranked(windows, index), "window-terms")
    few = ranked.count() <= BROADCAST_ROWS
    keys = ["window", "size", "doc_id", "version", "start"]

    lead = ranked.where(F.col("rank") == LEADS[0]).select("window", "size", "term", "at")
    found = (
        index.join(sized(lead, few), "term")
        .withColumn("start", F.col("pos") - F.col("at"))
        .where("start >= 0")
        .select(keys)
        .distinct()  # repeated rows of a document repeat its postings
    )
    for ranks in [F.col("rank") == n for n in LEADS[1:]] + [F.col("rank") > LEADS[-1]]:
        asked = ranked.where(ranks).select("window", "term", "at")
        lists = index.join(sized(asked.select("term").distinct(), few), "term", "left_semi")
        # How many terms of this step a window has; shorter windows may have none left.
        wanted = asked.groupBy("window").agg(F.count("*").alias("wanted"))
        found = _stored(found, "starts")
        left = found.select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
        if left.count() <= BROADCAST_ROWS:
            # Postings of documents that are out already need not be shuffled.
            still = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
            lists = lists.join(F.broadcast(left), still, "left_semi")
        need = found.join(sized(asked, few), "window").withColumn("pos", F.col("start") + F.col("at"))
        held = need.alias("n").join(
            lists.alias("l"),
            F.col("n.doc_id").eqNullSafe(F.col("l.doc_id"))
            & (F.col("n.version") == F.col("l.version"))
            & (F.col("n.pos") == F.col("l.pos"))
            & (F.col("n.term") == F.col("l.term")),
            "left_semi",
        )
        full = (
            held.groupBy(keys).agg(F.count("*").alias("held"))
            .join(sized(wanted, few), "window")
            .where("held = wanted")
            .select(keys)
        )
        done = found.join(sized(wanted, few), "window", "left_anti").select(keys)
        found = full.unionByName(done)
    return _stored(found, "matches")


def proximity_matches(index: DataFrame, windows: DataFrame, rare: int = 3, slack: int = 5) -> DataFrame:
    """``(window, doc_id, version, pos)``: places near which the rarest terms of a window gather.

    ``pos`` is a place of the rarest term. The next rarest, ``rare`` in all, must each
    stand at most ``slack`` words from where the window would have them. Places are
    joined by blocks of ``slack + 1`` words, never a whole document with itself.
    """
    ranked = _stored(_ranked(windows, index), "window-terms")
    few = ranked.count() <= BROADCAST_ROWS
    keys = ["window", "doc_id", "version", "lead"]
    block = F.lit(slack + 1)
    lead = ranked.where("rank = 1").select("window", "term", F.col("at").alias("lead_at"))
    found = index.join(sized(lead, few), "term").withColumnRenamed("pos", "lead").drop("term")
    for n in range(2, rare + 1):
        asked = ranked.where(F.col("rank") == n).select("window", "term", "at")
        lists = index.join(sized(asked.select("term").distinct(), few), "term", "left_semi").select(
            F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("term").alias("t"), F.col("pos"),
            F.floor(F.col("pos") / block).alias("b"),
        )
        found = _stored(found, "near")
        near = (
            found.join(sized(asked, few), "window")
            .withColumn("want", F.col("lead") - F.col("lead_at") + F.col("at"))
            .withColumn("block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                                       lambda i: F.floor(F.col("want") / block) + i)))
        )
        held = near.join(
            lists,
            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
            & (F.col("term") == F.col("t")) & (F.col("block") == F.col("b"))
            & (F.abs(F.col("pos") - F.col("want")) <= slack),
            "left_semi",
        ).select(*keys, "lead_at").distinct()
        short = found.join(sized(asked, few), "window", "left_anti").select(*keys, "lead_at")
        found = held.unionByName(short)
    return found.select("window", "doc_id", "version", F.col("lead").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(doc_id, version, n_words, n_hit, item_ids)`` for each row of ``docs (doc_id, text)``.

    ``n_hit`` counts the words inside any occurrence of a window of ``items (item_id,
    text)``, ``item_ids`` lists the items with such a window (empty if none). A null
    text has no words; items without words have no windows; repeated rows of ``docs``
    all get the same result, repeated items are one.
    """
    docs = texts(docs)
    windows = _stored(item_windows(items, size), "windows")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    index = positional_index(docs, terms)
    matches = phrase_matches(index, windows)
    key = ["doc_id", "version"]
    hit = (
        matches.select(*key, F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos"))
        .distinct().groupBy(key).agg(F.count("*").alias("n_hit"))
    )
    which = (
        matches.select(*key, "window").distinct()
        .join(windows.select("window", "item_ids"), "window")
        .select(*key, F.explode("item_ids").alias("item_id"))
        .groupBy(key).agg(F.collect_set("item_id").alias("item_ids"))
    )
    facts = hit.join(which.withColumnsRenamed({"doc_id": "d", "version": "v"}),
                     F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")))
    facts = facts.select("doc_id", "version", "n_hit", "item_ids")
    counted = docs.select("doc_id", "version", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return (
        counted.alias("c").join(facts.alias("f"), same_row(counted, facts), "left")
        .select("c.*", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))
    )
