"""Phrase and proximity matches against a plain search."""

import re

from data import docs_of, no_docs, odd_docs, prose

from arcloom.llm import decontaminate as dec
from arcloom.llm.common import texts


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, size=dec.WINDOW):
    out = []
    for text in docs:
        w, hit, found = words(text), set(), []
        for item_id, item in items:
            iw = words(item)
            n = min(size, len(iw))
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows] if n else []
            hit.update(j for i in at for j in range(i, i + n))
            found += [item_id] if at else []
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_matches_a_plain_search(spark):
    items = [prose(n, 25) for n in range(4)] + ["Short ITEM", "", None, prose(0, 25), "a a a a a a a a a a a a"]
    texts_ = [
        prose(50, 30) + " " + prose(1, 25).upper() + ". " + prose(51, 10),
        prose(52, 20) + ", " + " ".join(words(prose(0, 25))[5:18]) + " " + prose(53, 5),
        " ".join(words(prose(2, 25))[:9]) + " other", "the short, item here; short item", None, "", "a " * 40, prose(1, 25),
        prose(60, 200),
    ]
    docs = docs_of(spark, texts_)
    pairs = list(enumerate(items))
    bench = spark.createDataFrame(pairs, "item_id bigint, text string")
    rows = sorted(dec.contamination(docs.unionByName(docs), bench).collect(), key=lambda r: r.doc_id)
    got = [(r.n_words, r.n_hit, sorted(r.item_ids)) for r in rows]
    assert got[::2] == got[1::2] == brute(texts_, pairs)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, prose(1, 80)), (None, "one"), (3, None)], "item_id bigint, text string")
    rows = dec.contamination(docs, bench).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if 1 in r.item_ids} == {1, 2, 13}
    assert dec.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert dec.contamination(no_docs(spark), bench).count() == 0


def test_proximity(spark):
    item = prose(3, 10)
    w = words(item)
    close = w[:]
    close[4:4] = ["filler", "filler"]
    far = w[:5] + ["filler"] * 60 + w[5:]
    docs = texts(docs_of(spark, [item, " ".join(close), " ".join(far), prose(70, 50)]))
    windows = dec.item_windows(spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    index = dec.positional_index(docs, windows.selectExpr("explode(terms) AS term").distinct())
    near = {r.doc_id for r in dec.proximity_matches(index, windows, rare=10).collect()}
    assert near == {0, 1}
    assert {r.doc_id for r in dec.phrase_matches(index, windows).collect()} == {0}
