"""Weighted MinHash against exact likeness, and classes against all pairs."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from data import docs_of, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from arcloom.llm import neardup
from arcloom.llm.common import words
from arcloom.llm.components import components


def likeness(a, b):
    x, y = Counter(a), Counter(b)
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 1.0


def test_registers_agree_as_often_as_weighted_likeness():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    bags = [np.repeat(base, rng.integers(1, 12, 60)), np.repeat(base, rng.integers(1, 12, 60)), base[:30], base[15:], base[:1]]
    times = neardup.bag_min_hash(bags, 4000)
    assert np.isfinite(times).all()
    for i, j in itertools.combinations(range(len(bags)), 2):
        want = likeness(bags[i].tolist(), bags[j].tolist())
        assert abs((times[i] == times[j]).mean() - want) < 0.04
        assert abs(neardup.bag_likeness(np.sort(bags[i]), np.sort(bags[j])) - want) < 1e-12
    # A document's registers do not depend on the batch it is in.
    assert (neardup.bag_min_hash(bags[1:2], 4000)[0] == times[1]).all()


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    lonely = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {n: r for n, r in root.items() if n not in lonely}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def edit(text, n, seed):
    rnd, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = prose(rnd.randrange(10**6) + 10**6, 1)
    return " ".join(words)


def family(seed):
    """A base, copies of it that are mostly unlike each other, and copies of copies."""
    base = prose(seed, 300)
    first = [edit(base, 4, seed * 1000 + i) for i in range(25)]
    return [base, *first, *[edit(t, 4, seed * 2000 + i) for i, t in enumerate(first[:6])]]


def test_classes_are_those_of_all_pairs(spark):
    texts = family(1) + [prose(n, 120) for n in range(40, 60)] + family(2)
    texts += [texts[3], texts[3].upper() + " !", "", "", " ", "a b", "a b", "A, b", prose(90, 4)]
    random.Random(8).shuffle(texts)
    rows = neardup.NearCopies().classes(docs_of(spark, texts)).collect()
    bags = []
    for r in docs_of(spark, texts).select("doc_id", words(F.col("text")).alias("w")).sort("doc_id").collect():
        n = min(5, len(r.w))
        bags.append([tuple(r.w[i : i + n]) for i in range(len(r.w) - n + 1)] if n else [])
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        alike = texts[i] == texts[j] or (bags[i] and bags[j] and likeness(bags[i], bags[j]) >= neardup.LIKENESS)
        if alike:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    assert {r.doc_id: r.class_id for r in rows} == {i: top(i) for i in range(len(texts))}
    sizes = Counter(top(i) for i in range(len(texts)))
    assert all(r.class_size == sizes[r.class_id] for r in rows)
    kept = neardup.NearCopies().first_of_each(docs_of(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(sizes)


@pytest.mark.parametrize("tile", [256, 30])
def test_templated_texts_stay_apart_without_pairs(spark, tile, monkeypatch):
    """Hundreds of texts alike at about 0.7 through a common core, and a few that two of them link to."""
    monkeypatch.setattr(neardup, "TILE", tile)
    core = prose(7, 240)
    texts = [f"{prose(1000 + i, 22)} {core} {prose(5000 + i, 22)}" for i in range(300)]
    bags = [neardup.bag_set(neardup.shingle_hashes(np.array([hash(w) for w in t.split()]))) for t in texts[:40]]
    assert 0.65 < np.mean([neardup.set_likeness(bags[0], b) for b in bags[1:]]) < 0.75
    texts += [edit(texts[i], 3, i) for i in (5, 6, 299)]
    rows = neardup.NearCopies().classes(docs_of(spark, texts)).collect()
    near = {300: 5, 301: 6, 302: 299}
    assert {r.doc_id: r.class_id for r in rows} == {i: near.get(i, i) for i in range(len(texts))}


def test_sets_of_bags():
    rng = np.random.default_rng(5)
    bags = [rng.integers(0, 40, rng.integers(0, 90)).astype(np.uint64) for _ in range(30)]
    sets = [neardup.bag_set(b) for b in bags]
    counts = neardup.shared_counts(sets, sets)
    for i, j in itertools.product(range(30), repeat=2):
        want = likeness(bags[i].tolist(), bags[j].tolist())
        assert abs(neardup.set_likeness(sets[i], sets[j]) - want) < 1e-12
        assert counts[i, j] == sum((Counter(bags[i].tolist()) & Counter(bags[j].tolist())).values())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = neardup.NearCopies().classes(docs).collect()
    assert len(rows) == docs.count()
    assert {r.class_id for r in rows if r.doc_id in (1, 2, 13)} == {1}
    kept = neardup.NearCopies().first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # Of the null and the empty text the null id comes first; both texts of id 11 stay.
    assert sorted(i for i in ids if i is not None) == [1, 5, 6, 7, 8, 9, 10, 11, 11, 12] and ids.count(None) == 2
    assert neardup.NearCopies().classes(no_docs(spark)).count() == 0
