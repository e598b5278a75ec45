"""Chains and alignments against plain searches; planted passages are found."""

import itertools
import random

import numpy as np
from data import docs_of, no_docs, odd_docs, prose

from arcloom.llm import passages


def test_chain_scores_are_the_best_there_are():
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(1, 9)
        pairs = sorted({(rnd.randrange(20), rnd.randrange(20)) for _ in range(n)})
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        best = 0.0
        for k in range(1, len(pairs) + 1):
            for some in itertools.combinations(range(len(pairs)), k):
                if all(a[i] < a[j] and b[i] < b[j] for i, j in zip(some, some[1:])):
                    span = a[some[-1]] - a[some[0]] + b[some[-1]] - b[some[0]]
                    best = max(best, 5 * k - 0.1 * span)
        made = passages.chains(a, b, 5, 0.1, 1000)
        assert sorted(i for c in made for i in c) == list(range(len(pairs)))
        first = made[0]
        span = a[first[-1]] - a[first[0]] + b[first[-1]] - b[first[0]]
        assert abs(5 * len(first) - 0.1 * span - best) < 1e-9
        for c in made:
            assert all(a[i] < a[j] and b[i] < b[j] for i, j in zip(c, c[1:]))


def test_steps_within_reach_are_the_best_there_are():
    rnd = random.Random(3)
    for _ in range(200):
        pairs = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(rnd.randint(1, 30))})
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        best = []
        for i, (x, y) in enumerate(pairs):
            steps = [best[j] - 0.1 * (x - u + y - v) for j, (u, v) in enumerate(pairs[:i]) if 0 < x - u <= 9 and 0 < y - v <= 9]
            best.append(5 + max([0, *steps]))
        first = passages.chains(a, b, 5, 0.1, 9)[0]
        span = a[first[-1]] - a[first[0]] + b[first[-1]] - b[first[0]]
        assert abs(5 * len(first) - 0.1 * span - max(best)) < 1e-9
        assert all(0 < a[j] - a[i] <= 9 and 0 < b[j] - b[i] <= 9 for i, j in zip(first, first[1:]))


def test_two_passages_of_one_pair_are_both_found(spark):
    one, two = prose(600, 60), prose(601, 60)
    texts = [" ".join([prose(610 + n, 40), one, prose(620 + n, 100), two, prose(630 + n, 40)]) for n in range(2)]
    whole = (one + " " + two).split()
    texts += [prose(640, 30) + " " + " ".join(whole), " ".join([*whole[:60], *prose(641, 70).split(), *whole[60:], prose(642, 30)])]
    found, _ = passages.SharedPassages().find(docs_of(spark, texts[:2]))
    assert sorted((r.start, r.end) for r in found.collect()) == [(40, 100), (200, 260)]
    found, _ = passages.SharedPassages().find(docs_of(spark, texts[2:]))
    words = {i: t.split() for i, t in enumerate(texts[2:])}
    held = [words[r.doc_id][r.start : r.end] for r in found.collect()]
    assert sorted(held) == sorted([whole[:60], whole[60:]])


def shared_runs(texts, size=50):
    """``(text, start)`` of each run of ``size`` words that another text holds too."""
    at = {}
    for n, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - size + 1):
            at.setdefault(tuple(w[i : i + size]), []).append((n, i))
    return [p for places in at.values() if len({n for n, _ in places}) > 1 for p in places]


def uncovered(spark, texts):
    found, _ = passages.SharedPassages().find(docs_of(spark, texts))
    spans = {}
    for r in found.collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
        spans.setdefault(r.other_id, []).append((r.other_start, r.other_end))
    return [(n, i) for n, i in shared_runs(texts) if not any(s <= i and i + 50 <= e for s, e in spans.get(n, []))]


def test_repeated_lines_and_frequent_lines_are_covered(spark):
    frequent = [prose(700 + n, 20) for n in range(6)]
    texts = [" ".join([prose(800 + n, 30), frequent[n % 6], prose(900 + n, 30)]) for n in range(60)]
    # Only these two hold three frequent lines in a row.
    texts += [" ".join([prose(950 + n, 40), *frequent[1:4], prose(960 + n, 40)]) for n in range(2)]
    # Lines that repeat within a text, from different ones on, and a passage twice in a text.
    line, twice = prose(970, 12), prose(971, 60)
    texts += [" ".join([prose(972 + n, 20 + n), *[line] * (9 + 4 * n)]) for n in range(3)]
    texts += [" ".join([prose(980 + n, 30), twice, prose(985 + n, 90), twice]) for n in range(2)]
    # Two shared stretches with so many other words between that the whole is too unlike.
    one, two = prose(990, 60), prose(991, 60)
    texts += [one + " " + prose(992, 57) + " " + two, one + " " + prose(993, 57) + " " + two]
    assert {n for n, _ in shared_runs(texts)} == set(range(60, 69))
    assert uncovered(spark, texts) == []


def test_same_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(100):
        x, y = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in itertools.product(range(len(x)), range(len(y))):
            table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        assert passages.same_words(x, y, 20) == table[-1, -1]


def test_planted_passages_are_found(spark):
    passage = prose(500, 70).split()
    fuzzy = passage[:]
    for at in (15, 32, 50):
        fuzzy[at] = "changed"
    del fuzzy[60]
    texts = [prose(n, 100) for n in range(12)]
    for n, words in ((2, passage), (5, passage), (7, fuzzy), (9, passage)):
        texts[n] += " " + " ".join(words) + " " + prose(n + 900, 30)
    texts += [texts[4], texts[4], " ".join(passage[:40]) + " " + prose(77, 60)]
    found, members = passages.SharedPassages().find(docs_of(spark, texts))
    rows = found.collect()
    assert {i for r in rows for i in (r.doc_id, r.other_id)} == {2, 5, 7, 9}
    for r in rows:
        assert r.end - r.start >= 65 and r.likeness > 0.85
        assert texts[r.doc_id].split()[r.start : r.start + 3] == texts[r.other_id].split()[r.other_start : r.other_start + 3]
    assert {(r.doc_id, r.first) for r in members.collect() if r.doc_id != r.first} == {(12, 4), (13, 4)}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    found, members = passages.SharedPassages().find(docs)
    assert {(r.doc_id, r.other_id) for r in found.collect()} <= {(1, 13), (13, 1)}
    assert found.count() == 1 and members.count() == docs.count()
    found, members = passages.SharedPassages().find(no_docs(spark))
    assert found.count() == members.count() == 0


def test_fenwick_maxima_are_those_of_a_plain_search():
    rnd = random.Random(5)
    for reach in (1, 2, 7, 60):
        behind, held = passages.Behind(reach), []
        for n in range(300):
            at, value = rnd.randrange(200), float(rnd.randrange(50))
            behind.put(at, value, n)
            held.append((at, value))
            asked = rnd.randrange(260)
            best = max([v for p, v in held if asked - reach <= p < asked], default=passages.NOTHING[0])
            assert behind.best(asked)[0] == best


def test_parts_that_rise_throughout_are_the_chains_of_a_plain_search():
    rnd = random.Random(6)
    plain_parts = 0
    for _ in range(200):
        pairs = sorted({(x, x + rnd.choice([0, 0, 0, 0, 3])) for x in rnd.sample(range(600), rnd.randint(1, 30))})
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        starts, plain = passages.rising(np.zeros(len(a), np.int64), a, b, 5, 0.1, 60)
        made = []
        for first, end, one in zip(starts, [*starts[1:], len(a)], plain):
            part = list(range(first, end))
            made += [part] if one else [[first + i for i in c] for c in passages.chains(a[first:end], b[first:end], 5, 0.1, 60)]
            plain_parts += one
        assert sorted(made) == sorted(passages.chains(a, b, 5, 0.1, 60))
    assert plain_parts > 100


def test_keys_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, most, n) for most, n in ((3, 50), (9999, 400), (1, 77), (30, 500), (9999, 51))]

    def rows(found, off=0):
        return {(int(t) + off, *map(int, x)) for t, *x in zip(*found)}

    together = rows(passages.keys(texts, 5, 10, 4, 50))
    assert together == set().union(*[rows(passages.keys([t], 5, 10, 4, 50), n) for n, t in enumerate(texts)])
    # Every window of a text's seeds, and each window of 50 words with fewer than 25 distinct ones.
    for n, t in enumerate(texts):
        dull = {i for i in range(len(t) - 49) if len(set(t[i : i + 50].tolist())) < 25}
        assert {x[2] for x in together if x[0] == n and x[5] == -1} == dull


def test_equal_ends_are_aligned_beyond_the_band():
    """Words between seeds that are equal but for an insertion lose nothing to a band."""
    left = np.arange(100)
    right = np.concatenate([left[:50], [1000], left[50:]])
    assert passages._between(left, right) == 100 and passages._between(right, left) == 100
    assert passages._between(left, left) == 100 and passages._between(left[:0], right) == 0


def test_many_parts_are_chained_as_each_alone(monkeypatch):
    rnd = np.random.default_rng(5)
    parts = []
    for n in range(60):
        x = rnd.integers(0, (200, 90, 20)[n % 3], 120) + 1000 * (n % 7)
        parts.append(np.unique(np.stack([x, rnd.integers(0, (200, 30, 90)[n % 3], 120) + n], 1), axis=0))
    for reach in (60, 9):
        alone = [passages.chains(p[:, 0], p[:, 1], 5, 0.1, reach) for p in parts]
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        a, b = np.concatenate(parts).T
        starts = np.cumsum([0, *map(len, parts)])
        expected = sorted([int(starts[n]) + i for i in c] for n, made in enumerate(alone) for c in made)
        score, back = passages.scores(part, a, b, 5, 0.1, reach)
        assert sorted(passages.taken(score, back.tolist())) == expected
        assert sorted(passages.chains_of(part, a, b, 5, 0.1, reach)) == expected
    # Parts of one length are all walked together.
    monkeypatch.setattr(passages, "chains", None)
    at = np.tile(np.arange(40), 50)
    assert len(passages.chains_of(np.repeat(np.arange(50), 40), at, at, 5, 0.1, 60)) == 50


def test_a_part_much_longer_than_others_is_chained_alone(monkeypatch):
    seen, whole = [], passages.chains
    monkeypatch.setattr(passages, "chains", lambda a, *more: seen.append(len(a)) or whole(a, *more))
    a = np.concatenate([np.arange(0, 5000, 50), np.tile(np.arange(30), 99)])
    part = np.repeat(np.arange(100), [100] + [30] * 99)
    assert sorted(map(len, passages.chains_of(part, a, a, 5, 0.01, 60))) == [30] * 99 + [100]
    assert seen == [100]


def test_equal_stretches_are_those_that_rows_give():
    rnd = np.random.default_rng(6)
    rows = []
    for n in range(300):
        core = rnd.integers(0, 50, 20 + n % 30)
        left, right = (np.concatenate([rnd.integers(0, 3, rnd.integers(0, 31)), core, rnd.integers(0, 3, rnd.integers(0, 31))]) for _ in range(2))
        off = [len(w) - len(core) for w in (left, right)]
        i, j = (int(rnd.integers(max(0, o - 30), min(30, o) + 1)) for o in off)
        if n % 3 == 0:
            right, j = left.copy(), i
        elif n % 3 == 1:
            right, j = left.copy(), i
            right[rnd.integers(len(right))] = 99
        last = max(0, min(len(left) - i, len(right) - j) - 35)
        step = np.unique(np.append(np.arange(0, last, 5), last))
        rows.append((i + step, j + step, left[: i + last + 35], right[: j + last + 35]))
    x, y, left, right = ((np.concatenate(c), np.cumsum([0, *map(len, c)])) for c in zip(*rows))
    lead, length = passages.equal_stretches(x, y, left, right, 5, 30)
    assert 50 < (length >= 0).sum() < 300
    for n, (i, j, u, v) in enumerate(rows):
        before, after = passages._reach_out(u, v, np.stack([i, j], 1), 5)
        u, v = u[i[0] - before : i[-1] + 5 + after], v[j[0] - before : j[-1] + 5 + after]
        assert lead[n] == before
        assert length[n] == (len(u) if np.array_equal(u, v) else -1)


def test_words_of_all_rows_are_counted(spark):
    texts = ["Eins zwei", "Eins zwei", "", None, "a-b c", prose(650, 70), prose(650, 70), "\u00c4rger\u00e4"]
    _, members = passages.SharedPassages().find(docs_of(spark, texts))
    assert {(r.doc_id, r.first, r.n_words) for r in members.collect()} == {
        (0, 0, 2), (1, 0, 2), (2, 2, 0), (3, 2, 0), (4, 4, 3), (5, 5, 70), (6, 5, 70), (7, 7, 1)}


def test_passages_whose_parts_stand_in_many_texts_are_linked(spark):
    """Pairs share 50 words whose first and last 44 stand, in other surroundings, in texts with hashes on all sides."""
    texts = []
    for n in range(8):
        shared = prose(1000 + n, 50).split()
        texts += [" ".join([prose(1100 + 2 * n + m, 40), *shared, prose(1200 + 2 * n + m, 40)]) for m in range(2)]
        for m in range(12):
            part = shared[:44] if m % 2 else shared[6:]
            texts.append(" ".join([prose(2000 + 100 * n + m, 40), *part, prose(3000 + 100 * n + m, 40)]))
    found, _ = passages.SharedPassages().find(docs_of(spark, texts))
    linked = {(r.doc_id, r.other_id) for r in found.collect()}
    assert {frozenset(p) for p in linked} >= {frozenset((14 * n, 14 * n + 1)) for n in range(8)}
    assert uncovered(spark, texts) == []


def test_first_runs_are_told_by_the_words_of_a_passage():
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 9999, 57)
    texts = [np.concatenate([rng.integers(0, 9999, n), shared, rng.integers(0, 9999, 90 - n)]) for n in (0, 31, 60)]
    of, key, at, _, _, gaps, starts = passages.keys(texts, 5, 10, 4, 50)
    begins = {}
    for t, k, p, g, s in zip(of.tolist(), key.tolist(), at.tolist(), gaps.tolist(), starts.tolist()):
        assert g > 0 or s == 0
        for n in range(10):
            if s >> (8 + n) & 1:
                assert (t, p - (s & 255) + n) not in begins
                begins[t, p - (s & 255) + n] = (k, (s & 255) - n)
    # Each passage of 50 words has one first run, equal ones the same at the same distance.
    assert set(begins) == {(t, i) for t in range(3) for i in range(147 - 49)}
    for i in range(8):
        assert len({begins[t, n + i] for t, n in enumerate((0, 31, 60))}) == 1


def test_stretches_are_joined_where_they_meet():
    rnd = random.Random(9)
    for _ in range(100):
        rows = [(rnd.randrange(2), rnd.randrange(300), rnd.choice([0, 0, 7]), 50 + rnd.randrange(10)) for _ in range(rnd.randint(1, 12))]
        pair, i, off, length = np.array(rows).T
        made = list(zip(*(x.tolist() for x in passages.stretches(pair, i, i - off, length, 5, 10))))
        held = {(p, x, o) for p, a, o, n in rows for x in range(a, a + n)}
        assert {(p, a + n, a - b) for p, a, b in made for n in range(5)} <= held
        for p, a, o, n in rows:
            inside = sorted(x for q, x, y in made if q == p and x - y == o and a - 10 < x <= a + n - 5)
            assert inside[0] <= a and all(y - x <= 10 for x, y in zip(inside, inside[1:])) and inside[-1] + 10 > a + n - 5


def test_passages_with_changes_whose_parts_stand_in_other_texts_are_found(spark):
    """Pairs share 80 words with changes, so no run of 50; each of its parts stands alone in texts with hashes on all sides."""
    texts = []
    for n in range(6):
        shared = prose(4000 + n, 80).split()
        changed = [w if i not in (26, 53) else "changed" for i, w in enumerate(shared)]
        texts += [" ".join([prose(4100 + n, 40), *shared, prose(4200 + n, 40)]), " ".join([prose(4300 + n, 40), *changed, prose(4400 + n, 40)])]
        for m in range(12):
            part = (shared[:26], shared[27:53], shared[54:])[m % 3]
            texts.append(" ".join([prose(5000 + 100 * n + m, 40), *part, prose(6000 + 100 * n + m, 40)]))
    found, _ = passages.SharedPassages().find(docs_of(spark, texts))
    assert {frozenset((r.doc_id, r.other_id)) for r in found.collect()} == {frozenset((14 * n, 14 * n + 1)) for n in range(6)}
