"""Base spans against the plain patterns; estimated reliabilities; added spans."""

import random
import re

import numpy as np
from data import docs_of, no_docs, odd_docs, prose

from arcloom.llm import pii


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def test_base_spans_are_the_patterns():
    rnd = random.Random(3)
    parts = ["a", ".", "@", "1", "2", "-", " ", "+", "9", "255", "é", "(", ")", "@a.b", "4111 1111 1111 1111", "1.2.3.4", "+1 (234) 555-6789", "\n"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "9" * 300_000, "1." * 100_000, "@" * 100_000, "+1" * 50_000):
        pii._find(text)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.6])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) * 2
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    p, table, prior = pii.reliabilities(rows, counts.astype(float))
    assert abs(prior - 0.4) < 0.05
    assert np.abs(table[1, :, 2] - right).max() < 0.05
    assert np.abs(table[0, :, 0] - right).max() < 0.05


def test_the_method_adds_and_the_base_stays(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'{prose(n, 8)} token = "{key[n:] + key[:n]}" {prose(n, 3)} x{n}@mail.example.com or 10.1.{n}.7' for n in range(40)]
    texts += [f"{prose(n, 9)} version {n}.0 {prose(n, 5)}" for n in range(40)]
    rows = {r.doc_id: r.spans for r in pii.spans(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        base = [(s.kind, s.start, s.end) for s in rows[i] if s.base]
        assert base == plain(text)
        added = [(s.kind, text[s.start : s.end]) for s in rows[i] if not s.base]
        assert added == ([("secret", key[i:] + key[:i])] if i < 40 else [])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = pii.spans(docs).collect()
    assert len(rows) == docs.count() and not any(r.spans for r in rows)
    assert pii.spans(no_docs(spark)).count() == 0


def test_nothing_is_added_within_a_long_base_span():
    """An email over many addresses reaches over more base spans than are near the candidate."""
    text = "x " + ".".join(["1.2.3.4"] * 15) + ".a@example.com (at) y.com"
    found = pii._find(text)
    base = [(s["start"], s["end"]) for s in found if s["base"]]
    added = [(s["start"], s["end"]) for s in found if not s["base"]]
    assert len(base) > 10 and all(a >= e or b <= s for a, b in added for s, e in base)
