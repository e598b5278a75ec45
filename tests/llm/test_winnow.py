"""Fingerprints against a plain version in Python."""

import hashlib

from data import docs_of, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from arcloom.llm import winnow


def chosen(values, window):
    """Positions of window minima, rightmost among equals."""
    last = max(len(values) - window, 0) + 1
    at = []
    for i in range(last if values else 0):
        part = values[i : i + window]
        low = min(part)
        at.append(i + max(j for j, v in enumerate(part) if v == low))
    return list(dict.fromkeys(at))


def units(text):
    """Words, and the single code points of long ones but for their last."""
    found = []
    for word in text.split():
        cut = max(len(word) - winnow.LONG, 0)
        found += [*word[:cut], word[cut:]]
    return found


def value(hashes):
    total = 0
    for h in (hashes + [0] * winnow.GRAM)[: winnow.GRAM]:
        total = (total * winnow.BASE + h) % winnow.PRIME
    return total


def plain(text, hash_of):
    """``(values, positions)`` of a text by the definition."""
    lists = [units(text)] + ([[c for c in text if not c.isspace()]] if len(text) <= winnow.SHORT else [])
    found, start = [], 0
    for named in lists:
        h = [hash_of[u] for u in named]
        grams = [value(h[i : i + winnow.GRAM]) for i in range(max(len(h) - winnow.GRAM, 0) + 1 if h else 0)]
        found += [(grams[i], start + i) for i in chosen(grams, winnow.WINDOW)]
        start += len(h)
    return found


TEXTS = [prose(n, n) for n in (1, 3, 5, 8, 9, 40, 150)] + [
    "a a a a a a a a a a a a", "", "   ", "\n x \t", "a" * 23 + " " + "b" * 24 + " " + "c" * 25, "xyz" * 300,
    "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 90, "\U0001f600\U0001f601" * 20, "word " * 81, "word " * 80,
]


def test_values_and_positions_are_those_of_the_definition(spark):
    known = sorted({u for t in TEXTS for u in [*units(t), *t]})
    hashed = spark.createDataFrame([(u,) for u in known], "u string")
    hash_of = dict(hashed.select("u", F.pmod(F.xxhash64("u"), F.lit(winnow.PRIME))).collect())
    prints = winnow.fingerprint(F.col("text"))
    rows = docs_of(spark, TEXTS).select("text", winnow.values(prints).alias("v"), winnow.positions(prints).alias("at")).collect()
    for row in rows:
        assert list(zip(row.v, row["at"])) == plain(row.text, hash_of), row.text
    assert spark.range(1).select(winnow.fingerprint(F.lit(None).cast("string"))).first()[0] == []


def test_any_gram_and_window(spark):
    text = prose(4, 120)
    h = docs_of(spark, [text]).select(F.transform(F.split("text", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(winnow.PRIME)))).first()[0]
    for gram, window in ((1, 1), (2, 3), (3, 5), (7, 6), (8, 8), (11, 1)):
        grams = []
        for i in range(len(h) - gram + 1):
            total = 0
            for x in h[i : i + gram]:
                total = (total * winnow.BASE + x) % winnow.PRIME
            grams.append(total)
        found = docs_of(spark, [text]).select(winnow.positions(winnow.fingerprint(F.col("text"), gram, window))).first()[0]
        assert len(text) > winnow.SHORT and found == chosen(grams, window)


def test_half_of_any_text_is_seen(spark):
    """A text of 20 non-blank code points and more is like what keeps its first half."""
    texts = [prose(1, 60)[:n] for n in (20, 25, 60, 200, 399, 400, 401)] + ["q7" * n for n in (10, 100, 1000)]
    texts += ["".join(chr(0x4E00 + i * 7 % 977) for i in range(n)) for n in (20, 300, 900)]
    texts = [t.strip() for t in texts] + [("x" * 24 + " ") * 20]
    for other in ("", "z", "other words " * 400):
        pairs = [(t, t[: len(t) - len(t) // 2] + other[: len(t) // 2]) for t in texts]
        a, b = (winnow.values(winnow.fingerprint(F.col(c))) for c in "ab")
        for row in spark.createDataFrame(pairs, "a string, b string").select("a", winnow.likeness(a, b).alias("near")).collect():
            assert row.near > 0, (row.a, other)


def test_shared_run_shares_a_value(spark):
    run = prose(9, winnow.GRAM + winnow.WINDOW - 1)
    docs = docs_of(spark, [prose(n, 30) + " " + run + " " + prose(n + 50, 30) for n in range(2)])
    a, b = docs.select(winnow.values(winnow.fingerprint(F.col("text"))).alias("v")).collect()
    assert set(a.v) & set(b.v)


def test_edited_text_takes_from_the_next_document(spark):
    docs = odd_docs(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("v")).distinct().collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.v))
    # Null ids are ordered by a hash that also says that the id is null.
    known = [r for r in order if r.doc_id is not None]
    multi = {r.doc_id for r in known if sum(x.doc_id == r.doc_id for x in known) > 1}
    found = winnow.edited(docs).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    for here, after in zip(known, known[1:]):
        if here.doc_id in multi or after.doc_id in multi:
            continue
        half = len(here.text) // 2
        assert by_id[here.doc_id].edited == here.text[: len(here.text) - half] + after.text[:half]


def test_digest_of_edited_text(spark, tmp_path):
    from arcloom.llm.queries import op1_fingerprints

    texts = [prose(n, 30 + n) for n in range(9)]
    docs_of(spark, [*texts, texts[3]]).write.parquet(f"{tmp_path}/documents.parquet")
    texts.append(texts[3])
    rows = {r.doc_id: r for r in op1_fingerprints(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        want = t[: len(t) - half] + after[:half]
        assert rows[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0.1 < rows[i].near_edited < 0.7 and rows[i].near_next < 0.1
    assert rows[3].fingerprint == rows[9].fingerprint


def test_no_documents(spark):
    assert winnow.edited(no_docs(spark)).count() == 0
