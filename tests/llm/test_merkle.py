import hashlib

import pytest
from data import docs_of, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from arcloom.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """The root, and each leaf's siblings with their sides."""
    paths, levels = [[] for _ in leaves], [list(leaves)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H(*row[i : i + 2]) for i in range(0, len(row), 2)])
    for n in range(len(leaves)):
        i = n
        for row in levels[:-1]:
            side = "l" if i & 1 else "r"
            paths[n].append((row[i ^ 1], side) if i ^ 1 < len(row) else ("", "-"))
            i >>= 1
    return levels[-1][0], paths


def plain(rows):
    """``(doc_id, lang, leaf, subroot, root, proof, sides)`` of ``(doc_id, source, lang, n_chars, text)``."""
    nulls = lambda v: (v is not None, v if v is not None else 0)
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0], H(*map(field, row))))
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    subs = {}
    for lang in order:
        langs[lang].sort(key=lambda x: (nulls(x[0]), x[1]))
        subs[lang] = tree([h for _, h in langs[lang]])
    root, uppers = tree([subs[lang][0] for lang in order])
    out = []
    for lang, upper in zip(order, uppers):
        for (doc_id, leaf), path in zip(langs[lang], subs[lang][1]):
            whole = path + upper
            out.append((doc_id, lang, leaf, subs[lang][0], root, "".join(h for h, _ in whole), "".join(s for _, s in whole)))
    return sorted(out, key=str)


def found(docs, part_rows):
    got = merkle.manifest(docs, part_rows).collect()
    return sorted(
        [(r.doc_id, r.lang, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex(), r.sides) for r in got], key=str
    )


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("part_rows", [3, 1000])
def test_odd_rows(spark, part_rows):
    docs = odd_docs(spark)
    rows = [tuple(r[c] for c in COLUMNS) for r in docs.collect()]
    assert found(docs, part_rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1100])
def test_trees_over_many_partitions(spark, n, monkeypatch):
    """More than one round of levels, langs of one to many leaves, hash order against bytes of UTF-8."""
    monkeypatch.setattr(merkle, "ROUND", 3)
    langs = ["en"] * 9 + ["é", "z", None]
    rows = [(i, "s", langs[i % len(langs)] if i else "en", i, f"text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert found(docs, 20) == plain(rows)


def test_repeated_rows_have_proofs_of_their_own(spark):
    rows = [(7, "s", "en", 3, "abc")] * 50 + [(2**60 + 1, "s", "en", 3, "abc"), (2**60, "s", "en", 3, "abc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert found(docs, 4) == plain(rows)


def test_claims_that_differ_are_not_verified(spark):
    docs = docs_of(spark, [prose(i, 5) for i in range(40)])
    docs = docs.withColumn("claim", F.when(F.col("doc_id") == 11, 1).otherwise(F.col("n_chars")))
    made = merkle.manifest(docs, 6).withColumn("folded", merkle.fold(F.col("claimed"), F.col("proof"), F.col("sides")))
    assert [r.doc_id for r in made.where("folded <> root").collect()] == [11]


def test_no_rows(spark):
    assert merkle.manifest(no_docs(spark)).collect() == []


def test_a_partition_fetches_the_fewest_nodes():
    for n in range(1, 40):
        sizes = merkle.level_sizes(n)
        for start in range(n):
            for end in range(start + 1, n + 1):
                path = [{i >> level for i in range(start, end)} for level in range(len(sizes))]
                need = {
                    (level, i ^ 1) for level, row in enumerate(path[:-1]) for i in row
                    if i ^ 1 < sizes[level] and i ^ 1 not in row
                }
                assert set(merkle.missing(start, end, n)) == need
                inside = [
                    (level, i) for level in range(len(sizes)) for i in range(sizes[level])
                    if start <= i << level and min((i + 1) << level, n) <= end
                ]
                most = {(level, i) for level, i in inside if (level + 1, i >> 1) not in inside}
                assert set(merkle.maximal(start, end, n)) == most
