"""Neighbour votes: held-out accuracy, and odd rows."""

import numpy as np
from data import docs_of, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from arcloom.llm import quality

LABEL = "doc_id bigint, quality int"


def test_held_out_documents_are_told_apart(spark):
    texts = [prose(n, 60) if n % 3 else prose(n, 60).upper().replace(" ", "!! ") for n in range(150)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(n, int(n % 3 > 0)) for n in range(150)] + [(None, 1), (3, None)], LABEL)
    held = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs, labels, usable=~held)
    rows = quality.scores(docs, model).where(held).collect()
    assert len(rows) > 15
    assert all((r.quality_score >= quality.THRESHOLD) == (r.doc_id % 3 > 0) for r in rows)


def test_the_nearest_neighbours_vote_exactly():
    texts = [prose(n, 30) for n in range(40)]
    counts = np.stack([quality.count_terms(t) for t in texts])
    rarity = np.ones(quality.TERMS, np.float32)
    axes = np.eye(quality.TERMS, dtype=np.float32)[:, ::8]
    vectors = quality._unit(quality._weigh(counts, rarity) @ axes)
    labels = np.arange(40) % 2.0
    model = quality.NeighbourModel(rarity, axes, vectors, labels, 0.5, 5)
    for text, got in zip(texts[:6], model.score(texts[:6], block=4)):
        cosine = model.project(quality.count_terms(text)[None]) @ vectors.T
        near = np.argsort(-cosine[0])[:5]
        vote = np.maximum(cosine[0][near].astype(float), 0) ** 4
        assert abs(got - (vote * labels[near]).sum() / vote.sum()) < 1e-6


def test_odd_rows_no_labels_and_sample_bound(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (7, 0), (99, 1), (11, 1)], LABEL)
    model = quality.fit(docs, labels, sample=3)
    assert len(model.labels) <= 3
    rows = quality.scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    same = {r.quality_score for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1
    none = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.scores(docs, none).collect()} == {0.5}
    assert quality.scores(no_docs(spark), model).count() == 0


def test_the_driver_fits_nothing(spark, monkeypatch):
    """The sample's counts stay in a task: the driver, which is short of memory, gets the model only."""
    texts = [prose(n, 60) if n % 2 else prose(n, 60).upper() for n in range(40)]

    def refused(*_):
        raise AssertionError("weighed in the driver")

    monkeypatch.setattr(quality, "_weigh", refused)
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], LABEL)
    model = quality.fit(docs_of(spark, texts), labels)
    assert model.vectors.shape[0] == len(model.labels) == 40 and set(model.labels) == {0, 1}
