"""Quality by the votes of the most similar labelled documents in a latent space.

A text becomes counts of terms: hashed byte trigrams, and shapes of words (classes
of the first, second and last byte, and whether the word repeats the one before).
Weighted counts of a bounded sample of labelled rows give a latent space (truncated
singular value decomposition). The labelled vectors are broadcast; every document is
projected and compared with all of them in blocks, exactly, and the ``neighbours``
nearest vote with their similarity.

The sample bounds what a task holds: ``sample`` rows of ``TERMS`` 4-byte figures in the
one that fits, ``sample * rank`` figures when scoring. The driver gets the latter only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIGRAMS = 1536
CLASSES = 6
SHAPES = CLASSES**3 * 2
TERMS = TRIGRAMS + SHAPES


def _byte_classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 beyond ASCII, 4 sentence mark, 5 other."""
    of = np.full(256, 5, np.int64)
    of[ord("a") : ord("z") + 1] = 0
    of[ord("A") : ord("Z") + 1] = 1
    of[ord("0") : ord("9") + 1] = 2
    of[128:] = 3
    of[[ord(c) for c in ".,;:'\"?-()"]] = 4
    return of


BYTE_CLASS = _byte_classes()
PLACE_WEIGHT = np.random.default_rng(7).integers(1, 2**62, 64, dtype=np.uint64) | np.uint64(1)


def count_terms(text: str) -> np.ndarray:
    """Counts of ``TERMS`` terms over the whole text."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(TERMS, np.float32)
    if len(b) >= 3:
        w = b.astype(np.uint32)
        h = w[:-2] * np.uint32(2654435761) + w[1:-1] * np.uint32(40503) + w[2:] * np.uint32(2246822519)
        h ^= h >> np.uint32(15)
        out[:TRIGRAMS] = np.bincount(h % np.uint32(TRIGRAMS), minlength=TRIGRAMS)
    inside = b > 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):
        begun = np.zeros(len(b), np.int64)
        begun[starts] = starts
        place = np.arange(len(b)) - np.maximum.accumulate(begun)
        mixed = np.where(inside, (b.astype(np.uint64) + np.uint64(1)) * PLACE_WEIGHT[place & 63], np.uint64(0))
        word = np.add.reduceat(mixed, starts)
        same = np.concatenate(([False], word[1:] == word[:-1]))
        first, last = BYTE_CLASS[b[starts]], BYTE_CLASS[b[ends - 1]]
        second = BYTE_CLASS[b[np.minimum(starts + 1, ends - 1)]]
        shape = ((first * CLASSES + second) * CLASSES + last) * 2 + same
        out[TRIGRAMS:] = np.bincount(shape, minlength=SHAPES)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


@dataclass
class NeighbourModel:
    """Labelled documents as unit vectors of the latent space."""

    rarity: np.ndarray  # weight of each term
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank
    labels: np.ndarray
    prior: float
    neighbours: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weigh(counts, self.rarity) @ self.axes)

    def score(self, texts: list[str], block: int = 128) -> np.ndarray:
        """For each text the similarity-weighted mean label; the prior where nothing is similar."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(texts), block):
            counts = np.stack([count_terms(t) for t in texts[at : at + block]])
            cosine = self.project(counts) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            # The fourth power lets the closest neighbours outvote the merely similar.
            votes = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4
            total = votes.sum(1)
            mean = (votes * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[at : at + block] = np.where(total > 0, np.clip(mean, 0, 1), self.prior)
        return out


def _weigh(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Trigrams by damped count, shapes by share; both parts weigh the same."""
    grams = _unit(np.log1p(counts[:, :TRIGRAMS]) * rarity[:TRIGRAMS])
    shapes = counts[:, TRIGRAMS:]
    shares = np.sqrt(shapes / np.maximum(shapes.sum(1, keepdims=True), 1))
    return np.concatenate([grams, _unit(shares * rarity[TRIGRAMS:])], axis=1)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    usable: Column | None = None,
    sample: int = 4000,
    rank: int = 48,
    neighbours: int = 15,
) -> NeighbourModel:
    """Learn from at most ``sample`` labelled documents that meet ``usable``.

    ``docs (doc_id, text)``, ``labels (doc_id, label)``. The sample is the rows with
    the lowest hash of ``doc_id``, so it does not depend on the order of rows.
    Null labels and ids are passed over; an id labelled more than once counts with
    its lowest label. With no labelled row every score is 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.where(usable)
    # Labels of absent documents are of no use and must not use up the sample.
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.groupBy("doc_id").agg(F.min(label_col).cast("double").alias("label")).orderBy(*order).limit(sample)
    # One id may have any number of rows: what reaches the driver is bounded by rows.
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .mapInPandas(_counted, "doc_id bigint, label double, counts binary")
        .dropDuplicates(["doc_id", "counts"])
        .orderBy(*order, "counts")
        .limit(sample)
        .select("label", "counts")
        .coalesce(1)
    )

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(f["label"].to_numpy(), b"".join(f["counts"])) for f in frames if len(f)]
        if held:
            label = np.concatenate([x[0] for x in held])
            model = _fitted(label, np.frombuffer(b"".join([x[1] for x in held]), np.float32).reshape(-1, TERMS), rank, neighbours)
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    made = rows.mapInPandas(fitted, "model binary").first()
    if made is None:
        return NeighbourModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32),
                              np.zeros((0, 1), np.float32), np.zeros(0), 0.5, neighbours)
    return pickle.loads(made.model)


def _fitted(label: np.ndarray, counts: np.ndarray, rank: int, neighbours: int) -> NeighbourModel:
    rarity = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    weighed = _weigh(counts, rarity)
    del counts
    _, axes = np.linalg.eigh(weighed.T @ weighed)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :rank])
    return NeighbourModel(rarity, axes, _unit(weighed @ axes), label, float(label.mean()), neighbours)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts = [count_terms(t).tobytes() for t in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "counts": counts})


def scores(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """``docs`` with a column ``quality_score`` (double, 0 to 1), from ``text`` alone.

    All columns of ``docs`` are kept, an equally named one is replaced. A null text
    counts as empty; an empty text, alike to nothing, gets the prior.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series(shared.value.score(text.tolist()))

    return docs.withColumn("quality_score", score(F.coalesce("text", F.lit(""))))


# What counts as held out, and from which score on a document is good. (Fixed by contract.)
FOLDS = 5
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from the fit; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
