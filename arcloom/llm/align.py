"""Tokens of two tokenizers aligned over the bytes that both spell.

Tokenizer A (byte-level BPE) cuts space+text, tokenizer B (SentencePiece) the text, to
which it adds the space. Every token points to the token of the other side that
overlaps it and ends last, itself where none ends later; doubling all pointers at
once, until none moves, leads each token to the last token of its group, and tokens
with the same last token are one group. Two tokens are linked where their bytes overlap.

Neither tokenizer joins what comes before a single space, behind a sign and in front
of another, with what comes after. So texts are cut there, each distinct unit is encoded
and aligned once and remembered (within bounds), and a text is put together from its units.
How often each pair of ids is linked is counted over all documents by one shuffle of
pre-aggregated pairs. Counts of at most ``broadcast_pairs`` pairs (counted) are broadcast to
the documents; beyond that each part of the documents asks for its distinct pairs.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm.components import stored

BROADCAST_PAIRS = 1_000_000  # of 17 bytes
UNITS = 200_000  # units remembered by a task
LONG = 200  # characters beyond which a unit is not remembered
BATCH_CHARS = 2_000_000
TOGETHER = 50  # units encoded as one text
LOW = 32  # bits of an id
BLANKS = re.compile(r"\A |\s | \Z")  # spaces that end no unit


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if b not in set(visible)]
    return letters | {chr(256 + n): b for n, b in enumerate(hidden)}


def cut_units(text: str) -> list[str]:
    """Units that, each behind a space, make up space+text."""
    units = text.split(" ")
    if not BLANKS.search(text):
        return units
    parts, units = units, []
    for part in parts:
        if units and (not part or not units[-1] or units[-1][-1].isspace()):
            units[-1] += " " + part
        else:
            units.append(part)
    return units


def last_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the number of the A token that ends its group; both cut the same bytes."""
    n = len(ends_a)
    over_b, over_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    to = np.concatenate([np.where(ends_b[over_b] == ends_a, np.arange(n), n + over_b), over_a])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n], to[n:]
        to = further


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of A and B whose bytes overlap: one pair for each place where either ends."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligner:
    """Both tokenizers of one task, and what it remembers of units."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        letters = byte_letters()
        entries = self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.digits = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        # Where a piece holds a blank behind another sign, units would have to be whole texts.
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.len_a, self.len_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes = np.zeros((0, 3), np.int64)  # tokens of A, of B, groups; -1 where the bytes differ
        self.groups: list[str] = []
        self.pairs: list[np.ndarray] = []

    def learn(self, units: list[str]) -> None:
        """Align units not met before, all at once."""
        # Units that may stand in one text without touching each other's tokens are encoded so.
        plain = [u for u in units if u and u[0] != " " and not u[-1].isspace()]
        odd = [u for u in units if not u or u[0] == " " or u[-1].isspace()]
        units = plain + odd
        a, n_a = self._encode_a(plain)
        if odd:
            a, n_a = (np.concatenate(x) for x in zip((a, n_a), self._encode_each(odd)))
        ids_b = self.b.encode(units, num_threads=1)
        b = np.fromiter(chain.from_iterable(ids_b), np.int64)
        n_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        self.number.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        same = self._same_bytes(units, a, b, n_a, n_b)
        a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        last_a, last_b = last_tokens(ends_a, ends_b)
        link_a, link_b = linked(ends_a, ends_b)
        pairs = a[link_a] << LOW | b[link_b]
        terminal = np.flatnonzero(last_a == np.arange(len(a)))
        text_a, text_b = [self.digits[i] for i in a.tolist()], [self.digits[i] for i in b.tolist()]
        stop_a, stop_b = (np.searchsorted(x, terminal, "right").tolist() for x in (last_a, last_b))
        groups, i, k = [], 0, 0
        for j, m in zip(stop_a, stop_b):
            groups.append(f"{text_a[i] if j == i + 1 else ','.join(text_a[i:j])}|{text_b[k] if m == k + 1 else ','.join(text_b[k:m])}")
            i, k = j, m
        of_unit = np.cumsum(np.where(same, n_a, 0))
        group_ends, link_ends = np.searchsorted(terminal, of_unit), np.searchsorted(link_a, of_unit)
        sizes = np.stack([n_a, n_b, np.diff(group_ends, prepend=0)], 1)
        sizes[~same] = -1
        self.sizes = np.concatenate([self.sizes, sizes])
        at = link_at = 0
        for end, link_end in zip(group_ends.tolist(), link_ends.tolist()):
            self.groups.append(groups[at] if end == at + 1 else ";".join(groups[at:end]))
            self.pairs.append(pairs[link_at:link_end])
            at, link_at = end, link_end

    def _encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A, and how many each unit has: a token's bytes tell where units end."""
        texts = [" " + " ".join(units[at : at + TOGETHER]) for at in range(0, len(units), TOGETHER)]
        made = self.a.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in made), np.int64)
        ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units)))
        spelt = np.cumsum(self.len_a[ids])
        last = np.searchsorted(spelt, ends)
        if len(units) and (spelt[-1] != ends[-1] or (spelt[last] != ends).any()):
            return self._encode_each(units)
        return ids, np.diff(last, prepend=-1)

    def _encode_each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(made), np.int64), np.fromiter(map(len, made), np.int64, len(made))

    def _same_bytes(self, units: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """For each unit whether both tokenizers spell space+unit."""
        raw = [(" " + u).encode() for u in units]
        spelt_a = b"".join([self.bytes_a[i] for i in a.tolist()])
        spelt_b = b"".join([self.bytes_b[i] for i in b.tolist()])
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = [np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n)])] for lengths, n in ((self.len_a[a], n_a), (self.len_b[b], n_b))]
        same = (np.diff(ends[0]) == size) & (np.diff(ends[1]) == size)
        if same.all() and spelt_a == spelt_b == b"".join(raw):
            return same
        x, y = (e.tolist() for e in ends)
        for k in np.flatnonzero(same).tolist():
            same[k] = spelt_a[x[k] : x[k + 1]] == raw[k] == spelt_b[y[k] : y[k + 1]]
        return same

    def align(self, texts: list[str]) -> list[tuple]:
        """For each text tokens of A and B, groups, links, the groups' text, and its pairs with their times."""
        cut = [([t] if self.whole else cut_units(t)) if t else [] for t in texts]
        if len(self.groups) > UNITS:
            self.forget()
        number = self.number
        fresh = [u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in number]
        if fresh:
            self.learn(fresh)
        none, out = np.zeros(0, np.int64), []
        for units in cut:
            row = [number[u] for u in units]
            sizes = self.sizes[row] if row else np.full((1, 3), -1)
            if sizes[:, 0].min() < 0:
                out.append((0, 0, 0, 0, "", none, none))
                continue
            n_a, n_b, n_groups = sizes.sum(0).tolist()
            pairs, times = np.unique(np.concatenate([self.pairs[n] for n in row]), return_counts=True)
            # A pair for each place where either ends.
            out.append((n_a, n_b, n_groups, n_a + n_b - n_groups, ";".join([self.groups[n] for n in row]), pairs, times))
        for unit in [u for u in fresh if len(u) > LONG]:
            # Its place stays until all is forgotten, what it holds does not.
            n = number.pop(unit)
            self.groups[n], self.pairs[n] = "", none
        return out


ALIGNED = "part bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<int>"


@dataclass(frozen=True)
class Alignment:
    """``file_a`` is a byte-level BPE of the tokenizers library, ``file_b`` a SentencePiece model; every worker reads them."""

    file_a: str
    file_b: str
    broadcast_pairs: int = BROADCAST_PAIRS

    def align(self, docs: DataFrame, groups: bool = False) -> DataFrame:
        """``(part, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, times)`` for each row of ``docs (doc_id, text)``.

        ``groups`` reads ``a1,a2|b1;a3|b2,b3`` (left out unless asked for), ``groups_sha256`` is its
        digest; ``pairs`` are ``a << 32 | b`` of linked ids, ascending, and ``times`` how often each is
        linked. Texts that are null or empty, or whose tokens spell other bytes than
        space+text, have no tokens: zeros, empty strings, no pairs. Repeated rows and ids
        are rows of their own. ``part`` numbers batches of rows.
        """
        files = self.file_a, self.file_b

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner, part = None, TaskContext.get().partitionId() << LOW
            # Lists of many texts' units only: nothing for the collector to find.
            gc.disable()
            for batch in batches:
                aligner = aligner or Aligner(*files)
                ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
                start, held = 0, 0
                for end, text in enumerate(texts, 1):
                    held += len(text or "")
                    if held < BATCH_CHARS and end < len(texts):
                        continue
                    rows = aligner.align([t or "" for t in texts[start:end]])
                    n_a, n_b, n_groups, n_links, text_of, pairs, times = zip(*rows)
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
                    digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in text_of]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), part)),
                            ids.slice(start, end - start),
                            *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)],
                            pa.array(digest, pa.string()),
                            pa.array(text_of if groups else [None] * len(rows), pa.string()),
                            pa.ListArray.from_arrays(ends, np.concatenate(pairs)),
                            pa.ListArray.from_arrays(ends, np.concatenate(times).astype(np.int32)),
                        ],
                        ALIGNED_NAMES,
                    )
                    part, start, held = part + 1, end, 0
            gc.enable()

        return docs.select("doc_id", "text").mapInArrow(made, ALIGNED)

    def pair_counts(self, aligned: DataFrame) -> DataFrame:
        """``(pair, n, best)``: the links of each pair in all documents, and whether no other pair of its B id has more."""
        counts = (
            aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.times").cast("bigint")).alias("n"))
        )
        # At most as many rows of one B id as A has ids.
        most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << LOW) - 1)))
        return stored(counts.withColumn("best", F.col("n") == most), "pair-counts")

    def scores(self, aligned: DataFrame, counts: DataFrame) -> DataFrame:
        """``aligned`` (stored) with ``n_best``, the links of best pairs, and ``count_sum``, over all links."""
        if counts.count() <= self.broadcast_pairs:
            return self._scored_by_broadcast(aligned, counts)
        return self._scored_by_part(aligned, counts)

    def _scored_by_broadcast(self, aligned: DataFrame, counts: DataFrame) -> DataFrame:
        held = counts.toPandas().sort_values("pair")
        shared = aligned.sparkSession.sparkContext.broadcast([held[c].to_numpy() for c in ("pair", "n", "best")])

        @F.pandas_udf("n_best bigint, count_sum bigint")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for pairs, times in batches:
                yield pd.DataFrame([_sums(p, t, *shared.value) for p, t in zip(pairs, times)], columns=["n_best", "count_sum"])

        scored = aligned.withColumn("score", score("pairs", "times"))
        return scored.select(*aligned.columns, "score.n_best", "score.count_sum")

    def _scored_by_part(self, aligned: DataFrame, counts: DataFrame) -> DataFrame:
        asked = aligned.select(F.col("part").alias("of"), F.explode("pairs").alias("pair")).distinct()
        known = asked.join(counts, "pair").select("of", "pair", "n", "best")
        columns, schema = aligned.columns, aligned.schema

        def score(docs: pa.Table, known: pa.Table) -> pa.Table:
            known = known.sort_by("pair")
            table = [known[c].to_numpy() for c in ("pair", "n", "best")]
            sums = [
                _sums(p, t, *table)
                for p, t in zip(docs["pairs"].to_numpy(), docs["times"].to_numpy())
            ]
            docs = docs.select(columns).append_column("n_best", pa.array([s[0] for s in sums], pa.int64()))
            return docs.append_column("count_sum", pa.array([s[1] for s in sums], pa.int64()))

        made = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        return aligned.groupBy("part").cogroup(known.groupBy("of")).applyInArrow(score, f"{made}, n_best bigint, count_sum bigint")


ALIGNED_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def _sums(pairs: np.ndarray, times: np.ndarray, known: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[int, int]:
    at = np.searchsorted(known, pairs)
    return int(times[best[at]].sum()), int((times * n[at]).sum())
