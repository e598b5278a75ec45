"""SentencePiece encoding and decoding by a Viterbi search over many words at once.

A text becomes words: a space is written as U+2581, one more stands in front, and a
word is a run of U+2581 with what follows it, cut at line breaks and between Latin letters
and a sign, where no piece crosses (checked when a vocabulary is read). Distinct words are sorted by length, and
words of one length advance together: for each end place, the hash of every possible
last piece is looked up among the sorted hashes of the pieces, the best total wins,
and back pointers are kept, all as numpy columns. A character that no piece covers is
written as its bytes.

Scores are those of the vocabulary file. In vocabularies of merges (BPE) these are
ranks, and the pieces of the highest total need not be those that merging yields;
every encoding decodes to the text all the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

SPACE = "▁"
LETTERS, SIGN = r"[A-Za-z\u00C0-\u024F]", r"[.,!*&#$%|;:?\"'()-]"
WORDS = re.compile(f"{SPACE}*{LETTERS}+(?={SIGN})|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
CROSSING = re.compile(f"\n|{LETTERS}{SIGN}")
# Cost of a byte beyond any piece's, so that bytes are the last resort. (Chosen, not learned.)
BYTE_PENALTY = 10.0
_BASE = np.uint64(0xD1342543DE82EF95)  # any odd number of 64 mixed bits
# Stands for a U+2581 of the text itself; no text holds a lone surrogate, no piece does.
MARK = "\udc81"
CACHE_WORDS = 200_000
BATCH = 400  # texts that are cut into words together


@dataclass
class Vocabulary:
    """Pieces with scores, and their hashes in order."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    usable: np.ndarray
    longest: int = 0
    sorted: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: hashes, ids
    byte_score: float = 0.0

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a model file; ``path`` must exist on every machine."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)])
        is_byte = [model.is_byte(i) for i in range(n)]
        usable = np.array(
            [not (is_byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        )
        byte_ids = np.full(256, -1, np.int32)
        for i in np.flatnonzero(is_byte):
            byte_ids[int(pieces[i][1:-1], 16)] = i
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary lacks byte pieces")
        return Vocabulary(pieces, scores, byte_ids, usable).ready()

    def ready(self) -> Vocabulary:
        ids = np.flatnonzero(self.usable)
        texts = [self.pieces[i] for i in ids]
        if any(CROSSING.search(t) for t in texts):
            raise ValueError("a piece crosses a place where words are cut")
        hashes = np.array([_hash_of(t) for t in texts], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        lengths = np.array([len(t) for t in texts], np.int64)
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            mine = mine[np.argsort(hashes[mine])]
            self.sorted[length] = hashes[mine], ids[mine].astype(np.int32)
        self.longest = max(map(len, texts), default=1)
        self.byte_score = float(self.scores[ids].min(initial=0.0)) - BYTE_PENALTY
        return self

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        for length in np.unique(lengths):
            mine = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
            block = max(1, 100_000 // max(int(length), 1))
            for at in range(0, len(mine), block):
                part = mine[at : at + block]
                joined = "".join(words[i] for i in part)
                chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                for i, ids in zip(part, self._viterbi(chars.reshape(len(part), length))):
                    out[i] = ids
        return out

    def _viterbi(self, chars: np.ndarray) -> list[np.ndarray]:
        count, length = chars.shape
        longest = min(self.longest, length)
        best = np.full((count, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((count, length + 1), np.int16)
        piece = np.full((count, length + 1), -1, np.int32)
        # Bytes of a character in UTF-8: the price of writing it byte by byte.
        size = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        wide = (chars + np.uint32(1)).astype(np.uint64)
        # tail[:, e]: hash of the piece that ends before e and is as long as the loop has come
        power = np.uint64(1)
        tails = []
        tail = np.zeros((count, length + 1), np.uint64)
        for span in range(1, longest + 1):
            grown = np.zeros_like(tail)
            grown[:, span:] = tail[:, span:] + wide[:, : length - span + 1] * power
            tail = grown
            power = np.uint64(int(power) * int(_BASE) % 2**64)
            if span not in self.sorted:
                continue
            keys, ids = self.sorted[span]
            at = np.searchsorted(keys, tail[:, span:])
            at[at == len(keys)] = 0
            found = keys[at] == tail[:, span:]
            held = np.where(found, ids[at], -1)
            tails.append((span, held, np.where(found, self.scores[held], -np.inf)))
        for end in range(1, length + 1):
            score = best[:, end - 1] + size[:, end - 1] * self.byte_score
            step = np.ones(count, np.int16)
            which = np.full(count, -1, np.int32)
            for span, ids, gain in tails:
                if span > end:
                    break
                total = best[:, end - span] + gain[:, end - span]
                win = total > score
                score = np.where(win, total, score)
                step[win] = span
                which = np.where(win, ids[:, end - span], which)
            best[:, end], back[:, end], piece[:, end] = score, step, which
        return self._trace(chars, back, piece)

    def _trace(self, chars: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        """Follow the back pointers of all words, last piece first."""
        count, length = chars.shape
        rows, end = np.arange(count), np.full(count, length)
        found = np.zeros((count, length), np.int32)
        taken, bytewise = np.zeros(count, np.int64), np.zeros(count, bool)
        turn = 0
        while (live := end > 0).any():
            last = piece[rows, end]
            bytewise |= live & (last < 0)
            found[:, turn] = last
            taken += live
            end = end - np.where(live, back[rows, end], 0)
            turn += 1
        return [
            self._with_bytes(chars[i], back[i], piece[i]) if bytewise[i] else found[i, n - 1 :: -1][:n]
            for i, n in enumerate(taken.tolist())
        ]

    def _with_bytes(self, chars: np.ndarray, back: np.ndarray, piece: np.ndarray) -> np.ndarray:
        out: list[int] = []
        end = len(chars)
        while end:
            if piece[end] >= 0:
                out.append(int(piece[end]))
            else:
                char = chr(int(chars[end - 1]))
                raw = (SPACE if char == MARK else char).encode("utf-8")
                out.extend(int(self.byte_ids[b]) for b in reversed(raw))
            end -= int(back[end])
        return np.array(out[::-1], np.int32)

    @cached_property
    def raw(self) -> list[bytes]:
        """What each id stands for, U+2581 being a space."""
        made = [p.replace(SPACE, " ").encode("utf-8") for p in self.pieces]
        for value, i in enumerate(self.byte_ids.tolist()):
            made[i] = bytes([value])
        return made

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``. The space in front of every text is taken off; what is
        no UTF-8 (ids that no encoding yields) is replaced by U+FFFD."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")[1:]


def _hash_of(piece: str) -> int:
    value = 0
    for c in piece:
        value = (value * int(_BASE) + ord(c) + 1) % 2**64
    return value


class Encoder:
    """Encodes texts, remembering at most ``CACHE_WORDS`` words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t) for t in texts]
        fresh = list({w for ws in cut for w in ws}.difference(self.known))
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known = {}
            fresh = list({w for ws in cut for w in ws})
        self.known.update(zip(fresh, [ids.tobytes() for ids in self.vocabulary.encode_words(fresh)]))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in ws]), np.int32) for ws in cut]

    @staticmethod
    def words(text: str) -> list[str]:
        return WORDS.findall(SPACE + text.replace(SPACE, MARK).replace(" ", SPACE)) if text else []


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Vocabulary.load(path))
    return _LOADED[path]


def _mapped(docs: DataFrame, source, added: dict[str, DataType], work) -> DataFrame:
    """``docs`` with columns ``added`` that ``work`` makes of the column ``source``, in small batches.

    Equally named columns are replaced. Rows stay in Arrow form, so their types do.
    """
    kept = [c for c in docs.columns if c not in added]
    names = [*kept, *added]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(n, t) for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(part.columns[-1])], names)

    return docs.select(*[F.col(f"`{c}`") for c in kept], source.alias("source of " + " ".join(added))).mapInArrow(run, schema)


def encode(
    docs: DataFrame, path: str, text_col: str = "text", out: str = "pieces", decoded: str | None = None
) -> DataFrame:
    """``docs`` with the ids of each text in ``out`` (array of int); empty for a null or empty text.

    ``path`` names the vocabulary on every machine. Equally named columns are replaced.
    With ``decoded``, a column of that name holds what the ids decode to, as a check.
    """

    def work(texts: pa.Array) -> list[pa.Array]:
        encoder = _encoder(path)
        made = encoder.encode(texts.to_pylist())
        ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
        columns = [pa.ListArray.from_arrays(ends, np.concatenate(made))]
        if decoded:
            columns.append(pa.array([encoder.vocabulary.decode(ids.tolist()) for ids in made], pa.string()))
        return columns

    added: dict[str, DataType] = {out: ArrayType(IntegerType())}
    if decoded:
        added[decoded] = StringType()
    return _mapped(docs, F.coalesce(text_col, F.lit("")), added, work)


def decode(docs: DataFrame, path: str, pieces_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of each array of ids in ``out``; a null array is an empty text."""

    def work(ids: pa.Array) -> list[pa.Array]:
        vocabulary = _encoder(path).vocabulary
        return [pa.array([vocabulary.decode(x) for x in ids.to_pylist()], pa.string())]

    return _mapped(docs, F.coalesce(pieces_col, F.array().cast("array<int>")), {out: StringType()}, work)
