"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard file is a run of frames: the length of the data (8 bytes, little endian), the
masked checksum of these 8 bytes, the data, and the masked checksum of the data (4
bytes each). The data are the ids of one document, as unsigned integers of 2 or 4
bytes. Documents are range-partitioned by id; each task sorts its own, writes one
shard file, and returns one index row per document, which Spark writes as Parquet.

A shard's name holds a random part, and only index rows of the task that Spark
commits survive: files of lost or repeated attempts are named by no row.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.session import scratch_path

HEAD = 12
FOOT = 4
# Added to a rotated checksum, so that checksums of data that hold checksums differ. (Format value.)
MASK = 0xA282EAD8
# Below this, characters neither combine nor change case by their neighbours. (Unicode.)
PLAIN_BELOW = "\u0300"
FAR = re.compile(f"[^\x00-{chr(ord(PLAIN_BELOW) - 1)}]")
# Apostrophes cut words by what follows, special tokens are one id, and Python's
# idea of a blank is wider than the vocabulary's.
CONTEXT = re.compile("'|<\\||[\x1c-\x1f]")
CACHE_WORDS = 300_000
BATCH = 300


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join(
        (head, struct.pack("<I", masked_checksum(head)), data, struct.pack("<I", masked_checksum(data)))
    )


def unframe(buffer: bytes, at: int = 0) -> tuple[bytes, int]:
    """The data of the frame at ``at`` and where the next begins; damage raises ``ValueError``."""
    head = buffer[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", buffer, at + 8)[0] != masked_checksum(head):
        raise ValueError(f"damaged length at byte {at}")
    (size,) = struct.unpack("<Q", head)
    data = buffer[at + HEAD : at + HEAD + size]
    if len(data) < size or struct.unpack_from("<I", buffer, at + HEAD + size)[0] != masked_checksum(data):
        raise ValueError(f"damaged data at byte {at}")
    return data, at + HEAD + size + FOOT


def _classes() -> tuple[str, str]:
    """Letters and numbers below ``PLAIN_BELOW``, as the insides of a character class."""
    chars = [chr(c) for c in range(ord(PLAIN_BELOW))]
    return tuple("".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind) for kind in "LN")


LETTERS, NUMBERS = _classes()
# The vocabulary's own cut: runs of letters, single numbers, runs of anything else but blanks.
PARTS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")


def _byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return [chr(n) for _, n in sorted([(b, b) for b in shown] + [(b, 256 + i) for i, b in enumerate(hidden)])]


BYTE_CHARS = _byte_chars()


class WordEncoder:
    """A tokenizers file applied to distinct parts of words, remembered up to a bound.

    The vocabulary drops white space and cuts texts into parts, each encoded by itself,
    so a text's ids are those of its parts in turn. Texts whose cut or normal form
    depends on more (apostrophes, combining or far characters, special tokens) go to
    the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Remembered(self._ids)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4"
        self.end = np.array([] if end_id is None else [end_id], self.width).tobytes()

    @staticmethod
    def _plain(text: str) -> bool:
        return (text.isascii() or not FAR.search(text)) and not CONTEXT.search(text)

    def _ids(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else "".join([BYTE_CHARS[b] for b in part.encode()])
        return np.array([t.id for t in self.model.tokenize(shown)], self.width).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            lowered = text.lower()
            # Lower case may lie further off than its capital.
            if not (self._plain(text) and self._plain(lowered)):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, self.width).tobytes() + self.end)
                continue
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            out.append(b"".join(map(self.known.__getitem__, PARTS.findall(lowered))) + self.end)
        return out


class _Remembered(dict):
    """Parts and their ids; a new part is encoded when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.encode(part)
        return ids


_ENCODERS: dict[tuple, WordEncoder] = {}


def _encoder(path: str, end_id: int | None) -> WordEncoder:
    """One per worker process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def _open(folder: str):
    """The file system and path of a shared folder, for use within a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


INDEX = "shard string, part int, row bigint, doc_id bigint, offset bigint, size bigint, n_tokens bigint, local_start bigint, width string"


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = None, parts: int | None = None) -> DataFrame:
    """Encode ``docs (doc_id, text)`` into shard files below ``folder``; the stored offset index.

    Order: ``doc_id`` (null first), then a hash of the text. A null text is empty, its record
    holds ``end_id`` alone. Rows are never merged: a repeated row has its own record.
    Index ``(shard, part, row, doc_id, offset, size, n_tokens, local_start, width)``:
    ``part`` and ``row`` give the order over all shards, ``local_start`` counts the ids
    before the document within its shard. ``folder`` must be shared by all executors.
    """
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Bounds are drawn from what orders the rows: numbers, never texts. Equal rows need not share a shard.
    order = [F.col("doc_id").asc_nulls_first(), F.col("print"), F.col("turn")]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, end_id)
        system, path = _open(folder)
        name = f"{uuid.uuid4().hex}.records"
        width = np.dtype(encoder.width).itemsize
        row = offset = start = 0
        out = None
        try:
            for frame_ in frames:
                for at in range(0, len(frame_), BATCH):
                    part = frame_.iloc[at : at + BATCH]
                    data = encoder.encode(part["text"].tolist())
                    framed = [frame(d) for d in data]
                    if out is None:
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}")
                    out.write(b"".join(framed))
                    sizes = np.array([len(f) for f in framed], np.int64)
                    tokens = np.array([len(d) // width for d in data], np.int64)
                    yield pd.DataFrame({
                        "shard": name, "part": part["part"].to_numpy(), "row": row + np.arange(len(part)),
                        "doc_id": part["doc_id"].astype("Int64"),
                        "offset": offset + np.cumsum(sizes) - sizes, "size": sizes,
                        "n_tokens": tokens, "local_start": start + np.cumsum(tokens) - tokens,
                        "width": encoder.width,
                    })
                    row, offset, start = row + len(part), offset + int(sizes.sum()), start + int(tokens.sum())
        finally:
            if out is not None:
                out.close()

    sorted_docs = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumns({"print": F.xxhash64("text"), "turn": F.monotonically_increasing_id()})
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    stored = f"{folder}/index"
    sorted_docs.mapInPandas(write, INDEX).write.parquet(stored)
    return spark.read.parquet(stored)


def starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``: the ids of all documents before each. One row per shard is put in order."""
    spark = index.sparkSession
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    path = scratch_path(spark, "shard-starts")
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(path)
    bases = spark.read.parquet(path)
    return index.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_records(index: DataFrame, folder: str, block: int = 4 << 20) -> DataFrame:
    """``(shard, part, row, doc_id, start, ids)`` for the rows of ``index`` (with ``start``), in any order.

    The rows may be any, shuffled or not: those a batch has of one shard are read in
    order of offset, records that lie close together at once, at most ``block`` bytes.
    Every length and checksum is checked.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ids in _fetched(frames, folder, block):
            yield pd.DataFrame({
                "shard": part["shard"], "part": part["part"], "row": part["row"],
                "doc_id": part["doc_id"].astype("Int64"), "start": part["start"],
                "ids": pd.Series([x.astype(np.int32) for x in ids], index=part.index, dtype=object),
            })

    schema = "shard string, part int, row bigint, doc_id bigint, start bigint, ids array<int>"
    return index.select(*WANTED).mapInPandas(read, schema)


def read_digests(index: DataFrame, folder: str, block: int = 4 << 20) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the records read back, without their ids.

    ``ids_crc32`` is the checksum of the ids as little-endian unsigned 32-bit integers.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ids in _fetched(frames, folder, block):
            yield pd.DataFrame({
                "doc_id": part["doc_id"].astype("Int64"), "start": part["start"],
                "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
            })

    return index.select(*WANTED).mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


WANTED = ["shard", "part", "row", "doc_id", "offset", "size", "start", "width"]


def _fetched(
    frames: Iterator[pd.DataFrame], folder: str, block: int
) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Index rows of one shard that are read at once, with their ids."""
    system, path = _open(folder)
    for frame_ in frames:
        for shard, rows in frame_.groupby("shard", sort=False):
            rows = rows.sort_values("offset")
            with system.open_input_file(f"{path}/{shard}") as file:
                for part in _stretches(rows, block):
                    at = int(part["offset"].iloc[0])
                    end = int(part["offset"].iloc[-1] + part["size"].iloc[-1])
                    buffer = file.read_at(end - at, at)
                    data = [unframe(buffer, int(o) - at)[0] for o in part["offset"]]
                    yield part, [np.frombuffer(d, w) for d, w in zip(data, part["width"])]


def _stretches(rows: pd.DataFrame, block: int) -> Iterator[pd.DataFrame]:
    """Cut rows in order of offset into reads of at most ``block`` bytes (one record at least)."""
    offsets, sizes = rows["offset"].to_numpy(), rows["size"].to_numpy()
    first = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or offsets[i] + sizes[i] - offsets[first] > block:
            yield rows.iloc[first:i]
            first = i
