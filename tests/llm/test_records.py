"""Records read back against the tokenizer itself; damage is noticed."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from data import docs_of, no_docs, odd_docs, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arcloom.llm import records
from arcloom.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "Straße ΑΣ Σ x", "İstanbul IS", "a\x1cb c\x1d", "<|endoftext|> x<|startoftext|>y", "é é", " a b　c", "ﬁ ǅ",
    "don't I'LL we're 12,34 ''s", "日本語 テキスト", "a\u0085b ​z", "\U0001f600\U0001f600 !!", "µ ſ K Å", "x\x00y z\x0b",
]


def ids_of(texts):
    made = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [e.ids + [2] for e in made]


def test_words_give_the_ids_of_the_whole_text(monkeypatch):
    encoder = records.WordEncoder(PATH, 2)
    texts = ODD + [prose(n, 40).title() + "." for n in range(20)]
    read = lambda: [np.frombuffer(b, encoder.width).tolist() for b in encoder.encode(texts)]
    assert read() == ids_of(texts)
    monkeypatch.setattr(records, "CACHE_WORDS", 5)
    assert read() == ids_of(texts)


def test_every_near_sign_in_context():
    """All code points below the far ones, also those whose lower case lies beyond, beside letters and alone."""
    texts = [pattern.replace("?", chr(c)) for c in range(0x300) for pattern in ("?b", "a?b", "a? b", "1?,")]
    encoder = records.WordEncoder(PATH, 2)
    assert [np.frombuffer(b, encoder.width).tolist() for b in encoder.encode(texts)] == ids_of(texts)


def test_records_read_back_in_any_order(spark):
    texts = [*ODD, None, *[prose(n, 30) for n in range(30)], prose(1, 3000)]
    docs = docs_of(spark, texts).repartition(5)
    folder = scratch_path(spark, "records")
    index = records.starts(records.write_records(docs, folder, PATH, 2, parts=4))
    assert index.select("part").distinct().count() > 1
    shuffled = index.orderBy(F.xxhash64("doc_id"))
    rows = sorted(records.read_records(shuffled, folder, block=500).collect(), key=lambda r: r.doc_id)
    want, start = ids_of([t or "" for t in texts]), 0
    for r, ids in zip(rows, want, strict=True):
        assert r.ids == ids and r.start == start
        start += len(ids)
    told = sorted(records.read_digests(shuffled, folder).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.start, r.n_tokens) for r in told] == [(r.doc_id, r.start, len(r.ids)) for r in rows]
    assert [r.ids_crc32 for r in told] == [zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) for ids in want]


def test_damage_is_noticed():
    framed = records.frame(b"abcdef")
    assert records.unframe(b"xx" + framed, 2) == (b"abcdef", 2 + len(framed))
    for at in range(len(framed)):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    with pytest.raises(ValueError):
        records.unframe(framed[:-5])


def test_odd_rows_and_no_documents(spark):
    docs, folder = odd_docs(spark), scratch_path(spark, "records")
    index = records.starts(records.write_records(docs, folder, PATH, 2))
    rows = records.read_records(index, folder).collect()
    assert len(rows) == docs.count()
    order = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in order[:2]] == [None, None]
    assert [r.doc_id for r in order[2:]] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert sum(len(r.ids) for r in rows) == order[-1].start + len(order[-1].ids)
    folder = scratch_path(spark, "records")
    assert records.read_records(records.starts(records.write_records(no_docs(spark), folder, PATH, 2)), folder).count() == 0
