import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from data import docs_of, no_docs, odd_docs, prose
from tokenizers import Tokenizer

from arcloom.llm import align
from arcloom.llm.components import stored

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The contract's columns and the groups, each whole text encoded at once, all pairs of tokens compared in order."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    letters = align.byte_letters()
    docs = []
    for doc_id, text in rows:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((doc_id, [], [], [], []))
            continue
        links, groups, i, j, end_a, end_b, group = [], [], 0, 0, len(bytes_a[0]), len(bytes_b[0]), ([x[0]], [y[0]])
        while True:
            links.append((x[i], y[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                groups.append(group)
                group = ([], [])
            if step_a:
                i += 1
            if step_b:
                j += 1
            if i == len(x) or j == len(y):
                break
            if step_a:
                end_a += len(bytes_a[i])
                group[0].append(x[i])
            if step_b:
                end_b += len(bytes_b[j])
                group[1].append(y[j])
        docs.append((doc_id, x, y, groups, links))
    counts = Counter(p for d in docs for p in d[4])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, x, y, groups, links in docs:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        n_best = sum(counts[p] == best[p[1]] for p in links)
        out.append((doc_id, len(x), len(y), len(groups), len(links), n_best, sum(counts[p] for p in links), digest, text))
    return sorted(out, key=str)


def found(docs, **how):
    both = align.Alignment(*FILES, **how)
    aligned = stored(both.align(docs, groups=True), "aligned")
    made = both.scores(aligned, both.pair_counts(aligned))
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    return sorted([tuple(r[c] for c in columns) for r in made.collect()], key=str)


def odd_texts():
    rnd = random.Random(4)
    signs = ["a", "be", " ", "  ", "\n", "\t", "é", "é", " ", " ", "\x1c", "▁", "日本", "\U0001f600", "'s", "<s>", "<|endoftext|>", "<0x41>", "1234", "...", "İ", "don't", "\x00", "ﬁ"]
    out = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 30))) for _ in range(250)]
    return [*out, " ", "  ", "\n", " a", "a ", "a  b", "a \nb", "a\n b", "x" * 5000, "word " * 3000, "<unk>", "don 't \x1c x"]


@pytest.mark.parametrize("broadcast_pairs", [10**6, 0])
def test_odd_texts(spark, broadcast_pairs):
    """Blanks of all kinds, signs beyond both vocabularies, texts like special tokens; by broadcast and by parts."""
    texts = odd_texts() + [prose(i, 30) for i in range(10)]
    made = found(docs_of(spark, texts).repartition(3), broadcast_pairs=broadcast_pairs)
    whole = plain(list(enumerate(texts)))
    assert made == whole
    assert 20 < sum(r[1] == 0 for r in whole) < 200


@pytest.mark.parametrize("broadcast_pairs", [10**6, 0])
def test_odd_rows(spark, broadcast_pairs):
    docs = odd_docs(spark)
    assert found(docs, broadcast_pairs=broadcast_pairs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_parts_and_forgetting(spark, monkeypatch):
    """Batches of few characters and a short memory change nothing."""
    texts = [prose(i % 7, 40) for i in range(30)] + odd_texts()[:40]
    aligner = align.Aligner(*FILES)
    whole = aligner.align(texts)
    monkeypatch.setattr(align, "UNITS", 5)
    monkeypatch.setattr(align, "LONG", 3)
    for text, row in zip(texts, whole):
        assert str(aligner.align([text])[0]) == str(row)


def test_no_rows(spark):
    assert found(no_docs(spark)) == [] == found(no_docs(spark), broadcast_pairs=-1)
