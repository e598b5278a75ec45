"""Viterbi totals against a plain search; decoding restores every text."""

import random

import pytest
from data import no_docs, odd_docs

from arcloom.llm.pieces import MARK, SPACE, Encoder, Vocabulary, decode, encode

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary.load(PATH))


def best_total(v, word):
    pieces = {p: v.scores[i] for i, p in enumerate(v.pieces) if v.usable[i]}
    best = [0.0]
    for end in range(1, len(word) + 1):
        char = word[end - 1]
        options = [best[-1] + len((SPACE if char == MARK else char).encode()) * v.byte_score]
        options += [best[end - n] + pieces[word[end - n : end]] for n in range(1, min(16, end) + 1) if word[end - n : end] in pieces]
        best.append(max(options))
    return best[-1]


def test_totals_and_round_trips(encoder):
    rnd = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "é", "日", SPACE, "\n", "\U0001f600", ".", "!!", "Wort", "\t", "\x00", "1", "²."]
    texts = ["", " ", "\n\n", SPACE, "a" * 300, *["".join(rnd.choices(parts, k=rnd.randint(1, 40))) for _ in range(200)]]
    v = encoder.vocabulary
    single = set(v.byte_ids.tolist())
    for text, ids in zip(texts, encoder.encode(texts)):
        assert v.decode(ids.tolist()) == text
        # One search over the whole text: cutting it into words loses nothing.
        whole = SPACE + text.replace(SPACE, MARK).replace(" ", SPACE) if text else ""
        got = sum(v.byte_score if i in single else v.scores[i] for i in ids.tolist())
        # A run of marks in front of a word is cut before it, as no piece holds marks and letters but one mark first.
        assert got == pytest.approx(sum(best_total(v, w) for w in encoder.words(text)))
        if SPACE * 2 not in whole:
            assert got == pytest.approx(best_total(v, whole))


def test_a_forgotten_word_is_found_again(encoder, monkeypatch):
    monkeypatch.setattr("arcloom.llm.pieces.CACHE_WORDS", 3)
    small = Encoder(encoder.vocabulary)
    for text in ("a b c d e", "f g a b", "c"):
        assert small.encode([text])[0].tolist() == encoder.encode([text])[0].tolist()


def test_odd_rows(spark):
    docs = odd_docs(spark)
    made = encode(docs, PATH, decoded="again")
    rows = decode(made, PATH).collect()
    assert len(rows) == docs.count()
    assert all(r.decoded == r.again == (r.text or "") for r in rows)
    assert {r["keys"] for r in rows} == {7}
    assert encode(no_docs(spark), PATH).count() == 0
