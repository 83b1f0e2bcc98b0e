"""What the token counts and the joined words rest on: tokens are reached by the rules, a word has one closing id."""

import random

import numpy as np
import public_tokenizers

from quillon.llm.tokens import ChunkIds, MergeCounter, library, word_ends

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_every_token_is_reached_by_the_rules():
    counter = MergeCounter(VOCABULARY)
    suffix, open_ = counter.end, MergeCounter(VOCABULARY)
    open_.end = ""
    for a, b in counter.rank:
        token = a + b
        assert (counter.piece(token[: -len(suffix)]) if token.endswith(suffix) else open_.piece(token)) == 1


def test_a_plain_word_has_one_closing_id_at_its_end():
    ids, r = ChunkIds(VOCABULARY), random.Random(3)
    letters = [c for c in map(chr, range(33, 0x250)) if ids.plain(c)]
    words = letters + ["".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(3000)]
    ends, tok = word_ends(VOCABULARY), library(VOCABULARY)
    alone = [tok.encode(w, add_special_tokens=False).ids for w in words]
    whole = sum(ends[i].sum() == 1 and ends[i[-1]] for i in alone)
    assert whole > 0.99 * len(words), "the rest, if any, takes the library's way word by word"
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.texts(words)] == alone


def test_joined_words_that_do_not_part_go_one_by_one(monkeypatch):
    ids = ChunkIds(VOCABULARY)
    words = ["one", "Two", "déjà", "x" * 99]
    ids.ends = np.zeros_like(ids.ends)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.texts(words)] == [library(VOCABULARY).encode(w, add_special_tokens=False).ids for w in words]


def test_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr("quillon.llm.tokens.REMEMBERED", 20_000)
    ids, counter, tok = ChunkIds(VOCABULARY), MergeCounter(VOCABULARY), library(VOCABULARY)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) + " " + "qz" * (500 * i) for i in range(60)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    got = []
    for t in texts:
        got += ids.texts([t])
        assert ids.size <= 20_000 and all(len(c) <= 100 for c in ids.known)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [counter.text(t) for t in texts] == list(map(len, want)) and counter.size <= 20_000 and all(len(c) <= 100 for c in counter)
