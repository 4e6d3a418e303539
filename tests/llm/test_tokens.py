"""Token counts against the tokenizer library."""

import random

import public_tokenizers
import pytest

from stowage.llm import token_counts


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.Vocabulary.load(public_tokenizers.path(token_counts.VOCABULARY)))


def texts():
    rng = random.Random(3)
    spaces = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0    　​﻿"
    letters = spaces + "aabcdest'lrvm  \n09²éß漢🙂́,.!<|>"
    out = ["", " ", "  ", "<|endoftext|>", "a<|endoftext|> b", "I'll don't 'Tis", "x" * 3000, "ab" * 999, spaces]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)]


@pytest.mark.parametrize("chunk", [1, 5, 1 << 16])
def test_any_chunking_gives_the_library_s_counts(library, counter, chunk):
    assert counter.totals(texts(), chunk) == library(texts())


def test_state_maps_compose_associatively(counter):
    maps = [counter.state_map(t) for t in ("abc de", "f", " ghi  ", "", "jk 'll", "mno")]
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = counter.compose(left, m)
    for m in reversed(maps[:-1]):
        right = counter.compose(m, right)
    assert left.head == right.head and left.tail == right.tail and left.count == right.count


def test_rows(awkward, nothing, library):
    got = token_counts.count_tokens(awkward).collect()
    want = library([r.text or "" for r in awkward.collect()])
    assert sorted(r.n_tokens for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(nothing).count() == 0


def test_units_meet_white_space_of_all_kinds(counter, library):
    rng = random.Random(8)
    parts = ["a", "the", "the,", "don't", "x\ny", "end.\n", "\n", "", " ", "\t", "\u00a0", "\u3000", "9", "\x1c", "é", "<|endoftext|>"]
    many = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert counter.totals(many) == library(many)


def test_states_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(token_counts, "STATES_KEPT", 300)
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 50)
    small = token_counts.Counter(token_counts.Vocabulary.load(public_tokenizers.path(token_counts.VOCABULARY)))
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 30, 4000]))) for _ in range(60)]
    for word in words:
        assert small.totals([word]) == library([word])
        transducer = small.words.transducer
        assert max(len(transducer.states), len(transducer.known_fits)) < 300 + 100
    assert max(len(small.words), len(small.units)) <= 50
