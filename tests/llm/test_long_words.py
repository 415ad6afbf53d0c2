"""Words and texts built to defeat hashes, caches and scans."""

import time

import numpy as np
import pytest

from logcompact.llm.jaccard import jaccard_components
from logcompact.llm.pii import Finder
from logcompact.llm.queries import vocabulary
from logcompact.llm.shingles import BLOCK, shingle_sets, word_hashes
from logcompact.llm.tokens import TokenIds
from logcompact.llm.wordpiece import Automaton, count_pieces


def doubled(times):
    """Two words that every polynomial modulo a power of two confuses once they are long enough."""
    s, t = "a", "b"
    for _ in range(times):
        s, t = s + t, t + s
    return s, t


@pytest.fixture(scope="module")
def encoder():
    return TokenIds(vocabulary("word_bpe_49k.json"))


@pytest.mark.parametrize("times", range(5, 13))
def test_doubled_words_keep_their_own_ids(encoder, times):
    s, t = doubled(times)
    found = [x.tolist() for x in encoder([s, t, f"{t} x {s}", s.upper()])]
    assert found == [encoder.whole(x).tolist() for x in (s, t, f"{t} x {s}", s.upper())] and found[0] != found[1]


@pytest.mark.parametrize("times", range(5, 13))
def test_doubled_words_are_different_shingles(times):
    s, t = doubled(times)
    a, b, c = shingle_sets([f"{s} w x y z", f"{t} w x y z", f"{s.upper()} w x y z"])
    assert len(a) == len(b) == 1 and a[0] != b[0] and a[0] == c[0]


def test_texts_of_doubled_words_are_not_linked(spark):
    rest = " ".join(f"w{k}" for k in range(4))
    texts = [f"{x} {rest}" for k in (9, 10, 11) for x in doubled(k)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_components(docs).collect()} == set(range(6))


def test_hashes_of_long_texts_do_not_depend_on_their_stretches():
    r = np.random.default_rng(1)
    words = ["x" * int(n) for n in r.integers(1, 40, 60_000)] + ["y" * (BLOCK + 5), "z", "y" * (BLOCK + 5)]
    data = " \t".join(words).encode()
    at, keys = word_hashes(data)
    assert len(data) > 3 * BLOCK and len(at) == len(words)
    alone = {w: int(word_hashes(w.encode())[1][0]) for w in set(words)}
    assert keys.tolist() == [alone[w] for w in words] and len(set(alone.values())) == len(alone)


def test_each_vocabulary_has_its_own_automaton(spark):
    single = [bytes([b]) for b in range(256)]
    docs = spark.createDataFrame([(1, "abab b")], "doc_id long, text string").coalesce(1)
    counts = [count_pieces(docs, [*single, piece], b" ").first()["n_tokens"] for piece in (b"ab", b" a", b"zz", b"bab")]
    assert counts == [5, 6, 7, 5]


def test_pieces_that_close_more_than_a_byte_counts():
    pieces = [bytes([b]) for b in range(256)] + [b"a" * 400]
    machine = Automaton(pieces)
    word = np.frombuffer(b"a" * 300 + b"b", dtype=np.uint8)
    assert machine.lengths(word, np.array([0]), np.array([301])).tolist() == [301]
    word = np.frombuffer(b"a" * 900, dtype=np.uint8)
    assert machine.lengths(word, np.array([0]), np.array([900])).tolist() == [102]


def test_a_word_of_ten_million_bytes():
    machine = Automaton([bytes([b]) for b in range(256)] + [b"ab", b"aba"])
    data = np.frombuffer(b"ab" * 5_000_000 + b" abab", dtype=np.uint8)
    began = time.perf_counter()
    found = machine.lengths(data, np.array([0, 10_000_001]), np.array([10_000_000, 10_000_005]))
    # aba, b and so on: two pieces for every four letters
    assert found.tolist() == [5_000_000, 2] and time.perf_counter() - began < 30


ANCHORS = [
    "AKIA", "AKIA ", "@", "a@", "a@b", "a@b.", "+", "+1", "+1 ", "://", "a://b:", "1", "1.", "1.1", "1 ", "1-1", "token", "token ", "token=", "token:x",
    "iban", "iban ", "iban 1", "iban GB", "account no 1 ", "ssn ", "password_", "password=\"", "api_key a", "x", ".", " ", "İ",
]


@pytest.mark.parametrize("anchor", ANCHORS)
def test_long_texts_of_one_anchor_take_linear_time(anchor):
    finder = Finder()
    text = anchor * (1_000_000 // len(anchor))
    began = time.perf_counter()
    finder(text)
    finder("token " + text)
    assert time.perf_counter() - began < 20


def test_access_keys_stand_alone():
    key = "AKIA" + "0123456789ABCDEF"
    finder = Finder()
    assert finder(f"{key} x{key} {key}0 -{key} {key}")["secret"] == [(0, 20), (87, 107)]
