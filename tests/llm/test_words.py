import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanwell.llm import words
from gleanwell.llm.leakage import myers

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_hashes_name_words(texts):
    h, at = words.word_hashes(texts)
    plain = [WORD.findall(t.lower()) for t in texts]
    assert list(np.diff(at)) == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(h.tolist())) == len(set(flat)) and {(w, x) for w, x in zip(flat, h.tolist())} == {(w, dict(zip(flat, h.tolist()))[w]) for w in flat}


def test_long_texts_are_whole():
    text = " ".join(f"wört{i}" for i in range(80_000))
    h, at = words.word_hashes(["a b", text, ""])
    again, _ = words.word_hashes(["wört79999 b"])
    assert list(np.diff(at)) == [2, 80_000, 0] and h[at[2] - 1] == again[0] and h[1] == again[1]


def test_long_words_are_whole():
    long, other = "x" * 300_000, "é" * (words.CHUNK * 2 + 5)
    texts = [f"a {long}, b {other} c", long.upper(), f"{other}", long + "y", "a c"]
    h, at = words.word_hashes(texts)
    assert list(np.diff(at)) == [5, 1, 1, 1, 2]
    assert h[1] == h[5] != h[7] and h[3] == h[6] and h[0] == h[8] and h[4] == h[9]


def test_parts_of_any_size_give_one_hash(monkeypatch):
    texts = [f"w{i} and {'q' * (i % 50)}." for i in range(200)]
    want = words.word_hashes(texts)
    monkeypatch.setattr(words, "CHUNK", 16)
    monkeypatch.setattr(words, "_tables", {})
    got = words.word_hashes(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_shingles_stay_within_texts():
    h, at = words.word_hashes(["a b c d", "a b", "", "a b c"])
    s, sat = words.shingles(h, at, 3)
    assert list(np.diff(sat)) == [2, 0, 0, 1] and s[0] == s[2] != s[1]


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=14), st.lists(st.integers(1, 4), max_size=20))
def test_bit_parallel_distance(p, t):
    got = myers(np.array([p], dtype=np.uint64), np.array([t], dtype=np.uint64).reshape(1, -1))
    assert got[0] == edit_distance(p, t)
