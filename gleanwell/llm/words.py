"""Words of many texts at once, as 64-bit values in numpy arrays.

A word is a longest run of letters and digits after lower-casing. A batch of texts becomes one array of code points; a
polynomial prefix sum over it gives the hash of every run in a few array operations, whatever the number of words.
"""

from __future__ import annotations

import numpy as np

#: Characters that are hashed in one go; a longer text is cut between words, a longer word is summed part by part.
CHUNK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        if name == "word":
            _tables[name] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
        else:
            base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
            steps = np.full(CHUNK * 2, base, dtype=_U)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=_U)
    return _tables[name]


def word_flags(points: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits."""
    return _table("word")[points]


def _values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(_U) + _U(0x1D8E4E27C47D124F)) * _table("up")[: len(points)]


def _hash_points(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words among at most 2 * CHUNK code points."""
    is_word = word_flags(points)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(points) + 1, dtype=_U)
    np.cumsum(_values(points), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _table("down")[starts] + (ends - starts).astype(_U)), starts


def _long_word(word: str) -> np.ndarray:
    """The hash of one word of any length: that which _hash_points gives it, from the sums of its parts."""
    total, scale, step = 0, 1, pow(_BASE, CHUNK, 1 << 64)
    for i in range(0, len(word), CHUNK):
        points = np.frombuffer(word[i : i + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        total, scale = (total + int(_values(points).sum(dtype=_U)) * scale) % (1 << 64), scale * step % (1 << 64)
    return mix(np.array([total], dtype=_U) + _U(len(word)))


def _pieces(text: str) -> list[str]:
    """A long text in parts cut between words: of about CHUNK characters, or one longer word."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while at < end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
            end -= 1
        if end == at:  # a word that is longer than a part
            end = at + CHUNK
            while end < len(text) and text[end].isalnum():
                end += 1
        out.append(text[at:end])
        at = end
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and offsets: text i has hashes[offsets[i]:offsets[i + 1]]."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    group: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        points = np.frombuffer("\n".join(group).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        h, starts = _hash_points(points)
        bounds = np.cumsum([0] + [len(g) + 1 for g in group])
        at = np.searchsorted(starts, bounds)
        np.add.at(counts, owners, np.diff(at))
        hashes.append(h)
        group.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        low = text.lower()
        for piece in [low] if len(low) <= CHUNK else _pieces(low):
            if size + len(piece) + 1 > CHUNK:
                flush()
            if len(piece) > CHUNK:
                hashes.append(_long_word(piece))
                counts[i] += 1
                continue
            group.append(piece)
            owners.append(i)
            size += len(piece) + 1
    flush()
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=_U)), offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size consecutive words within one text, and their offsets by text."""
    counts = np.maximum(np.diff(offsets) - (size - 1), 0)
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    if not out[-1]:
        return np.zeros(0, dtype=_U), out
    first = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(out[-1])
    run = hashes[first]
    for k in range(1, size):
        run = run * _U(0xD6E8FEB86659FD93) + hashes[first + k]
    return mix(run), out
