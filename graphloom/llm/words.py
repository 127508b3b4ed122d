"""64-bit hashes of words and word shingles, for whole batches of texts at once in numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Its hash is a polynomial over a random table of bytes, read off
prefix sums, then mixed. A shingle's hash combines those of WIDTH words in a row; a text with fewer words is one
shingle as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
#: Bytes that are hashed at a time; longer texts go through in parts cut at white space.
PART = 1 << 18

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_PLACES = _rng.integers(1, 2**63, WIDTH, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PART + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def _hash_part(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word."""
    a = np.frombuffer(data, np.uint8)
    power, inverse = _power(len(a) + 1)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLE[a] * power[: len(a)], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), start


def _parts(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space; a word longer than a part stays whole."""
    at = 0
    while at < len(data):
        end = at + PART
        if end < len(data):
            cuts = [c for c in (data.rfind(s, at, end) for s in (b" ", b"\n", b"\t")) if c > at]
            if cuts:
                end = max(cuts)
            else:
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
        yield data[at:end]
        at = end


def word_hashes(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order; about PART bytes of texts are held at a time."""
    group: list[bytes] = []
    held = 0

    def hashed() -> Iterator[np.ndarray]:
        if group:
            h, start = _hash_part(b" ".join(group))
            ends = np.cumsum([len(t) + 1 for t in group])
            group.clear()
            yield from np.split(h, np.searchsorted(start, ends[:-1]))

    for t in texts:
        if held + len(t) > PART:
            yield from hashed()
            held = 0
        if len(t) > PART:
            yield np.concatenate([_hash_part(p)[0] for p in _parts(t)])
        else:
            group.append(t)
            held += len(t) + 1
    yield from hashed()


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; none for a text without words."""
    n = len(words)
    if n == 0:
        return words
    if n < WIDTH:
        return mix((words * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    h = words[: n - WIDTH + 1] * _PLACES[0]
    for i in range(1, WIDTH):
        h = h + words[i : n - WIDTH + 1 + i] * _PLACES[i]
    return mix(h)


def encoded(texts) -> Iterator[bytes]:
    return (b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts)
