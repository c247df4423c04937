"""Hashes of word shingles, many texts at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES, OTHER_BYTES = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)]
_INVERSE: list[np.ndarray] = [np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers modulo 2^64, and their inverses."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for held, x in ((_POWERS, _BASE), (_INVERSE, inverse)):
            factors = np.full(size, x)
            factors[0] = 1
            held[0] = np.multiply.accumulate(factors)
    return _POWERS[0][:n], _INVERSE[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hashes(data: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Hash of every prefix of the bytes, from the empty one on; other values of the bytes give independent hashes."""
    powers, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[:-1], out=out[1:])
    return out


def span_hashes(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal spans have equal hashes wherever they stand."""
    _, inverse = _powers(len(prefixes))
    return mix((prefixes[ends] - prefixes[starts]) * inverse[starts])


def string_hashes(strings: np.ndarray) -> np.ndarray:
    """Hashes of byte strings of one length, the rows of an array; as `span_hashes` gives them."""
    powers, _ = _powers(strings.shape[1] + 1)
    return mix((_BYTES[strings] * powers[:-1]).sum(1, dtype=np.uint64))


def shingles(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts one after another (repeats included), and how many each text has.

    Words are runs of non-blank characters of the lower-case text. A text of fewer words has one shingle, of them all;
    one without words has none.
    """
    return _shingles([t.lower().encode("utf-8", "replace") for t in texts], words, lambda data: data > 32)


def ascii_shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with A to Z only lower-cased, and words split at blank and 09 to 0D only."""
    return _shingles([t.encode("utf-8", "replace").lower() for t in texts], words, lambda data: (data != 32) & ((data < 9) | (data > 13)))


def _shingles(raw: list[bytes], words: int, in_word: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(x + b"\n" for x in raw), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text_ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    inside = in_word(data)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    hashes = span_hashes(prefix_hashes(data), starts, ends)
    owner = np.searchsorted(text_ends, starts, "right")
    counts = np.bincount(owner, minlength=len(raw)).astype(np.int64)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    for k in range(min(words, n)):
        rolled[: n - k] = rolled[: n - k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:]
        whole[n - k :] = False
    if n < words:
        whole[:] = False
    if n >= words:
        whole[: n - words + 1] &= owner[: n - words + 1] == owner[words - 1 :]
    short = np.flatnonzero((counts > 0) & (counts < words))
    first = np.cumsum(counts) - counts
    for t in short:
        value = 1
        for h in hashes[first[t] : first[t] + counts[t]].tolist():
            value = (value * 0xD6E8FEB86659FD93 + h) % (1 << 64)
        rolled[first[t]], whole[first[t]] = value, True
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    return mix(rolled[whole]), sizes


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 0.0
