"""Vectorised passes over the UTF-8 bytes of many texts at once.

A batch of texts is one byte buffer plus offsets. Word and window names are 64-bit
polynomial sums over that buffer, so a whole batch costs a few numpy passes and no
Python loop over words. Equal bytes get equal names; different bytes get equal names
with a probability of about 2**-60 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = 0x9E3779B97F4A7C13  # odd, 3 modulo 8: powers have a long period
_INVERSE = pow(_STEP, -1, 1 << 64)
#: Longer words are named by BLAKE2: a polynomial modulo 2**64 gives some different long
#: strings of two letters one sum, whatever its step and values.
LONGEST = 64
#: Bytes handled at once; one longer text is handled alone.
CHUNK = 1 << 21

_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_folded = _values.copy()
_folded[65:91] = _values[97:123]
#: 0x20 and 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte that is no letter or digit.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(b).isalnum() for b in range(128)]

_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse, modulo 2**64."""
    have = _powers.get("n", 0)
    if n > have:
        n = max(n, CHUNK, 2 * have)
        for name, base in (("up", _STEP), ("down", _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


def pieces(offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes come to about one chunk."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def prefix_sums(body: np.ndarray, values: np.ndarray = _values) -> np.ndarray:
    """S with S[j] - S[i] = sum of value(byte) * step**position over [i, j)."""
    up, _ = powers(len(body) + 1)
    sums = np.empty(len(body) + 1, U64)
    sums[0] = 0
    np.cumsum(values[body] * up[: len(body)], out=sums[1:])
    return sums


def word_spans(body: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes outside ``gaps``; words don't cross texts."""
    if not len(body):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~gaps[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(body: np.ndarray, offsets: np.ndarray, fold: bool = True, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, bounds, starts, ends): bounds[i]:bounds[i + 1] are the words of text i.
    ``fold`` makes A-Z equal a-z; with ``marks`` ASCII marks part words too."""
    starts, ends = word_spans(body, offsets, MARKS if marks else SPACE)
    sums = prefix_sums(body, _folded if fold else _values)
    _, down = powers(len(body) + 1)
    names = mix((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONGEST):
        word = body[starts[i] : ends[i]].tobytes()
        names[i] = int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8).digest(), "little")
    return names, np.searchsorted(starts, offsets), starts, ends


def window_names(body: np.ndarray, width: int, sums: np.ndarray | None = None) -> np.ndarray:
    """The name of every window of ``width`` bytes of one text."""
    if len(body) < width:
        return np.empty(0, U64)
    sums = prefix_sums(body) if sums is None else sums
    _, down = powers(len(body) + 1)
    n = len(body) - width + 1
    return mix((sums[width : width + n] - sums[:n]) * down[:n])


def shingle_names(names: np.ndarray, k: int) -> np.ndarray:
    """The name of every run of k consecutive words."""
    n = len(names) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = (out ^ (names[j : j + n] + U64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))) * U64(0xBF58476D1CE4E5B9)
        out ^= out >> U64(31)
    return out
