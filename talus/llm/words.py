"""Words and shingles as numpy arrays: no Python object per word.

A word is a maximal run of a-z and 0-9 in the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20260117))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
ALNUM, LETTERS = np.zeros(256, bool), np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123)]] = True
LETTERS[[*range(97, 123), *range(128, 256)]] = True
#: Bytes of text handled at once; arrays of eight bytes per text byte stay small.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased UTF-8 of the texts in blocks of about BLOCK bytes, with the index of each block's first text. None and non-strings are empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")
        size += len(held[-1])
        if size >= BLOCK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def word_hashes(encoded: list[bytes], alphabet: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (maximal runs of the alphabet's bytes) in order, and the index of each word's text."""
    buf = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    at = np.cumsum([0, *[len(e) + 1 for e in encoded]])
    mask = alphabet[buf]
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(mask)
    length = ends - starts
    offset = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(length.max()), _P))])
    firsts = np.cumsum(length) - length
    h = mix(np.add.reduceat(_BYTE[buf[inside]] * power[offset], firsts) + length.astype(np.uint64))
    return h, np.searchsorted(at, starts, side="right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k consecutive words of one text, and their texts' indices."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = s * _P + h[i : i + n]
    whole = doc[:n] == doc[k - 1 :]
    return mix(s[whole]), doc[:n][whole]
