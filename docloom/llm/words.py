"""Words and word shingles of whole texts, hashed by numpy without a Python step for each word."""

from __future__ import annotations

import numpy as np

from docloom.llm.common import SPACE, mix64

_MULTIPLIER = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTE, _OTHER_BYTE = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(x)) for x in (77, 1077))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)], dtype=np.uint64) for x in (_MULTIPLIER, _INVERSE)]
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray, of_byte: np.ndarray = _BYTE) -> np.ndarray:
    """Running sums of byte values times powers; see span_hash()."""
    up, _ = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(of_byte[data] * up[: len(data)], dtype=np.uint64)])


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to its stop; they depend on these bytes only."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and document of each word: what stands between white space, in documents' order."""
    space = _IS_SPACE[data]
    after_gap = np.empty(len(data), bool)
    after_gap[:1] = True
    after_gap[1:] = space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    after_gap[inner] = True
    start = np.flatnonzero(after_gap & ~space)
    before_gap = np.empty(len(data), bool)
    before_gap[-1:] = True
    before_gap[:-1] = space[1:]
    before_gap[inner - 1] = True
    stop = np.flatnonzero(before_gap & ~space) + 1
    return start, stop, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and two hashes of 64 bits of each run of ``width`` words, in order; a shorter text with words is one run.
    The hashes have no step in common, so together they have 128 bits."""
    start, stop, doc = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(start)
    ends_inside = np.zeros(n, bool)
    ends_inside[: max(0, n - width + 1)] = doc[width - 1 :] == doc[: max(0, n - width + 1)] if n >= width else False
    first = np.r_[True, doc[1:] != doc[:-1]]
    at = np.flatnonzero(ends_inside | first & ~ends_inside)
    out = []
    for of_byte, factor in ((_BYTE, np.uint64(0xD6E8FEB86659FD93)), (_OTHER_BYTE, np.uint64(0xA0761D6478BD642F))):
        words = span_hash(prefix_hash(data, of_byte), start, stop)
        total = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                there = np.minimum(at + j, n - 1)
                same = (at + j < n) & (doc[there] == doc[at])
                total = total * factor + np.where(same, words[there], np.uint64(j + 1))
                total ^= total >> np.uint64(29)
        out.append(mix64(total))
    return doc[at], *out
