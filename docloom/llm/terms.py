"""Terms of whole texts: runs of ASCII letters and of characters beyond ASCII, found by numpy and told apart by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from docloom.llm.common import text_buffers

#: Bytes of a term; every byte of a character beyond ASCII is one.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts -> the distinct terms, and for each that stands in a text, in order, its place among them and its text's.

    Of the letters only A to Z are lower-cased. Terms never cross texts; null counts as empty. Terms are compared as such,
    not by a hash.
    """
    return spanned_terms(column)[:3]


def spanned_terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms(), and the bytes of its text at which each starts and ends."""
    data, offsets = text_buffers(column)
    inside = _IN_TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    # the bytes of all terms follow one another, so a term ends where the next one starts
    at = np.r_[np.cumsum(inside, dtype=np.int64)[start] - 1, np.count_nonzero(inside)] if len(start) else np.zeros(1, np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    doc = np.searchsorted(offsets, start, "right") - 1
    start = start - offsets[doc]
    return found.dictionary, found.indices.to_numpy(), doc, start, start + np.diff(at)
