"""Synchronising samples for finding repeated windows of a fixed length.

A text is a sequence of units (bytes, or word hashes). Every window of ``span``
consecutive units is owned by one sampled position, its anchor: the leftmost
smallest hash of a ``gram`` of units that starts within the window's first
span - gram + 1 places. The choice depends on the window's content alone, so
equal windows have anchors at equal offsets with equal gram hashes: they can be
compared per gram hash instead of all with all. (This is the property that a
difference cover gives by position; sampling by content also makes it stable
under shifts and needs far fewer samples.)

The windows that one anchor owns start at consecutive places first..last; the
hash of its context (units first..last + span - 1, and where the anchor lies)
names them all at once.
"""

from __future__ import annotations

import numpy as np

from loam.llm.common import mix64, pair64


def window_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` units, by doubling."""
    h = mix64(units.astype(np.uint64) + np.uint64(0x1234567))
    have = 1
    while have * 2 <= size:
        h = pair64(h[:-have], h[have:])
        have *= 2
    if have < size:  # two overlapping halves
        h = pair64(h[: len(h) - (size - have)], h[size - have:])
    return h


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    if have < width:
        keys = np.minimum(keys[: len(keys) - (width - have)], keys[width - have:])
    return keys


def anchors(units: np.ndarray, span: int, gram: int):
    """(gram hash, context hash, first, last) of the anchors of one sequence:
    the windows starting at first..last belong to the anchor."""
    n = len(units) - span + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    width = span - gram + 1
    grams = window_hashes(units, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | place
    at = (window_minimum(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    own = at[first]
    whole = window_hashes(units, span)
    context = pair64(pair64(whole[first], whole[last]), ((last - first) * 4096 + (own - first)).astype(np.uint64))
    return grams[own], context, first, last
