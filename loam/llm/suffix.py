"""Exact substring deduplication by suffix sorting.

Every byte covered by a ``SPAN``-byte string that also starts earlier in the
corpus (smaller id, or same document and earlier start) is found. The
difference-cover idea works on two levels:

* The corpus is reduced to synchronising samples (``anchors``): any two equal
  strings hold a sample at the same offset. Spark sorts and groups the samples
  by name; whole contexts that are equal need no further work.
* The contexts left open are suffix-sorted in shards by the difference-cover
  algorithm: sort the triples at two of three places, name them, recurse on the
  names until these are unique or span SPAN bytes, sort the remaining suffixes
  by one byte and a rank, merge, and compare the prefixes of neighbours.

A literal difference cover over all bytes would shuffle more than ten times the
corpus; the samples keep the result exact at a thirtieth of the rows.

Defined cases: null text counts as empty; matches never cross documents; a
repeated row (equal id and text) is one document, so neither row is earlier;
rows without id come first, as one document; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm import repeats
from loam.llm.common import hide, sha256_hex, show, slices

SPAN = 100
GRAM = 37


def _order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by several columns of non-negative ints, most significant first."""
    bits = [max(1, int(k.max()).bit_length()) if len(k) else 1 for k in keys]
    if sum(bits) <= 63:
        packed = keys[0].astype(np.int64)
        for k, n in zip(keys[1:], bits[1:]):
            packed = (packed << n) | k
        return np.argsort(packed, kind="stable")
    return np.lexsort(keys[::-1])


def _count_below(sorted_keys: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many rows of sorted_keys come before each row of keys."""
    both = [np.concatenate([a, b]) for a, b in zip(keys, sorted_keys)]
    order = _order(*both)  # stable: of equal rows, those of keys come first
    mine = order < len(keys[0])
    below = np.cumsum(~mine)
    out = np.empty(len(keys[0]), dtype=np.int64)
    out[order[mine]] = below[mine]
    return out


def suffix_array(s: np.ndarray, depth: int, covers: int = 1) -> np.ndarray:
    """Suffixes of s (ints >= 1) in the order of their first ``depth`` symbols;
    those that agree so far stay in any order, next to each other. ``covers``:
    how many original symbols one symbol of s stands for."""
    n = len(s)
    if n < 3 or covers >= depth:
        if covers >= depth:
            return np.argsort(s, kind="stable")
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    pad = np.concatenate([s, [0, 0, 0]])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one dummy, if needed, so that every remaining suffix has a rank behind it
    twos = np.arange(2, n, 3)
    pos = np.concatenate([ones, twos])
    cols = (pad[pos], pad[pos + 1], pad[pos + 2])
    order = _order(*cols)
    change = np.zeros(len(order), dtype=bool)
    for c in cols:
        v = c[order]
        change[1:] |= v[1:] != v[:-1]
    change[0] = True
    names = np.empty(len(order), dtype=np.int64)
    names[order] = np.cumsum(change)
    if names.max() < len(names):
        order = suffix_array(names, depth, covers * 3)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[pos[order]] = np.arange(1, len(order) + 1)
    sampled = pos[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[_order(pad[rest], rank[rest + 1])]
    a, b = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = _count_below([pad[a], rank[a + 1]], [pad[rest], rank[rest + 1]])
    before += _count_below([pad[b], pad[b + 1], rank[b + 2]], [pad[rest], pad[rest + 1], rank[rest + 2]])
    # suffixes that agree in depth symbols may be counted either way
    by = np.argsort(before, kind="stable")
    rest, before = rest[by], before[by]
    out = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(rest))
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[place] = rest
    out[free] = sampled
    return out


def join_contexts(seqs: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """All contexts end to end, a 0 after each, and the places of the owned windows."""
    lens = np.array([len(x) for x in seqs])
    begin = np.cumsum(lens + 1) - (lens + 1)
    flat = np.zeros(int((lens + 1).sum()), dtype=np.int64)
    inside = np.ones(len(flat), dtype=bool)
    inside[begin + lens] = False
    flat[inside] = np.concatenate(seqs).astype(np.int64) + 1
    owned = lens - span + 1
    windows = np.repeat(begin - (np.cumsum(owned) - owned), owned) + np.arange(int(owned.sum()))
    return flat, windows


def equal_prefixes(flat: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Whether the next ``span`` symbols at a and b agree."""
    alive = np.arange(len(a))
    for k in range(span):
        alive = alive[flat[a[alive] + k] == flat[b[alive] + k]]
        if not len(alive):
            break
    same = np.zeros(len(a), dtype=bool)
    same[alive] = True
    return same


def later_copies(seqs: list[np.ndarray], alone: np.ndarray, span: int) -> np.ndarray:
    """Per owned window: does an equal one come earlier (contexts are given in
    corpus order per group, so the place in the row of contexts is the order)?"""
    flat, windows = join_contexts(seqs, span)
    sa = suffix_array(flat + 1, span)
    is_window = np.zeros(len(flat), dtype=bool)
    is_window[windows] = True
    sa = sa[is_window[sa]]
    run = np.concatenate([[0], np.cumsum(~equal_prefixes(flat, sa[:-1], sa[1:], span))])
    earliest = np.minimum.reduceat(sa, np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])))
    late = np.zeros(len(flat), dtype=bool)
    late[sa] = sa != earliest[run]
    return late[windows]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """_id, _raw, the kept columns and marks (repeated windows) of every row."""
    return repeats.repeated(docs, repeats.byte_units, np.uint8, later_copies, span, gram, True, id_col, text_col, keep or [])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = find(docs, id_col, text_col, None, span).select("_id", "_raw", "marks")

    def run(batches):
        for big in batches:
            for b in slices(big, "_raw"):
                n, cut, spans, sha = [], [], [], []
                for raw, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    gone = repeats.cover(len(raw), marks, span)
                    n.append(len(raw))
                    if gone is None:
                        cut.append(0)
                        spans.append(0)
                        sha.append(sha256_hex(raw))
                    else:
                        cut.append(int(gone.sum()))
                        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                        sha.append(sha256_hex(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """docs with the repeated bytes cut from the text. A character goes if all
    of its bytes go, so what stays is valid text; a null text stays null."""
    plain, names = hide(docs)
    text = names[text_col]
    keep = list(names.values())
    found = find(plain, names[id_col], text, keep, span).select(*keep, "marks")
    at = keep.index(text)

    def run(batches):
        for big in batches:
            for b in slices(big, text):
                texts = b.column(at).to_pylist()
                for i, marks in enumerate(b.column(len(keep)).to_pylist()):
                    if marks:
                        raw = np.frombuffer(texts[i].encode(), dtype=np.uint8)
                        gone = repeats.cover(len(raw), marks, span)
                        head = np.flatnonzero((raw & 0xC0) != 0x80)
                        whole = np.logical_and.reduceat(gone, head)
                        gone = np.repeat(whole, np.diff(np.concatenate([head, [len(raw)]])))
                        texts[i] = raw[~gone].tobytes().decode()
                cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(keep)])]
                yield pa.RecordBatch.from_arrays(cols, keep)

    return show(found.mapInArrow(run, plain.schema), names)
