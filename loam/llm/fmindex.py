"""Substring deduplication over words with a compressed FM-index per shard.

Every word covered by a window of ``SPAN`` words that occurs anywhere else in
the corpus (same document included) goes; the first occurrence goes too.

The corpus is reduced to synchronising samples (``anchors``); contexts that
equal another one as a whole repeat without further search. The contexts left
open, and one of each class that they may share windows with, are dealt to
shards by the gram hash of their anchor, so that equal windows always meet in
one shard and no document needs to be streamed through every index. A shard
builds an FM-index of its contexts (suffix array, Burrows-Wheeler transform,
wavelet matrix of packed bits with block counts) and streams the open contexts
through it: backward search from a window's end, all contexts in step. Where
the interval falls to one occurrence, no window over that stretch repeats and
the search skips behind it; windows whose interval still holds two or more are
reported.

Defined cases: null text has no words; documents of fewer than SPAN words keep
all; matches never cross documents; a row that stands twice in the table
repeats itself, so its windows go; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm import repeats
from loam.llm.common import sha256_hex, slices
from loam.llm.suffix import join_contexts, suffix_array

SPAN = 35
GRAM = 9


class Bits:
    """A packed bit row with counts per 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = int(n - bits.sum())

    def ones_before(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Backward search over a sequence of small ints (0 = separator)."""

    def __init__(self, flat: np.ndarray, depth: int):
        sa = suffix_array(flat + 1, depth)
        bwt = flat[sa - 1]  # the sequence ends in a separator, so place 0 follows one
        self.sigma = int(flat.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=self.sigma))])
        self.levels: list[tuple[int, Bits]] = []
        row = bwt
        for shift in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (row >> shift) & 1
            self.levels.append((shift, Bits(bit.astype(np.uint8))))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.origin = self._down(np.arange(self.sigma), np.zeros(self.sigma, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.ones_before(i)
            i = np.where((c >> shift) & 1 == 1, bits.zeros + ones, i - ones)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of c + pattern from those of the pattern."""
        start = self.first[c] - self.origin[c]
        return start + self._down(c, lo), start + self._down(c, hi)

    def start(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[c].copy(), self.first[c + 1].copy()


def other_copies(seqs: list[np.ndarray], alone: np.ndarray, span: int) -> np.ndarray:
    """Per owned window of the contexts: does it occur twice or more among
    them? (Contexts that are not alone repeat as a whole anyway.)"""
    names, codes = np.unique(np.concatenate(seqs), return_inverse=True)
    lens = np.array([len(x) for x in seqs])
    cuts = np.cumsum(lens)[:-1]
    flat, windows = join_contexts(np.split(codes, cuts), span)
    index = FMIndex(flat, span + 1)
    begin = np.cumsum(lens + 1) - (lens + 1)
    found = np.zeros(len(flat), dtype=bool)
    # one search per open context: end of its window, place reached, interval
    who = np.flatnonzero(alone)
    end = begin[who] + span - 1
    stop = begin[who] + lens[who]
    at = end.copy()
    lo, hi = index.start(flat[at])
    while len(who):
        fails = hi - lo < 2
        done = ~fails & (at == end - span + 1)
        found[at[done]] = True
        # behind a stretch that stands once; one further after a repeated window
        move = fails | done
        end = np.where(fails, at + span, np.where(done, end + 1, end))
        live = end < stop
        who, end, stop, at, lo, hi, move = (x[live] for x in (who, end, stop, at, lo, hi, move))
        if not len(who):
            break
        at = np.where(move, end, at - 1)
        c = flat[at]
        go = ~move
        lo[go], hi[go] = index.step(c[go], lo[go], hi[go])
        lo[move], hi[move] = index.start(c[move])
    return found[windows]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """_id, _raw and marks (repeated windows, in words) of every row."""
    return repeats.repeated(docs, repeats.word_units, np.uint64, other_copies, span, gram, False, id_col, text_col, []).select("_id", "_raw", "marks")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``id_col``, n_words, n_removed, kept_sha256 of every document."""

    def run(batches):
        for big in batches:
            for b in slices(big, "_raw"):
                n, cut, sha = [], [], []
                for raw, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    words = raw.split()  # of bytes: at white space 0x20, 0x09-0x0D
                    gone = repeats.cover(len(words), marks, span)
                    n.append(len(words))
                    cut.append(0 if gone is None else int(gone.sum()))
                    sha.append(sha256_hex(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    return find(docs, id_col, text_col, span).mapInArrow(run, f"{id_col} long, n_words long, n_removed long, kept_sha256 string")
