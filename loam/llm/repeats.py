"""Spark plan shared by the two substring operators: find every window of a
fixed length that repeats in the corpus.

1. Every text is reduced to its anchors (see ``anchors``): one narrow row per
   anchor, equal ones merged inside a task first, so a passage that a third of
   the documents share sends one row per task and not one per document.
2. Rows meet by gram hash. Anchors with equal contexts are copies of each other
   as a whole. Only contexts that share a gram hash but differ are left open.
3. The open contexts (one per class) are cut from the texts, once.
4. A gram group too large for a shard (a phrase that many documents hold with
   different neighbours) is split: each of its contexts goes on in two parts,
   the windows that reach far to the right of the gram and those that reach far
   to the left, under the hash of the gram with that neighbourhood. The parts
   are cut from the contexts, not from the texts, and judged as in 2, until
   every group fits.
5. The contexts are dealt by key to shards, where the operator's index decides
   window by window.
6. The repeated windows of each document are gathered and applied to its text.

Rows are known by (id, text hash), so repeated ids or rows don't mix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.anchors import anchors, window_hashes
from loam.llm.common import cut_lineage, mix64, slices

#: loc = first window start << 16 | (last - first)
SHIFT = 16
#: Units that a shard's index holds before it is closed (whole groups; a group
#: of more units is split by longer keys, so no index holds twice this).
SHARD_UNITS = 1_500_000

_FACTORS = mix64(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def byte_units(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8)


def word_units(raw: bytes) -> np.ndarray:
    """One 64-bit hash per word (runs of bytes that are no white space)."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    gap = _SPACE[data]
    inside = ~gap
    start = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(inside)
    bounds = np.concatenate([[0], np.cumsum(inside)])[start]
    length = np.diff(np.concatenate([bounds, [len(at)]]))
    place = np.arange(len(at)) - np.repeat(bounds, length)
    # a random odd factor per place in the word, summed, mixed once
    factor = _FACTORS[np.minimum(place, len(_FACTORS) - 1)]
    far = np.flatnonzero(place >= len(_FACTORS))
    if len(far):
        factor[far] = mix64(place[far].astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    each = factor * (data[at].astype(np.uint64) + np.uint64(1))
    return mix64(np.add.reduceat(each, bounds) + length.astype(np.uint64))


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id, th (text hash), raw (UTF-8 bytes, null: empty) and the kept columns."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), raw.alias("_raw"), *[F.col(c) for c in keep]
    )


def sample(rows: DataFrame, units: Callable, span: int, gram: int, first_stays: bool) -> DataFrame:
    """h, c, _id, _th, loc, n: one row per anchor. Of equal contexts in a slice
    the first carries the count n (first_stays: 1); the others are known to be
    repeats: n = 0, under a key of their own, so that they never crowd."""

    def run(batches):
        for big in batches:
            for b in slices(big, "_raw", 8 << 20):
                ids = pc.fill_null(b.column(0), -(2**63)).to_numpy(zero_copy_only=False)
                parts = []
                for r, raw in enumerate(b.column(2).to_pylist()):
                    h, c, first, last = anchors(units(raw), span, gram)
                    if len(h):
                        parts.append((h, c, np.full(len(h), r), (first << SHIFT) | (last - first)))
                if not parts:
                    continue
                h, c, r, loc = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((loc, ids[r], c, h))
                h, c, r, loc = h[order], c[order], r[order], loc[order]
                head = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                at = np.flatnonzero(head)
                n = np.zeros(len(h), dtype=np.int64)
                if first_stays:
                    lead = np.repeat(at, np.diff(np.concatenate([at, [len(h)]])))
                    n[(ids[r] == ids[r][lead]) & (loc == loc[lead])] = 1
                else:
                    n[at] = np.diff(np.concatenate([at, [len(h)]]))
                alone = n == 0
                h[alone] = mix64(ids[r][alone].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + loc[alone].astype(np.uint64))
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(loc), pa.array(n.astype(np.int32))],
                    ["h", "c", "_id", "_th", "loc", "n"],
                )

    return rows.select("_id", "_th", "_raw").mapInArrow(run, "h long, c long, _id long, _th long, loc long, n int")


def compare(found: DataFrame, first_stays: bool) -> DataFrame:
    """The rows that repeat as a whole (dup) or that an index has to judge
    (open; alone: no copy as a whole)."""
    group, cls = Window.partitionBy("h"), Window.partitionBy("h", "c").orderBy("_id", "_th", "loc")
    whole = Window.partitionBy("h", "c")
    x = found.withColumn("several", F.min("c").over(group) != F.max("c").over(group))
    x = x.withColumn("nth", F.row_number().over(cls))
    if first_stays:
        x = x.withColumn("dup", (F.col("n") == 0) | (F.rank().over(Window.partitionBy("h", "c").orderBy("_id", "loc")) > 1))
    else:
        x = x.withColumn("dup", (F.col("n") == 0) | (F.sum("n").over(whole) > 1))
    x = x.withColumn("alone", ~F.col("dup")).withColumn("open", F.col("several") & (F.col("nth") == 1) & (F.col("n") > 0))
    return x.where(F.col("dup") | F.col("open")).drop("several", "nth")


def classify(found: DataFrame, first_stays: bool) -> DataFrame:
    """Per document (_id, _th): marks (locs whose windows all repeat) and open
    (h, loc, alone: windows that an index has to judge)."""
    return (
        compare(found, first_stays)
        .groupBy("_id", "_th")
        .agg(
            F.collect_list(F.when(F.col("dup"), F.col("loc"))).alias("marks"),
            F.collect_list(F.when(F.col("open"), F.struct("h", "loc", "alone"))).alias("open"),
        )
    )


def _join(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    o = other.withColumnRenamed("_id", "_id2").withColumnRenamed("_th", "_th2")
    return rows.join(o, rows["_id"].eqNullSafe(o["_id2"]) & (rows["_th"] == o["_th2"]), how).drop("_id2", "_th2")


def ship(rows: DataFrame, known: DataFrame, units: Callable, span: int) -> DataFrame:
    """h, _id, _th, loc, alone, ctx (packed units) of every open context."""
    todo = _join(rows.select("_id", "_th", "_raw"), known.where(F.size("open") > 0).select("_id", "_th", "open"), "inner")
    names = ["h", "_id", "_th", "loc", "alone", "ctx"]

    def run(batches):
        for big in batches:
            for b in slices(big, "_raw", 8 << 20):
                out, row = [], []
                for r, (raw, marks) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                    u = units(raw)
                    for m in marks:
                        first = m["loc"] >> SHIFT
                        last = first + (m["loc"] & ((1 << SHIFT) - 1))
                        out.append((m["h"], m["loc"], m["alone"], u[first:last + span].tobytes()))
                        row.append(r)
                if not out:
                    continue
                h, loc, alone, ctx = zip(*out)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(loc, pa.int64()), pa.array(alone, pa.bool_()), pa.array(ctx, pa.binary())], names
                )

    return todo.select("_id", "_th", "_raw", "open").mapInArrow(run, "h long, _id long, _th long, loc long, alone boolean, ctx binary")


def judge(shipped: DataFrame, resolver: Callable, dtype, span: int) -> DataFrame:
    """_id, _th, loc of repeated windows. Each shard takes whole gram groups in
    order of (h, _id, _th, loc) and asks resolver(list of contexts, list of
    alone) for one flag per window that the contexts own, in that order."""

    def solve(held):
        ids, ths, locs, alone, ctx = zip(*held)
        seqs = [np.frombuffer(c, dtype=dtype) for c in ctx]
        flags = resolver(seqs, np.array(alone), span)
        owned = np.array([len(s) - span + 1 for s in seqs])
        ctx_of = np.repeat(np.arange(len(seqs)), owned)
        begin = np.cumsum(owned) - owned
        first = np.array(locs, dtype=np.int64) >> SHIFT
        at = np.flatnonzero(flags)
        if not len(at):
            return None
        # runs of flagged windows inside one context
        start = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (ctx_of[at[1:]] != ctx_of[at[:-1]])])
        lo = at[start]
        hi = at[np.concatenate([np.flatnonzero(start)[1:] - 1, [len(at) - 1]])]
        c = ctx_of[lo]
        loc = ((first[c] + lo - begin[c]) << SHIFT) | (hi - lo)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in c], pa.int64()), pa.array([ths[i] for i in c], pa.int64()), pa.array(loc)], ["_id", "_th", "loc"]
        )

    limit = SHARD_UNITS

    def run(batches):
        held, size, group, last = [], 0, None, None
        width = np.dtype(dtype).itemsize
        for b in batches:
            for h, i, t, loc, alone, ctx in zip(*[c.to_pylist() for c in b.columns]):
                if (h, i, t, loc) == last:  # a repeated row is one document
                    continue
                last = (h, i, t, loc)
                if h != group and size >= limit:
                    got = solve(held)
                    if got is not None:
                        yield got
                    held, size = [], 0
                group = h
                held.append((i, t, loc, alone, ctx))
                size += len(ctx) // width
        if held:
            got = solve(held)
            if got is not None:
                yield got

    # h first keeps groups whole; then the order of the corpus
    dealt = shipped.repartition("h").sortWithinPartitions("h", "_id", "_th", "loc")
    return dealt.mapInArrow(run, "_id long, _th long, loc long")


def crowds(opened: DataFrame, span: int) -> DataFrame:
    """h of the gram groups whose open contexts exceed a shard: fewer than one
    in SHARD_UNITS units."""
    own = F.col("loc").bitwiseAND(F.lit((1 << SHIFT) - 1)) + span
    return opened.groupBy("h").agg(F.sum(own).alias("units")).where(F.col("units") > SHARD_UNITS).select("h")


def _sides(ctx: np.ndarray, lr: int, span: int, gram: int):
    """An open context in two, by what its windows hold beside the known units
    (``l`` left and ``r`` right of the gram): (h, c, lo, hi, l, r), where the
    windows of a part start at lo..hi in ctx.

    A window has ``rem`` units more than the known ones, so at least half of
    these lie on one side; equal windows have the gram at the same place and so
    go to the same side, with the same longer key."""
    more = len(ctx) - span
    left, right = lr >> SHIFT, lr & ((1 << SHIFT) - 1)
    # the anchor of its first window is the anchor of all its windows
    grams = window_hashes(ctx[:span], gram)
    a = int(np.argmin((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)))
    rem = span - gram - left - right
    to_right = (rem + 1) // 2
    to_left = rem - to_right + 1
    for l, r, lo, hi in (
        (left, right + to_right, max(0, a - (span - gram - right - to_right)), more),
        (left + to_left, right, 0, min(more, a - left - to_left)),
    ):
        if lo <= hi:
            key, whole = (hashlib.blake2b(digest_size=8) for _ in range(2))
            key.update(f"{l} {r} ".encode() + ctx[a - l:a + gram + r].tobytes())
            whole.update(f"{a - lo} ".encode() + ctx[lo:hi + span].tobytes())
            h, c = (int.from_bytes(x.digest(), "little", signed=True) for x in (key, whole))
            yield h, c, lo, hi, l, r


def rekey(deep: DataFrame, dtype, span: int, gram: int) -> DataFrame:
    """As sample, for the two sides of every context of ``deep``, each with its
    own part of the context."""

    def run(batches):
        for big in batches:
            for b in slices(big, "ctx"):
                out, row = [], []
                for i, (loc, lr, alone, ctx) in enumerate(zip(*[c.to_pylist() for c in b.columns[2:]])):
                    u = np.frombuffer(ctx, dtype=dtype)
                    for h, c, lo, hi, l, r in _sides(u, lr, span, gram):
                        # what is known to repeat counts twice
                        out.append((h, c, (((loc >> SHIFT) + lo) << SHIFT) | (hi - lo), 1 if alone else 2, (l << SHIFT) | r, u[lo:hi + span].tobytes()))
                        row.append(i)
                if out:
                    h, c, loc, n, lr, ctx = zip(*out)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h, pa.int64()), pa.array(c, pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(loc, pa.int64()), pa.array(n, pa.int32()), pa.array(lr, pa.int64()), pa.array(ctx, pa.binary())],
                        ["h", "c", "_id", "_th", "loc", "n", "lr", "ctx"])

    return deep.select("_id", "_th", "loc", "lr", "alone", "ctx").mapInArrow(run, "h long, c long, _id long, _th long, loc long, n int, lr long, ctx binary")


def settle(shipped: DataFrame, dtype, span: int, gram: int, first_stays: bool) -> tuple[DataFrame, DataFrame | None]:
    """The shipped contexts with every gram group too large for a shard split by
    longer keys until its parts fit, and _id, _th, loc of the parts that repeat
    as a whole (None: nothing was split). A group of one content has nothing
    open, and each round halves what a key leaves unknown, so the rounds are
    few. A round reads the contexts of the large groups alone, no text."""
    opened, fit, marks = shipped.withColumn("lr", F.lit(0).cast("long")), None, None
    while True:
        large = cut_lineage(crowds(opened, span))
        if not large.limit(1).count():
            return (opened if fit is None else fit.unionByName(opened.select(fit.columns))), marks
        big = large.select(F.col("h").alias("big"))
        kept, deep = (opened.join(big, F.col("h") == F.col("big"), how) for how in ("left_anti", "left_semi"))
        fit = kept if fit is None else fit.unionByName(kept.select(fit.columns))
        split = compare(rekey(deep, dtype, span, gram), first_stays)
        split = cut_lineage(split.select("h", "_id", "_th", "loc", "alone", F.when(F.col("open"), F.col("ctx")).alias("ctx"), "lr", "dup", "open"))
        whole = split.where("dup").select("_id", "_th", "loc")
        marks = whole if marks is None else marks.unionByName(whole)
        opened = split.where("open").drop("dup", "open")


def repeated(docs: DataFrame, units: Callable, dtype, resolver: Callable, span: int, gram: int, first_stays: bool, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """_id, _raw, the kept columns and marks: array<long> of every row of docs."""
    rows = keyed(docs, id_col, text_col, keep)
    known = cut_lineage(classify(sample(rows, units, span, gram, first_stays), first_stays))
    fit, split = settle(cut_lineage(ship(rows, known, units, span)), dtype, span, gram, first_stays)
    judged = judge(fit.select("h", "_id", "_th", "loc", "alone", "ctx"), resolver, dtype, span)
    if split is not None:
        judged = judged.unionByName(split)
    marks = (
        known.where(F.size("marks") > 0).select("_id", "_th", "marks")
        .unionByName(judged.groupBy("_id", "_th").agg(F.collect_list("loc").alias("marks")))
        .groupBy("_id", "_th").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    )
    return _join(rows, marks, "left")


def cover(n: int, marks: list[int] | None, span: int) -> np.ndarray | None:
    """Mask of the n units that the marked windows cover; None if there is none."""
    if not marks:
        return None
    m = np.array(marks, dtype=np.int64)
    first = m >> SHIFT
    end = first + (m & ((1 << SHIFT) - 1)) + span
    step = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0
