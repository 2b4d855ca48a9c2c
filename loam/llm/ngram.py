"""Near-duplicate join on word n-grams with count-vector trees.

A document is the set of its distinct word n-grams (words between white space,
A-Z lower-cased; a shorter text is one n-gram). Two documents link at a Jaccard
similarity of ``similarity`` percent or more; the result is exact.

* Documents with equal sets form one class; from there on a class is one point.
* Candidates: documents of neighbouring size bands split their n-grams by hash
  into more blocks than a linked pair can differ in n-grams, so at least one
  block of theirs is equal. Documents meet by (band, block, block hash).
  Blocks that are empty are left out as long as enough others remain by the
  same argument (``Bands``).
* Points: n-grams are hashed into ``GROUPS`` groups; the counts are a point.
  The summed minima of two points bound the overlap of the sets. In each bucket
  all members are first tried against one pivot. Buckets whose members still
  lie in different components are joined through R-trees over the points: a
  pair of nodes is followed only while the summed minima of their upper corners
  can reach the overlap that their sizes need.
* Pairs that survive the bound are verified on the n-gram sets; pairs whose
  documents are already connected need no test, so a group of copies costs as
  many tests as it has members, not their square.

Hot buckets (a group of copies with a third of all rows) send one row per task
to the shuffle: members of a bucket that meet inside a task are paired there.
Large buckets are split into parts that are joined part with part, hot pivots
are salted.

``report`` gives one row per document, ``links`` every pair of linked classes and
``degrees`` the number of linked documents of each, for a class times its size,
so copies are never paired up.

Defined cases: null texts and texts without words have an empty set and link
with nothing (they are their own component); repeated rows fall into one class
and keep a row each; rows with a null id keep their row and set size, but have
no component and link with nothing; rows with one id and different texts are one
node, which stands in each of their classes and is compared with others by the
smallest (as bytes) of its sets; very long texts are taken whole, as
one sorted array of hashes; an empty table gives no rows; extra columns pass
through ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import cut_lineage, mix64, pair64, slices
from loam.llm.components import components
from loam.llm.repeats import word_units

SIZE = 4
SIMILARITY = 85
GROUPS = 256
#: Ids that may be broadcast (16 bytes each); more are met by a shuffled join.
BROADCAST_IDS = 2_000_000
#: Members of a bucket that one tree join takes from either side.
PART = 1500
#: Buckets of a document that its pairs are compared by (see residual_pairs).
FIRST_KEYS = 8
#: Members of a pivot that one task verifies.
PIVOT_ROWS = 2000
#: Rows of an exact-copy class, on average at most, in one part of it.
CLASS_ROWS = 1_000_000
LEAF = 24
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text's bytes."""
    w = word_units(raw.translate(_LOWER))
    if not len(w):
        return w
    n = min(size, len(w))
    # a random odd factor per place, mixed once
    factors = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h += w[k:len(w) - n + 1 + k] * factors[k]
    return np.unique(mix64(h))


def needed(a, b, similarity: int):
    """The smallest overlap that links sets of sizes a and b."""
    return -(-similarity * (a + b) // (100 + similarity))


class Bands:
    """Size bands: a set of band j links only with sets of bands j-1 to j+1.
    Interval j covers pairs (j, j) and (j, j+1) and splits into blocks[j] blocks."""

    def __init__(self, similarity: int, largest: int):
        self.edges = [1]
        while self.edges[-1] <= largest:
            self.edges.append(self.edges[-1] * 100 // similarity + 1)
        self.differ, self.spare, self.blocks = [], [], []
        for j in range(len(self.edges) - 1):
            a = self.edges[j + 1] - 1
            d = (100 - similarity) * (a + a * 100 // similarity) // (100 + similarity)
            e = d // 8 + 2  # equal blocks beyond the one that must exist
            self.differ.append(d)
            self.spare.append(e)
            self.blocks.append(d + 1 + e)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1


def block_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The bucket keys of one set, for both intervals that its band is in."""
    home = bands.band(len(s))
    out = []
    mixed = mix64(s ^ np.uint64(0x5BD1E995))
    for j in (home, home - 1):
        if j < 0 or bands.differ[j] == 0:
            continue  # only equal sets link: one class already
        m = bands.blocks[j]
        block = (s % np.uint64(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        block = block[order]
        head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        content = np.add.reduceat(mixed[order], head)
        full = block[head]
        if m - len(full) > bands.spare[j]:  # too many empty blocks to leave out
            empty = np.setdiff1d(np.arange(m), full)
            full = np.concatenate([full, empty])
            content = np.concatenate([content, np.zeros(len(empty), dtype=np.uint64)])
        out.append(pair64(content, (full + (j << 40)).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    a, b = mix64(s).sum(), mix64(s ^ np.uint64(0xD6E8FEB86659FD93)).sum()
    return int(a.view(np.int64)), int(b.view(np.int64))


def set_rows(packed: DataFrame, size: int) -> DataFrame:
    """id, n, k1, k2: size and hash of every document's set."""

    def run(batches):
        for big in batches:
            for b in slices(big, "raw"):
                n, k = [], []
                for raw in b.column(1).to_pylist():
                    s = shingles(raw, size)
                    n.append(len(s))
                    k.append(_set_hash(s) if len(s) else (0, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([x for x, _ in k], pa.int64()), pa.array([y for _, y in k], pa.int64())], ["id", "n", "k1", "k2"])

    return packed.mapInArrow(run, "id long, n long, k1 long, k2 long")


def bucket_rows(packed: DataFrame, size: int, bands: Bands) -> DataFrame:
    """deal, id, pivot, key. Inside a slice equal sets send one row per key, and
    the members of one key after the first are paired with the first: pivot and
    key are set, and they are dealt by a hash of their own. The others are dealt
    by their key."""

    def run(batches):
        for big in batches:
            for b in slices(big, "raw"):
                ids = b.column(0).to_numpy()
                keys, owner, seen = [], [], set()
                for r, raw in enumerate(b.column(1).to_pylist()):
                    s = shingles(raw, size)
                    h = (_set_hash(s), len(s)) if len(s) else None
                    if h is None or h in seen:
                        continue
                    seen.add(h)
                    k = block_keys(s, bands)
                    keys.append(k)
                    owner.append(np.full(len(k), ids[r]))
                if not keys:
                    continue
                key, own = np.concatenate(keys), np.concatenate(owner)
                order = np.lexsort((own, key))
                key, own = key[order], own[order]
                head = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
                at = np.flatnonzero(head)
                lead = np.repeat(own[at], np.diff(np.concatenate([at, [len(key)]])))
                deal = np.where(head, key, pair64(key, own.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(deal.view(np.int64)), pa.array(own), pa.array(lead, mask=head), pa.array(key.view(np.int64), mask=head)], ["deal", "id", "pivot", "key"]
                )

    return packed.mapInArrow(run, "deal long, id long, pivot long, key long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """key, id, pivot of the rows whose key holds two rows or more; the pivot is
    the bucket's smallest id, or the smallest of the task that met first."""
    dealt = rows.repartition("deal").sortWithinPartitions("deal", "id")
    names = ["key", "id", "pivot"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out(table):
            deal, own = table.column(0).to_numpy(), table.column(1).to_numpy()
            pivot = table.column(2)
            paired = np.asarray(pivot.is_valid())
            key = np.where(paired, np.asarray(table.column(3).fill_null(0)), deal)
            lead = np.asarray(pivot.fill_null(0))
            head = np.concatenate([[True], (deal[1:] != deal[:-1]) | paired[1:] | paired[:-1]])
            at = np.flatnonzero(head)
            many = np.diff(np.concatenate([at, [len(key)]]))
            first, count = np.repeat(own[at], many), np.repeat(many, many)
            use = paired | (count > 1)
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(own[use]), pa.array(np.where(paired, lead, first)[use])], names)

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            # the last key may go on in the next batch
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                held.append(b.slice(0, cut))
                yield from out(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(b.slice(cut))
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "key long, id long, pivot long")


def points(packed: DataFrame, ids: DataFrame, size: int, kind: str) -> DataFrame:
    """id, n, vec (group counts of type kind), grams (sorted hashes) of the
    wanted ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = packed.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches):
        for big in batches:
            for b in slices(big, "raw", 2 << 20):
                n, vec, grams = [], [], []
                for raw in b.column(1).to_pylist():
                    s = shingles(raw, size)
                    n.append(len(s))
                    vec.append(np.bincount((mix64(s) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(kind).tobytes())
                    grams.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(vec, pa.binary()), pa.array(grams, pa.binary())], ["id", "n", "vec", "grams"])

    return wanted.mapInArrow(run, "id long, n long, vec binary, grams binary")


def bounded(pairs: DataFrame, known: DataFrame, similarity: int, kind: str) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima reach the overlap needed."""
    vec = known.select("id", "n", "vec")
    x = pairs.join(vec.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va")), "a")
    x = x.join(vec.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb")), "b").select("a", "b", "na", "nb", "va", "vb")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            va, vb = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=kind).reshape(-1, GROUPS) for i in (4, 5))
            on = np.minimum(va, vb).sum(axis=1) >= needed(na, nb, similarity)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(on)), b.column(1).filter(pa.array(on))], ["a", "b"])

    return x.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, known: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that link, by their n-gram sets. b's set travels to a's;
    a pivot with many partners is dealt to several tasks."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("salts"))
    sets = known.select("id", "grams")
    left = salts.join(sets.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "grams")
    right = pairs.join(salts, "a").join(sets.withColumnRenamed("id", "b"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "grams")

    def run(batches):
        mine, whole = None, None
        for big in batches:
            for b in slices(big, "grams"):
                la, lb = [], []
                for a, salt, other, grams in zip(*[c.to_pylist() for c in b.columns]):
                    s = np.frombuffer(grams, dtype=np.uint64)
                    if other is None:
                        mine, whole = (a, salt), s
                    elif mine == (a, salt):
                        at = np.searchsorted(whole, s)
                        at[at == len(whole)] = 0
                        if int((whole[at] == s).sum()) >= needed(len(whole), len(s), similarity):
                            la.append(a)
                            lb.append(other)
                yield pa.RecordBatch.from_arrays([pa.array(la, pa.int64()), pa.array(lb, pa.int64())], ["a", "b"])

    dealt = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


class Tree:
    """A packed R-tree over count points: points in tiles of the widest
    coordinates, LEAF to a leaf, one level of LEAF leaves above; each node keeps
    its upper corner and smallest size (all that the bound needs)."""

    def __init__(self, vec: np.ndarray, n: np.ndarray):
        parts = [np.arange(len(n))]
        axes = np.argsort(-vec.var(axis=0))[:3] if len(n) > LEAF else []
        for axis in axes:  # sort-tile: halve along the widest coordinates in turn
            parts = [h for p in parts for h in (np.array_split(p[np.argsort(vec[p, axis], kind="stable")], 2) if len(p) > LEAF else [p])]
        self.order = np.concatenate(parts)
        self.levels = [(vec[self.order], n[self.order])]
        while len(self.levels[-1][1]) > 1 and len(self.levels) < 4:
            v, m = self.levels[-1]
            cut = np.arange(0, len(m), LEAF)
            self.levels.append((np.maximum.reduceat(v, cut, axis=0), np.minimum.reduceat(m, cut)))


def tree_join(x: Tree, y: Tree, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of points whose bound reaches the overlap needed."""
    depth = min(len(x.levels), len(y.levels)) - 1
    a, b = (g.ravel() for g in np.meshgrid(np.arange(len(x.levels[depth][1])), np.arange(len(y.levels[depth][1])), indexing="ij"))
    for level in range(depth, -1, -1):
        (vx, nx), (vy, ny) = x.levels[level], y.levels[level]
        keep = []
        for lo in range(0, len(a), 20_000):
            i, j = a[lo:lo + 20_000], b[lo:lo + 20_000]
            keep.append(np.minimum(vx[i], vy[j]).sum(axis=1) >= needed(nx[i], ny[j], similarity))
        on = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        a, b = a[on], b[on]
        if level:
            lx, ly = len(x.levels[level - 1][1]), len(y.levels[level - 1][1])
            grid = np.arange(LEAF)
            a, b = np.broadcast_arrays(a[:, None, None] * LEAF + grid[:, None], b[:, None, None] * LEAF + grid[None, :])
            a, b = a.ravel(), b.ravel()
            real = (a < lx) & (b < ly)
            a, b = a[real], b[real]
    return x.order[a], y.order[b]


def residual_pairs(buckets: DataFrame, known: DataFrame, comp: DataFrame, similarity: int, kind: str) -> DataFrame:
    """Pairs from buckets whose members lie in different components, through
    tree joins of bucket parts; pairs inside a component are left out."""
    member = buckets.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (
        member.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2"))
        # (the two members of a bucket of two are a pivot pair: tested before)
        .where("lo <> hi and k > 2")
        # buckets with the same members need one join
        .groupBy("k", "x1", "x2")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("k") / PART).cast("int").alias("parts"))
    )
    member = cut_lineage(member.join(mixed, "key"))
    # a pair that shares several buckets is joined in the first of them only,
    # as far as the first FIRST_KEYS buckets of both documents tell
    first = member.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("first"))
    rows = member.join(known.select("id", "n", "vec"), "id").join(first, "id")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "component", "n", "vec", "first")

    def join(group, members):
        part, ids, comps, n, vec, first = zip(*members)
        firsts = np.full((len(first), FIRST_KEYS), group[0], dtype=np.int64)  # the bucket itself stands for "none"
        for i, f in enumerate(first):
            firsts[i, : len(f)] = f
        vec = np.frombuffer(b"".join(vec), dtype=kind).reshape(-1, GROUPS)
        n, ids, comps, part = (np.array(x, dtype=np.int64) for x in (n, ids, comps, part))
        left, right = np.flatnonzero(part == group[1]), np.flatnonzero(part == group[2])
        i, j = tree_join(Tree(vec[left], n[left]), Tree(vec[right], n[right]), similarity)
        i, j = left[i], right[j]
        on = (comps[i] != comps[j]) & ((ids[i] < ids[j]) | (group[1] != group[2]))
        i, j = i[on], j[on]
        done = np.zeros(len(i), dtype=bool)
        for x in range(FIRST_KEYS):
            a = firsts[i, x]
            for y in range(FIRST_KEYS):
                done |= (a == firsts[j, y]) & (a < group[0])
        i, j = i[~done], j[~done]
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def run(batches):
        group, members = None, []
        for b in batches:
            out = []
            for key, p, q, *member in zip(*[c.to_pylist() for c in b.columns]):
                if (key, p, q) != group:
                    if len(members) > 1:
                        out.append(join(group, members))
                    group, members = (key, p, q), []
                members.append(member)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])
        if len(members) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in join(group, members)], ["a", "b"])

    # one group is two parts of a bucket: about 2 * PART rows
    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, rep: set size and smallest id of the class of every row (empty
    sets: the id itself; no id: null)."""
    rows = cut_lineage(set_rows(_packed(docs, id_col, text_col), size))
    named = F.col("id").isNotNull() & (F.col("n") > 0)
    # a class may hold a third of all rows: its rows meet its representative in
    # parts, each of which has one row of the class table
    parts = max(64, rows.count() // CLASS_ROWS)
    keys = ["n", "k1", "k2"]
    dealt = rows.where(named).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    least = dealt.groupBy(*keys, "part").agg(F.min("id").alias("rep"))
    reps = least.select(*keys, "part").join(least.groupBy(*keys).agg(F.min("rep").alias("rep")), keys)
    known = dealt.join(reps, [*keys, "part"]).select("id", "n", "rep")
    return known.union(rows.where(~named).select("id", "n", F.when(F.col("n") == 0, F.col("id")).alias("rep")))


class _Join:
    """What the joins share: classes, buckets of class representatives, the
    pairs (bucket member, pivot) and the points of all that are in a bucket."""

    def __init__(self, docs: DataFrame, size: int, similarity: int, id_col: str, text_col: str):
        self.similarity = similarity
        packed = _packed(docs, id_col, text_col).where(F.col("id").isNotNull())
        self.known_as = cut_lineage(classes(docs, size, id_col, text_col))
        largest = self.known_as.agg(F.max("n")).first()[0] or 1
        rep = self.known_as.where("n > 0 and id is not null").select("id", "rep").distinct()
        buckets = shared_buckets(bucket_rows(packed, size, Bands(similarity, largest)))
        # ids become class representatives; equal rows of a class fall together
        pivots = rep.withColumnRenamed("id", "pivot").withColumnRenamed("rep", "pivot_rep")
        buckets = cut_lineage(
            buckets.join(rep, "id").join(pivots, "pivot").select("key", F.col("rep").alias("id"), F.col("pivot_rep").alias("pivot")).distinct()
        )
        self.star = cut_lineage(
            buckets.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        )
        wanted = self.star.select(F.col("a").alias("id")).union(self.star.select("b")).distinct()
        self.kind = "uint16" if largest < 2**16 else "uint32"  # a count is at most the size
        self.known = cut_lineage(
            points(packed, cut_lineage(wanted), size, self.kind).groupBy("id").agg(F.min(F.struct("grams", "n", "vec")).alias("p")).select("id", "p.n", "p.vec", "p.grams")
        )
        self.members = buckets.select("key", "id").union(buckets.select("key", "pivot")).distinct()

    def star_links(self) -> DataFrame:
        bound = cut_lineage(bounded(self.star, self.known, self.similarity, self.kind))
        return cut_lineage(verified(bound, self.known, self.similarity))

    def other_links(self, comp: DataFrame) -> DataFrame:
        """Linked pairs that no pivot is part of and that lie in different
        components."""
        rest = residual_pairs(self.members, self.known, comp, self.similarity, self.kind).join(self.star, ["a", "b"], "left_anti")
        return cut_lineage(verified(cut_lineage(rest), self.known, self.similarity))


def cluster(docs: DataFrame, size: int = SIZE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, component of every row."""
    join = _Join(docs, size, similarity, id_col, text_col)
    # first every document against the pivots of its buckets, then whatever
    # buckets are still in several components
    links = join.star_links()
    comp = cut_lineage(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    rest = join.other_links(comp)
    if not rest.isEmpty():
        links = links.unionByName(rest)
        comp = cut_lineage(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    return join.known_as.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))


def links(docs: DataFrame, size: int = SIZE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): a, b of every two linked classes, each named by its
    smallest id, a < b; and id, n, rep of every row. Documents of one class are
    linked with each other and with all documents of the classes it is paired
    with. Unlike ``cluster`` this tests pairs inside a component too: its work
    grows with the pairs of different texts that share a bucket."""
    join = _Join(docs, size, similarity, id_col, text_col)
    nothing = join.star.sparkSession.createDataFrame([], "node long, component long")
    pairs = join.star_links().select("a", "b").unionByName(join.other_links(nothing).select("a", "b"))
    return pairs, join.known_as


def degrees(docs: DataFrame, size: int = SIZE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, class_id, n_links of every row: the class it is in
    and the number of other documents that it links with."""
    pairs, member = links(docs, size, similarity, id_col, text_col)
    ids = member.where("n > 0 and id is not null").select("id", "rep").distinct()
    sizes = ids.groupBy("rep").agg(F.count("*").alias("size"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    far = both.join(sizes.withColumnsRenamed({"rep": "other", "size": "other_size"}), "other").groupBy("rep").agg(F.sum("other_size").alias("far"))
    counts = sizes.join(far, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return member.join(counts, "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def report(docs: DataFrame, size: int = SIZE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id of every document."""
    return cluster(docs, size, similarity, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their group, with all their
    columns; documents without words or without an id all stay."""
    losers = cluster(docs, size, similarity, id_col, text_col).where("id <> component").select(F.col("id").alias("_loser")).distinct()
    return docs.join(losers, docs[id_col] == losers["_loser"], "left_anti").select(*docs.columns)
