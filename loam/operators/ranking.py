"""Exact global ranks and quantiles without a single-partition window.

A global ``row_number() OVER (ORDER BY ...)`` puts every row in one task.

* Ranks (:func:`key_rank`, :func:`hash_rank`): one range exchange on the typed
  order columns themselves, so any sortable type is ordered exactly; equal
  order values are split on the tie columns and then on a row hash, so a hot
  value spreads over tasks. Each sorted partition is written once with its row
  positions, and rows per partition give the offsets.
* Quantiles (:func:`quantile_table`): doubles become integers of the same
  order, and the wanted ranks are found by counting 12 more bits of them in
  each pass, for all groups at once. No value is ever sorted.
* Cuts of a seeded hash order (:func:`cut_positions`) move no row at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.session import cut_lineage

# Above this many partitions the offsets travel as a broadcast table instead
# of a literal array inside the plan.
MAX_LITERAL_OFFSETS = 256


def hash_key(seed: int | str, key_cols: list[str]) -> Column:
    """``md5('<seed>:<k1>[:<k2>...]')``: a seeded, uniform, reproducible order."""
    # a null key is a value of its own (concat_ws alone would skip it)
    parts = [F.lit(str(seed))] + [
        F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in key_cols
    ]
    return F.md5(F.concat_ws(":", *parts))


#: A hash bucket is read row by row once it holds at most this many keys.
CUT_ROWS = 4096


def cut_positions(
    df: DataFrame, key_cols: list[str], seed: int | str, ranks_of
) -> tuple[int, list[tuple]]:
    """The keys that stand at given ranks of the seeded hash order, without
    ranking (or moving) any row.

    Rows are counted per hash prefix; only the prefixes that hold a wanted
    rank are counted finer, until they hold at most ``CUT_ROWS`` keys. The
    driver receives 256 counts, then at most 4096 per cut and level.
    ``ranks_of(n)`` gives the wanted 0-based ranks for ``n`` rows. Returns n
    and one (hash, *key) tuple per rank below n. Rows with equal keys cannot
    be told apart: a cut inside such a group moves to its start, so they all
    get the same label.
    """
    base = df.select(hash_key(seed, key_cols).alias("__h"), *[F.col(f"`{k}`") for k in key_cols])

    def count(frame, p):
        rows = frame.groupBy(F.substring("__h", 1, p).alias("p")).count().collect()
        return {r["p"]: r["count"] for r in rows}

    p = 2
    counts = count(base, p)
    n = sum(counts.values())
    wanted = [r for r in ranks_of(n) if r < n]
    if not wanted:
        return n, []

    def locate(counts, ranks):
        """prefix -> (ranks that fall into it, counted from its start)."""
        out: dict[str, list] = {}
        start, todo = 0, sorted(ranks, key=lambda x: x[0])
        for k in sorted(counts):
            while todo and todo[0][0] < start + counts[k]:
                local, which = todo.pop(0)
                out.setdefault(k, []).append((local - start, which))
            start += counts[k]
        return out

    held = locate(counts, [(r, i) for i, r in enumerate(wanted)])
    while p < 32 and max(counts[k] for k in held) > CUT_ROWS:
        finer_p = min(32, p + 3)
        finer = count(base.filter(F.substring("__h", 1, p).isin(list(held))), finer_p)
        nxt: dict[str, list] = {}
        for k, ranks in held.items():
            inside = {q: c for q, c in finer.items() if q[:p] == k}
            nxt.update(locate(inside, ranks))
        held, counts, p = nxt, finer, finer_p
    groups: dict[str, list] = {}
    rows = (
        base.filter(F.substring("__h", 1, p).isin(list(held)))
        .groupBy("__h", *[F.col(f"`{k}`") for k in key_cols]).count().collect()
    )
    for r in rows:
        groups.setdefault(r[0][:p], []).append(tuple(r))
    cuts: list[tuple] = [()] * len(wanted)
    order = lambda t: (t[0], *[(v is not None, v) for v in t[1:-1]])
    for k, ranks in held.items():
        at, todo = 0, sorted(ranks)
        for t in sorted(groups[k], key=order):
            while todo and todo[0][0] < at + t[-1]:
                cuts[todo.pop(0)[1]] = t[:-1]
            at += t[-1]
    return n, cuts


def before_cut(key_cols: list[str], seed: int | str, cut: tuple, df: DataFrame) -> Column:
    """Whether a row sorts before a cut key in the seeded hash order."""
    h = hash_key(seed, key_cols)
    lits = [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(key_cols, cut[1:])]
    own = F.struct(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(key_cols)])
    its = F.struct(*[v.alias(f"c{i}") for i, v in enumerate(lits)])
    return (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & (own < its))


def _hashable(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return False
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    return True


def ordered_parts(df: DataFrame, order_cols: list[str], partitions: int | None = None) -> DataFrame:
    """The rows in ascending order (nulls first) over range partitions, with
    ``__part`` and the position ``__pos`` inside it.

    Rows of equal order columns are dealt on by a hash of the row, and equal
    rows by a number that each input partition gives out in hash order, so it
    is the same when a task runs again: no value is bound to one task.
    """
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    tagged = df.withColumn("__h", F.xxhash64(*hashable)).sortWithinPartitions("__h").withColumn("__salt", F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order_cols] + [F.col("__h").asc(), F.col("__salt").asc()]
    ranged = tagged.repartitionByRange(partitions, *keys) if partitions else tagged.repartitionByRange(*keys)
    # the low 33 bits of the number count the rows of a partition
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.sortWithinPartitions(*keys).select(*df.columns, F.spark_partition_id().alias("__part"), pos.alias("__pos"))


def _ranked(df: DataFrame, order_cols: list[str], rank_col: str, rows_per_task: int | None) -> tuple[DataFrame, int]:
    parts = None
    if rows_per_task:
        parts = max(1, -(-df.count() // rows_per_task))
    # neutral names inside, which no column clashes with
    names = {c: f"_k{i}" for i, c in enumerate(df.columns)}
    hidden = df.select(*[df[f"`{c}`"].alias(k) for c, k in names.items()])
    # written once: positions and counts come from the same table
    table = cut_lineage(ordered_parts(hidden, [names[c] for c in order_cols], parts))
    own = [F.col(k).alias(c) for c, k in names.items()]
    rows = {r[0]: r[1] for r in table.groupBy("__part").count().collect()}
    offsets, n = [], 0
    for p in range(max(rows, default=-1) + 1):
        offsets.append(n)
        n += rows.get(p, 0)
    if len(offsets) <= MAX_LITERAL_OFFSETS:
        start = F.get(F.array(*[F.lit(o).cast("long") for o in offsets] or [F.lit(0).cast("long")]), F.col("__part"))
        return table.select(*own, (start + F.col("__pos")).alias(rank_col)), n
    # size bound: one row per partition of the exchange
    off = df.sparkSession.createDataFrame(list(enumerate(offsets)), "__part int, __offset long")
    return table.join(F.broadcast(off), "__part").select(*own, (F.col("__offset") + F.col("__pos")).alias(rank_col)), n


def key_rank(
    df: DataFrame,
    order_col: str,
    tie_cols: list[str] | None = None,
    rank_col: str = "row_index",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """0-based position in ``(order_col, *tie_cols)`` order: the row index
    after drops (P8). Nulls come first; rows that are equal in all of these
    follow in order of a row hash. ``rows_per_bucket`` sets the number of
    sorting tasks; by default it is ``spark.sql.shuffle.partitions``."""
    return _ranked(df, [order_col, *(tie_cols or [])], rank_col, rows_per_bucket)[0]


def hash_rank(
    df: DataFrame,
    key_cols: list[str],
    seed: int | str = 42,
    rank_col: str = "rank",
    rows_per_bucket: int | None = None,
) -> tuple[DataFrame, int]:
    """Rank rows by ``(md5(seed:key), key)``: a seeded random permutation
    that does not depend on partitioning. Returns (ranked frame, total rows).
    Keys should be unique; tied keys get arbitrary, but distinct, ranks."""
    ranked, n = _ranked(df.withColumn("__key", hash_key(seed, key_cols)), ["__key", *key_cols], rank_col, rows_per_bucket)
    return ranked.drop("__key"), n


#: Bits left after each pass over the 64-bit keys.
_SHIFTS = (52, 40, 28, 16, 4, 0)


def order_bits(x: Column) -> Column:
    """A long that orders doubles as they are (no NaN; zero has one sign)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def quantile_table(df: DataFrame, col: str, probs: list[float], group_cols: list[str] | None = None) -> DataFrame:
    """groups, n, min, max and q (array, one value per probability) of the
    values of each group that are neither null nor NaN, with linear
    interpolation between neighbours (the NumPy default).

    Every pass counts rows per group and next 12 bits, below the bits that
    hold a wanted rank: at most 4096 counts per rank, combined in the map
    tasks, whatever the rows and however hot a value. A cell of one distinct
    value is done. All steps are tables of Spark; the driver only sees whether
    a rank is still open. A null group is a group.
    """
    groups = list(group_cols or [])
    x = F.col(f"`{col}`").cast("double") + F.lit(0.0)
    one = F.struct(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(groups)], F.lit(0).alias("g"))
    base = df.select(one.alias("__g"), x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    base = cut_lineage(base.withColumn("__k", order_bits(F.col("__x"))))
    stats = cut_lineage(base.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("min"), F.max("__x").alias("max")))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    both = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    # rank: wanted; left: the same counted from the start of its cell
    open_ = stats.select("__g", F.lit(0).cast("long").alias("cell"), F.explode(both).alias("rank")).withColumn("left", F.col("rank"))
    found, above = None, None
    for shift in _SHIFTS:
        rows = base.withColumn("cell", F.shiftright("__k", above) if above is not None else F.lit(0).cast("long"))
        if above is not None:
            rows = rows.join(open_.select("__g", "cell").distinct(), ["__g", "cell"])
        counts = rows.groupBy("__g", "cell", F.shiftright("__k", shift).alias("next")).agg(
            F.count(F.lit(1)).alias("c"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        cells = counts.groupBy("__g", "cell").agg(F.sort_array(F.collect_list(F.struct("next", "c", "lo", "hi"))).alias("cells"))
        hit = F.expr("""aggregate(cells, named_struct('past', 0L, 'hit', cast(null as struct<next: bigint, c: bigint, lo: double, hi: double>)),
            (s, e) -> if(s.hit is null and left >= s.past + e.c, named_struct('past', s.past + e.c, 'hit', s.hit),
                         named_struct('past', s.past, 'hit', coalesce(s.hit, e))))""")
        step = open_.join(cells, ["__g", "cell"]).withColumn("s", hit)
        step = cut_lineage(step.select("__g", F.col("s.hit.next").alias("cell"), "rank", (F.col("left") - F.col("s.past")).alias("left"), "s.hit.lo", "s.hit.hi"))
        done = step.where("lo = hi").select("__g", "rank", F.col("lo").alias("value"))
        found = done if found is None else found.union(done)
        open_ = step.where("lo < hi").select("__g", "cell", "rank", "left")
        above = shift
        if not open_.limit(1).count():
            break
    values = found.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    def between(a):
        lo, hi = (F.element_at("v", f(a).cast("long")) for f in (F.floor, F.ceil))
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (a - F.floor(a)))

    quantiles = F.array(*[between(a) for a in at])
    out = stats.join(values, "__g")
    return out.select(*[F.col(f"__g.g{i}").alias(g) for i, g in enumerate(groups)], "n", "min", "max", quantiles.alias("q"))


def exact_quantiles(df: DataFrame, col: str, probs: list[float], group_cols: list[str] | None = None) -> dict[tuple, dict]:
    """:func:`quantile_table` on the driver, one entry per group:
    ``{group_tuple: {"n", "min", "max", "q": [values]}}``."""
    groups = list(group_cols or [])
    rows = quantile_table(df, col, probs, groups).collect()
    return {tuple(r[: len(groups)]): {"n": r["n"], "min": r["min"], "max": r["max"], "q": list(r["q"])} for r in rows}
