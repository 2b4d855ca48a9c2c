"""Benchmark decontamination by winnowing, in SQL functions only.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A
benchmark window is ``SPAN`` consecutive words of an item (a shorter item is
one window). Both sides hash their k-grams and keep the smallest hash of every
run of SPAN - k + 1 k-grams (leftmost on ties), so a window that occurs in a
document leaves the same fingerprint at the same offset on both sides: no
shared window is missed. Documents and items are joined on fingerprints, each
hit fixes a diagonal (document position minus item position), and the words
along every distinct diagonal are compared to extend the hit exactly.

Items of fewer than SPAN words are winnowed with their own length; the
document is fingerprinted once more for each such length that occurs (at most
SPAN - 1).

Defined cases: null or wordless texts have no words and are clean; wordless
items have no window; equal items with different ids are all reported; an item
without id marks words but is not listed; repeated rows keep one result each;
an empty benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import cut_lineage, hide, show

SPAN = 13
GRAM = 5
#: A document is contaminated from this share of hit words on (1 / SHARE).
SHARE = 20
#: Fixed by the task: what stands between words after lower-casing A-Z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fingerprints keep 33 bits of hash above 31 bits of position.
_POS = 31


def words(text: Column) -> Column:
    """The words of a text: a split at the separators costs a tenth of matching
    the words, and leaves an empty string at either end at most."""
    low = F.translate(F.coalesce(text, F.lit("")), _UP, _UP.lower())
    return F.array_remove(F.split(low, SEPARATOR), "")


def _with_prints(df: DataFrame, spans: list[int], own_length: bool) -> DataFrame:
    """Adds prints: array<long> (hash above position) of column ws, winnowed for
    every span. own_length: a row is winnowed for its own length only."""
    df = df.withColumn("wh", F.expr("transform(ws, w -> xxhash64(w))"))
    cols = []
    for t in spans:
        k = min(GRAM, t)
        w = t - k + 1
        at = ", ".join(f"wh[i + {j}]" if j else "wh[i]" for j in range(k))
        fits = f"size(wh) >= {t}" if not own_length else (f"size(wh) >= {t}" if t == SPAN else f"size(wh) = {t}")
        gram = f"shiftleft(shiftright(xxhash64({t}, {at}), {_POS}), {_POS}) | cast(i as bigint)"
        df = df.withColumn(f"g{t}", F.expr(f"case when {fits} then transform(sequence(0, size(wh) - {k}), i -> {gram}) else array() end"))
        least = f"least({', '.join(f'g{t}[i + {j}]' for j in range(w))})" if w > 1 else f"g{t}[i]"
        cols.append(f"case when size(g{t}) > 0 then array_distinct(transform(sequence(0, size(g{t}) - {w}), i -> {least})) else array() end")
    both = cols[0] if len(cols) == 1 else f"concat({', '.join(cols)})"
    return df.withColumn("prints", F.expr(both))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the id) of every document, plus _n_words,
    _hits (distinct hit word positions) and _items (ids of occurring items)."""
    keep = keep or [id_col]
    items = cut_lineage(
        benchmark.select(F.col("item_id"), words(F.col("text")).alias("ws"))
        .where("size(ws) > 0")
        .distinct()
        .withColumn("key", F.xxhash64("item_id", "ws"))
    )
    short = sorted(r[0] for r in items.where(F.size("ws") < SPAN).select(F.size("ws")).distinct().collect())
    spans = [SPAN, *short]
    cut = [F.expr(f"shiftright(v, {_POS})").alias("print"), F.expr(f"cast(v & {2**_POS - 1} as int)").alias("pos")]
    known = cut_lineage(
        _with_prints(items, spans, True).select("key", F.explode_outer("prints").alias("v")).where("v is not null").select("key", *cut).withColumnRenamed("pos", "item_pos")
    )
    prints = _with_prints(docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("ws")), spans, False)
    # Spark broadcasts the benchmark's fingerprints only below its own threshold
    hits = (
        # (an inner explode would have Spark infer a filter that repeats the whole expression)
        prints.select("id", F.explode_outer("prints").alias("v")).where("v is not null").select("id", *cut)
        .join(known, "print")
        .select("id", "key", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .distinct()
        .join(items.withColumnRenamed("ws", "iw"), "key")
        .groupBy("id")
        .agg(F.collect_list(F.struct("item_id", "diagonal", "iw")).alias("_cands"))
    )
    src = docs.select(*[F.col(c) for c in dict.fromkeys([*keep, id_col, text_col])])
    rows = src.join(hits, src[id_col].eqNullSafe(hits["id"]), "left").withColumn("_ws", words(F.col(text_col)))
    # where a whole window agrees along the diagonal, all its words are hit
    rows = rows.withColumn("_runs", F.expr(
        f"""transform(coalesce(_cands, array()), c -> struct(c.item_id as item_id, flatten(transform(
              filter(sequence(0, greatest(size(c.iw) - {SPAN}, 0)),
                j -> c.diagonal + j >= 0 and slice(_ws, c.diagonal + j + 1, least({SPAN}, size(c.iw))) = slice(c.iw, j + 1, least({SPAN}, size(c.iw)))),
              j -> sequence(c.diagonal + j, c.diagonal + j + least({SPAN}, size(c.iw)) - 1))) as at))"""
    ))
    # the generator keeps later filters from being pushed into (and repeating) the expressions
    found = F.struct(
        F.size("_ws").cast("long").alias("_n_words"),
        F.expr("array_distinct(flatten(transform(_runs, r -> r.at)))").alias("_hits"),
        F.expr("array_distinct(transform(filter(_runs, r -> size(r.at) > 0 and r.item_id is not null), r -> cast(r.item_id as string)))").alias("_items"),
    )
    return rows.select(*keep, F.explode_outer(F.array(found)).alias("_f")).select(*keep, "_f.*")


def _contaminated() -> Column:
    return (F.size("_hits") > 0) & (F.size("_hits").cast("long") * SHARE >= F.col("_n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    return find(docs, benchmark, id_col, text_col).select(
        id_col,
        F.col("_n_words").alias("n_words"),
        F.size("_hits").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.sort_array("_items"), ","), "UTF-8"), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    plain, names = hide(docs)
    found = find(plain, benchmark, names[id_col], names[text_col], list(names.values()))
    return show(found.where(~_contaminated()), names)
