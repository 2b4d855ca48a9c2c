"""URL filter: rules, then a character language-model ratio.

Rules decide the URLs that they fit (host and all its subdomains, path prefix;
the longest rule wins). All other URLs are judged by two smoothed
variable-order Markov models over the characters of host + path: one counted
over the URLs that the rules allow, one over those that they block. The counts
of all contexts of 0 to ``ORDER`` characters are a Spark table keyed by the
64-bit hash of (order, context) or (order, context, byte), so it grows with the
input and contexts share no cell. Distinct strings are scored in parts: each
part asks the table for the distinct keys that it holds, so no task and not the
driver sees the whole table. Probabilities back off from long to short contexts
by Dirichlet smoothing. The score is the log-likelihood difference (accepted minus rejected)
per character; the threshold is calibrated on a fold of the ruled URLs that the
counting leaves out.

Defined cases: a null URL or one without ``://`` has an empty host and path; an
empty string scores 0; if either class has no ruled URL at all, every score is
0 and the unruled URLs are allowed; repeated rows get equal verdicts; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import binary_lengths, cut_lineage, mix64, slices

#: (rule, verdict): fixed by the task.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
ORDER = 5
#: Bytes of strings that one part holds when scored, and the least number of parts.
PART_BYTES = 64 << 10
MIN_PARTS = 256
#: Keys that a counting task holds before it sends them on.
HELD_CELLS = 1 << 21
#: A string that more than one row in so many holds is joined by broadcast.
HOT_SHARE = 1000
#: Weight of the shorter context's probability.
ALPHA = 4.0
#: One ruled URL in so many (by hash) calibrates the threshold.
CALIBRATION_FOLD = 5
SCORE_BINS = 2000
SCORE_SPAN = 5.0
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column, '' where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _ASCII, _ASCII.lower()), path


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict (null where no rule fits) to host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all strings end to end, their lengths, each byte's place in its
    own string."""
    lens = binary_lengths(col)
    data = np.frombuffer("".join(x or "" for x in col.to_pylist()).encode("utf-8", "replace"), dtype=np.uint8)
    starts = np.cumsum(lens) - lens
    place = np.arange(len(data)) - np.repeat(starts, lens)
    return data, lens, place


def _cells(data: np.ndarray, place: np.ndarray):
    """For each context length: the keys of (context) and (context, byte)."""
    ctx = np.full(len(data), 0x51ED270B, dtype=np.uint64)
    sym = data.astype(np.uint64)
    for k in range(ORDER + 1):
        if k:
            back = np.zeros(len(data), dtype=np.uint64)
            back[k:] = sym[:-k] + np.uint64(1)
            back[place < k] = 0  # before the start
            ctx = mix64(ctx * np.uint64(0x100000001B3) + back + np.uint64(k))
        yield mix64(ctx ^ np.uint64(0xABCDEF)).view(np.int64), mix64(ctx + (sym + np.uint64(257)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _summed(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(cells, return_inverse=True)
    out = np.zeros(len(names), dtype=np.int64)
    np.add.at(out, at, n)
    return names, out


def count_cells(ruled: DataFrame, weight: Column | None = None) -> DataFrame:
    """cell, label, n: summed over all rows of ruled (s, label), each counted
    ``weight`` times (default once); tasks pre-sum what they hold."""

    def run(batches):
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def merge():
            for y in (0, 1):
                if held[y]:
                    held[y] = [_summed(*(np.concatenate(x) for x in zip(*held[y])))]

        def send():
            for y in (0, 1):
                for cells, n in held[y]:
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), y, np.int32)), pa.array(n)], ["cell", "label", "n"])
                held[y] = []

        size = lambda: sum(len(c) for h in held for c, _ in h)
        for big in batches:
            for b in slices(big, "s", 128 << 10):
                data, lens, place = _flat(b.column(0))
                label = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), lens)
                times = np.repeat(b.column(2).to_numpy(zero_copy_only=False), lens)
                keys = [x for pair in _cells(data, place) for x in pair]
                for y in (0, 1):
                    on = label == y
                    if on.any():
                        held[y].append(_summed(np.concatenate([k[on] for k in keys]), np.tile(times[on], len(keys))))
                if size() > HELD_CELLS:
                    merge()
                    if size() > HELD_CELLS // 2:
                        yield from send()
        merge()
        yield from send()

    rows = ruled.select("s", "label", (F.lit(1) if weight is None else weight).cast("long").alias("_n"))
    return rows.mapInArrow(run, "cell long, label int, n long").groupBy("cell", "label").agg(F.sum("n").alias("n"))


def _scores(col: pa.Array, cells: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores of strings; ``cells`` (sorted) and the counts of both labels hold
    every counted key of these strings."""
    data, lens, place = _flat(col)
    if not len(data):
        return np.zeros(len(lens))
    counts = [np.append(n, 0) for n in counts]

    def where(keys):
        at = np.searchsorted(cells, keys)
        found = np.append(cells, 0)[at] == keys
        return np.where(found & (at < len(cells)), at, len(cells))

    p = [np.full(len(data), 1 / 256), np.full(len(data), 1 / 256)]
    for ctx, sym in _cells(data, place):
        ctx, sym = where(ctx), where(sym)
        for y in (0, 1):
            p[y] = (counts[y][sym] + ALPHA * p[y]) / (counts[y][ctx] + ALPHA)
    diff = np.concatenate([[0.0], np.cumsum(np.log(p[1]) - np.log(p[0]))])
    ends = np.cumsum(lens)
    total = diff[ends] - diff[ends - lens]
    return np.where(lens > 0, total / np.maximum(lens, 1), 0.0)


def score(strings: DataFrame, counts: DataFrame, n_parts: int) -> DataFrame:
    """s, score of every row of strings (distinct s); ``counts``: cell, n0, n1."""
    parts = strings.select(F.pmod(F.xxhash64("s"), F.lit(n_parts)).alias("part"), "s")

    def ask(group: pa.Table) -> pa.Table:
        found = [np.zeros(0, dtype=np.int64)]
        for batch in group.combine_chunks().to_batches():
            for b in slices(batch, "s", PART_BYTES):
                data, _, place = _flat(b.column(1))
                found.append(np.unique(np.concatenate([x for pair in _cells(data, place) for x in pair])))
        cells = np.unique(np.concatenate(found))
        return pa.table({"part": np.full(len(cells), group["part"][0].as_py()), "cell": cells})

    def answer(group: pa.Table, known: pa.Table) -> pa.Table:
        cells = known["cell"].to_numpy()
        order = np.argsort(cells)
        counts = tuple(known[c].to_numpy()[order] for c in ("n0", "n1"))
        s, got = group["s"].combine_chunks(), []
        for b in slices(pa.RecordBatch.from_arrays([s], ["s"]), "s", PART_BYTES):
            got.append(_scores(b.column(0), cells[order], counts))
        return pa.table({"s": s, "score": np.concatenate(got) if got else np.zeros(0)})

    known = parts.groupBy("part").applyInArrow(ask, "part long, cell long").join(counts, "cell").select("part", "cell", "n0", "n1")
    return parts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, "s string, score double")


def threshold(scored: DataFrame) -> float:
    """The cut that balances the error rates of both classes over scored
    (score, label, n), from a histogram that Spark sums."""
    step = 2 * SCORE_SPAN / SCORE_BINS
    bins = F.least(F.greatest(F.floor((F.col("score") + SCORE_SPAN) / step), F.lit(0)), F.lit(SCORE_BINS - 1))
    h = np.zeros((2, SCORE_BINS))
    for r in scored.groupBy("label", bins.alias("bin")).agg(F.sum("n").alias("n")).collect():
        h[r["label"], r["bin"]] = r["n"]
    h /= np.maximum(h.sum(axis=1, keepdims=True), 1)
    # cut before bin i: blocked below, allowed from there on
    wrong = np.concatenate([[0.0], np.cumsum(h[1])]) + 1 - np.concatenate([[0.0], np.cumsum(h[0])])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return -SCORE_SPAN + step * float(best[len(best) // 2])


def fit_score(base: DataFrame) -> tuple[DataFrame, float]:
    """s, n (rows), score of every distinct s of base (s, rule_verdict), and the
    threshold. Counts come from the ruled rows of all folds but the calibration
    fold, the threshold from that fold. A string's rule is that of all its rows."""
    label = F.max((F.col("rule_verdict") == "allow").cast("int"))
    strings = cut_lineage(base.groupBy("s").agg(F.count("*").alias("n"), label.alias("label")))
    learns = F.pmod(F.xxhash64("s"), F.lit(CALIBRATION_FOLD)) != 0
    seen = strings.agg(
        F.sum(F.octet_length("s")).alias("bytes"),
        *[F.max(((F.col("label") == y) & learns & (F.col("s") != "")).cast("int")).alias(f"has{y}") for y in (0, 1)],
    ).first()
    if not (seen["has0"] and seen["has1"]):
        return strings.select("s", "n", F.lit(0.0).alias("score")), 0.0
    ruled = strings.where("label is not null")
    sums = [F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    counts = count_cells(ruled.where(learns), F.col("n")).groupBy("cell").agg(*sums)
    scores = score(strings, counts, max(MIN_PARTS, -(-seen["bytes"] // PART_BYTES)))
    scored = cut_lineage(strings.join(scores, "s"))
    return scored.select("s", "n", "score"), threshold(scored.where(F.col("label").isNotNull() & ~learns))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict (allow or block), score of every row."""
    named = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    host, path = host_path(F.col("_url"))
    base = with_rule(named.select(id_col, host.alias("host"), path.alias("path")), rules)
    base = cut_lineage(base.withColumn("s", F.concat("host", "path")))
    scored, cut = fit_score(base)
    # strings of a large share of the rows (fewer than HOT_SHARE) are broadcast
    total = scored.agg(F.sum("n")).first()[0] or 0
    hot, cold = scored.where(F.col("n") * HOT_SHARE > total).drop("n"), scored.where(F.col("n") * HOT_SHARE <= total).drop("n")
    known = base.join(F.broadcast(hot), "s").unionByName(base.join(F.broadcast(hot.select("s")), "s", "left_anti").join(cold, "s"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return known.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
