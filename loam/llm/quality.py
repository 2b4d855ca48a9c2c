"""Quality classifier: histogram gradient-boosted trees over document
statistics, flattened into arrays and traversed with vectorised numpy.

The trees are fitted on a bounded sample of labelled rows (``sample_rows``,
taken in hash order of the id, so the same rows at every layout); every
document is scored. Statistics are of the text alone.

Defined cases: null text counts as empty; an empty text has all statistics 0
and gets the score of that leaf; repeated rows get equal scores; labels that
name no document, or are null, are not used; without labels of both classes
every score is the share of label 1 (0.5 without labels); extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import slices

FEATURES = (
    "log_chars", "log_words", "mean_word", "upper", "digit", "space", "newline", "punct", "symbol", "non_ascii",
    "distinct_words", "adjacent_same", "distinct_pairs", "top_word", "distinct_lines", "log_mean_line", "longest_word",
    "compress", "sentence_end", "symbol_words", "upper_words",
)
SAMPLE_ROWS = 20_000
TREES = 120
DEPTH = 4
RATE = 0.15
BINS = 64
L2 = 1.0
MIN_LEAF = 10
THRESHOLD = 0.7

_UPPER = slice(65, 91)
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{|}~/", dtype=np.uint8)
_PUNCT = np.frombuffer(b"!\"'(),-.:;?", dtype=np.uint8)


def statistics(text: str | None) -> list[float]:
    """The document statistics, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    pairs = max(1, len(words) - 1)
    return [
        np.log1p(n), np.log1p(len(words)), (n - hist[32] - hist[10]) / m,
        hist[_UPPER].sum() / n, hist[48:58].sum() / n, hist[32] / n, hist[10] / n,
        hist[_PUNCT].sum() / n, hist[_SYMBOLS].sum() / n, hist[128:].sum() / n,
        len(seen) / m, sum(map(eq, words, words[1:])) / pairs, len(set(zip(words, words[1:]))) / pairs,
        max(seen.values(), default=0) / m,
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        np.log1p(max(map(len, seen), default=0)),
        len(zlib.compress(raw, 1)) / n,
        hist[46] / m,
        sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,") / m,
        sum(c for w, c in seen.items() if w.isupper()) / m,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


class BoostedTrees:
    """Complete binary trees of one depth, flattened: node i of tree t has its
    children at 2i+1 and 2i+2; a closed node sends every row left."""

    def __init__(self, feature, cut, leaf, base):
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += v[node - inner]
        return 1 / (1 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> BoostedTrees:
    """Logistic gradient boosting on feature histograms."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        z = np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5))
        return BoostedTrees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), z)
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # code > b <=> x > cuts[b]
    base = float(np.log(share / (1 - share)))
    z = np.full(len(y), base)
    feats, cutv, leafs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            pick = [(0, -1)] * width
            for j in range(d):
                key = at * BINS + code[:, j]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                ns = np.bincount(key, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < MIN_LEAF) | (nt - ns < MIN_LEAF)] = -1
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1] == 0:
                    continue
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                for w in np.flatnonzero(top > best):
                    best[w], pick[w] = top[w], (j, int(b[w]))
            right = np.zeros(len(y), dtype=np.int64)
            for w, (j, b) in enumerate(pick):
                if b >= 0:
                    feature[first + w], cut[first + w] = j, cuts[j][b]
                    on = at == w
                    right[on] = code[on, j] > b
            node = 2 * node + 1 + right
        at = node - inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
        z += leaf[at]
        feats.append(feature)
        cutv.append(cut)
        leafs.append(leaf)
    return BoostedTrees(np.array(feats), np.array(cutv), np.array(leafs), base)


def held_out(id_col: Column) -> Column:
    """True for ids whose crc32 (of the id as text) leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """Fits the trees on at most ``sample_rows`` labelled rows that are not held
    out: the labelled ids are cut first (narrow), so that only the sample's
    texts are read into statistics."""
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(id_col)
        .agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_y2"))
        .where("_y = _y2")  # an id with both labels teaches nothing
        .drop("_y2")
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(sample_rows)
    )
    # at most sample_rows narrow rows: a proven bound
    taught = docs.select(id_col, text_col).join(F.broadcast(ids), id_col)
    names = [f"f{j}" for j in range(len(FEATURES))]

    def run(batches):
        for big in batches:
            for b in slices(big, text_col):
                x = matrix(b.column(b.schema.get_field_index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(id_col)), *[pa.array(x[:, j]) for j in range(x.shape[1])], b.column(b.schema.get_field_index("_y")).cast(pa.int32())],
                    [id_col, *names, "y"],
                )

    got = taught.mapInArrow(run, ", ".join([f"{id_col} long", *[f"{c} double" for c in names], "y int"]))
    got = got.groupBy(id_col).agg(F.min(F.struct(*names, "y")).alias("r")).select(id_col, "r.*").orderBy(id_col).toPandas()
    return fit_trees(got[names].to_numpy(dtype=np.float64), got["y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """``keep`` columns (default: the id) plus ``score_col`` of every row."""
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*dict.fromkeys([*keep, text_col]))
    schema = docs.select(*keep).schema.add(score_col, "double", False)

    def run(batches):
        trees = shared.value
        for big in batches:
            for b in slices(big, text_col):
                s = trees.scores(matrix(b.column(b.schema.get_field_index(text_col)).to_pylist()))
                cols = [b.column(b.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s)], [*keep, score_col])

    return src.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with all their
    columns. Only the text goes to Python and only the score comes back."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        trees = shared.value
        parts = [trees.scores(matrix(b.column(0).to_pylist())) for b in slices(pa.RecordBatch.from_arrays([text], ["t"]), "t")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(rate(docs[text_col]) >= THRESHOLD)
