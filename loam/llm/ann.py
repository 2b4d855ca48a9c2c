"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Unit vectors are hashed by ``TABLES`` tables of ``PROJECTIONS`` Gaussian
projections cut into cells of width ``WIDTH``. A query visits the perturbed
cells of each table in the order of their estimated success (the squared
distance from the query's projections to the cell), the candidates of all
tables are reranked by the exact cosine, and the best of all cells are merged.
How many cells are visited per table is fitted: a documented bounded sample of
queries (``CALIBRATION_QUERIES``) is answered by brute force, and the number of
probes is the smallest that reaches ``TARGET_RECALL`` on it. Every row is
indexed.

Groups of equal vectors: only the k + 1 smallest ids of a group can be among
the k nearest of any query (equal scores, ties to the smaller id), so the index
holds these ids for the whole group; queries are never dropped. Large cells are
split by a salt, so no task holds more than about ``CELL_ROWS`` members of one.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do vectors whose length is not the most frequent
one (ties: the smaller); rows repeated in id and vector count once; fewer than
k candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import cut_lineage

TABLES = 6
PROJECTIONS = 4
WIDTH = 2.0
SEED = 20
CALIBRATION_QUERIES = 120
TARGET_RECALL = 0.96
CELL_ROWS = 20_000


class Tables:
    """The random projections and the perturbations of a cell."""

    def __init__(self, dim: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, projections, dim))
        self.b = rng.uniform(0, width, (tables, projections))
        self.width, self.tables = width, tables
        self.steps = np.array(list(itertools.product((-2, -1, 0, 1, 2), repeat=projections)), dtype=np.int64)

    def cells(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers [n, projections] and the place inside the cell."""
        y = (unit @ self.a[t].T + self.b[t]) / self.width
        cell = np.floor(y)
        return cell.astype(np.int64), (y - cell) * self.width

    def key(self, cell: np.ndarray, t: int) -> np.ndarray:
        """One long per table and cell (cells lie within +-500)."""
        out = np.full(cell.shape[:-1], t, dtype=np.int64)
        for j in range(cell.shape[-1]):
            out = out * 1000 + np.clip(cell[..., j], -499, 500) + 499
        return out

    def costs(self, place: np.ndarray) -> np.ndarray:
        """Squared distance to every perturbed cell [n, steps]."""
        s = self.steps[None]
        f = place[:, None, :]
        gap = np.where(s < 0, f - (s + 1) * self.width, np.where(s > 0, s * self.width - f, 0.0))
        return (gap**2).sum(axis=2)


def _unpack(col: pa.Array) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec (packed doubles), of the rows that take part; one row per
    distinct id and vector."""
    v = F.col(vec_col).cast("array<double>")
    fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0]["d"] if dims else 1

    def pack(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            mat = flat.reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in mat], pa.binary())], ["vec_id", "vec"])

    return rows.where(F.size("v") == dim).mapInArrow(pack, "vec_id long, vec binary").dropDuplicates(["vec_id", "vec"])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q (one vector) with each row, summed the same way per row."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def best(qid: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, k: int):
    """The k nearest of (ids, x) to q: rough scores preselect with a margin far
    above their rounding error, exact ones decide."""
    rough = np.where(ids == qid, -np.inf, rough)
    if len(ids) > k:
        least = np.partition(rough, len(ids) - k)[len(ids) - k]
        on = np.flatnonzero((rough >= least - 1e-9) & (ids != qid))
    else:
        on = np.flatnonzero(ids != qid)
    s = exact_scores(q, x[on])
    order = np.lexsort((ids[on], -s))[:k]
    return ids[on][order], s[order]


def _calibrate(index: DataFrame, queries: DataFrame, tabs: Tables, k: int) -> int:
    """The number of probes per table that reaches the target recall."""
    picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION_QUERIES).collect()
    if not picked:
        return 1
    qid = np.array([r["vec_id"] for r in picked])
    q = np.stack([np.frombuffer(r["vec"], dtype=np.float64) for r in picked])
    unit = _unit(q)
    shared = index.sparkSession.sparkContext.broadcast((qid, q, unit))

    def scan(batches):  # the exact nearest of the sample within each batch
        ids0, q0, u0 = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _unpack(b.column(1))
            rough = u0 @ _unit(x).T
            out = []
            for i in range(len(ids0)):
                got, s = best(ids0[i], q0[i], ids, x, rough[i], k)
                at = {int(v): j for j, v in enumerate(ids)}
                out += [(i, int(g), float(v), x[at[int(g)]].tobytes()) for g, v in zip(got, s)]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.binary()))], ["i", "vec_id", "score", "vec"])

    w = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    near = index.mapInArrow(scan, "i int, vec_id long, score double, vec binary").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).collect()
    if not near:
        return 1
    qi = np.array([r["i"] for r in near])
    x = _unit(np.stack([np.frombuffer(r["vec"], dtype=np.float64) for r in near]))
    rank = np.full(len(near), len(tabs.steps))
    for t in range(tabs.tables):
        home, place = tabs.cells(unit, t)
        order = tabs.costs(place).argsort(axis=1, kind="stable").argsort(axis=1)
        there, _ = tabs.cells(x, t)
        step = there - home[qi]
        seen = (np.abs(step) <= 2).all(axis=1)
        base = np.zeros(len(near), dtype=np.int64)
        for j in range(step.shape[1]):
            base = base * 5 + step[:, j] + 2
        rank[seen] = np.minimum(rank[seen], order[qi[seen], base[seen]] + 1)
    rank.sort()
    return int(min(len(tabs.steps), rank[int(np.ceil(TARGET_RECALL * len(rank))) - 1]))


def search(df: DataFrame, query_filter=None, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row
    that ``query_filter`` (a Column over vec_id; default: all) selects."""
    rows = cut_lineage(usable(df, id_col, vec_col))
    first = rows.limit(1).collect()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not first:
        return empty
    dim = len(first[0]["vec"]) // 8
    tabs = Tables(dim)
    twin = Window.partitionBy("vec").orderBy("vec_id")
    index = cut_lineage(rows.withColumn("_n", F.row_number().over(twin)).where(F.col("_n") <= k + 1).select("vec_id", "vec"))
    queries = rows if query_filter is None else rows.where(query_filter)
    visits = probes or _calibrate(index, queries, tabs, k)

    def place_members(batches):
        for b in batches:
            unit = _unit(_unpack(b.column(1))) if b.num_rows else np.zeros((0, dim))
            for t in range(tabs.tables):
                yield pa.RecordBatch.from_arrays([pa.array(tabs.key(tabs.cells(unit, t)[0], t)), b.column(0), b.column(1)], ["cell", "vec_id", "vec"])

    members = index.mapInArrow(place_members, "cell long, vec_id long, vec binary")
    largest = members.groupBy("cell").count().agg(F.max("count")).first()[0] or 1
    salts = -(-largest // CELL_ROWS)
    members = members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))

    def visit(batches):
        for b in batches:
            ids, raw = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(1).to_pylist(), dtype=object)
            for lo in range(0, len(ids), 256):
                part = raw[lo:lo + 256]
                unit = _unit(np.frombuffer(b"".join(part), dtype=np.float64).reshape(len(part), -1))
                for t in range(tabs.tables):
                    home, inside = tabs.cells(unit, t)
                    order = tabs.costs(inside).argsort(axis=1, kind="stable")[:, :visits]
                    keys = tabs.key(home[:, None, :] + tabs.steps[order], t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(ids[lo:lo + 256], visits)), pa.array(np.repeat(part, visits), pa.binary())],
                        ["cell", "query_id", "qvec"],
                    )

    asked = queries.mapInArrow(visit, "cell long, query_id long, qvec binary")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(int(salts - 1)))))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            ids = right["vec_id"].to_numpy()
            x = np.frombuffer(b"".join(right["vec"]), dtype=np.float64).reshape(len(ids), -1)
            ux = _unit(x)
            qids = left["query_id"].to_numpy()
            for lo in range(0, len(qids), 256):
                q = np.frombuffer(b"".join(left["qvec"].iloc[lo:lo + 256]), dtype=np.float64).reshape(-1, x.shape[1])
                rough = _unit(q) @ ux.T
                for i in range(len(q)):
                    got, s = best(qids[lo + i], q[i], ids, x, rough[i], k)
                    found.append((np.full(len(got), qids[lo + i]), got, s))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    found = asked.groupBy("cell", "salt").cogroup(members.groupBy("cell", "salt")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
