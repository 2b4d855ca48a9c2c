"""Exact-size, reproducible hold-out and K-fold splits.

Sizes follow the ceil rule of the usual two-step split: ``n_test =
ceil(test_size * n)``, then ``n_val = ceil(val_size * (n - n_test))`` (498
rows give 100 / 60 / 338). Membership comes from a seeded hash rank, so it
does not depend on the partitioning or on the order rows arrive in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.ranking import before_cut, cut_positions, hash_rank, key_rank


@dataclass(frozen=True)
class SplitSizes:
    n: int
    test: int
    val: int
    train: int


def split_sizes(n: int, test_size: float = 0.20, val_size: float = 0.15) -> SplitSizes:
    n_test = math.ceil(test_size * n) if test_size < 1 else int(test_size)
    n_tv = n - n_test
    n_val = math.ceil(val_size * n_tv) if val_size < 1 else int(val_size)
    return SplitSizes(n, n_test, n_val, n_tv - n_val)


def holdout_split(
    df: DataFrame,
    key_cols: list[str],
    test_size: float = 0.20,
    val_size: float = 0.15,
    seed: int = 42,
    split_col: str = "split",
    keep_rank: bool = False,
) -> tuple[DataFrame, SplitSizes]:
    """Add ``split`` in {'test', 'val', 'train'}.

    The first ``n_test`` rows of the seeded permutation are test, the next
    ``n_val`` validation, the rest train. Only the two rows at the cuts are
    looked up (:func:`cut_positions`); all others are labelled where they
    are, by comparing their key hash -- no row is shuffled. Keys should be
    unique: rows with equal keys get one label, and sizes are then exact up
    to such a group. ``keep_rank`` adds the rank itself, which needs a sort.
    """
    if not keep_rank:
        size = lambda n: split_sizes(n, test_size, val_size)
        n, cuts = cut_positions(df, key_cols, seed, lambda n: [size(n).test, size(n).test + size(n).val])
        label = F.lit("train") if len(cuts) == 2 else F.lit("val")
        if len(cuts) == 2:
            label = F.when(before_cut(key_cols, seed, cuts[1], df), F.lit("val")).otherwise(label)
        if cuts:
            label = F.when(before_cut(key_cols, seed, cuts[0], df), F.lit("test")).otherwise(label)
        else:
            label = F.lit("test")
        return df.withColumn(split_col, label), size(n)
    ranked, n = hash_rank(df, key_cols, seed, rank_col="__rank")
    sz = split_sizes(n, test_size, val_size)
    r = F.col("__rank")
    out = ranked.withColumn(
        split_col,
        F.when(r < F.lit(sz.test), F.lit("test"))
        .when(r < F.lit(sz.test + sz.val), F.lit("val"))
        .otherwise(F.lit("train")),
    )
    return out.withColumnRenamed("__rank", "split_rank"), sz


def assign_folds(
    df: DataFrame,
    key_cols: list[str],
    k: int = 10,
    seed: int = 42,
    fold_col: str = "fold",
) -> DataFrame:
    """Shuffled K-fold assignment (X2); the fold column feeds
    ``CrossValidator(foldCol=...)``. Folds are ranges of the seeded hash
    order between ``k - 1`` looked-up cuts; no row is shuffled."""
    def starts(n):  # the first n % k folds are one row larger
        q, rem = divmod(n, k)
        return [i * q + min(i, rem) for i in range(1, k)]

    n, cuts = cut_positions(df, key_cols, seed, starts)
    if n < k:
        raise ValueError(f"{k} folds need at least {k} rows, got {n}")
    fold = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        fold = F.when(before_cut(key_cols, seed, cuts[i], df), F.lit(i)).otherwise(fold)
    return df.withColumn(fold_col, fold.cast("int"))


def split_report(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split (X5): one grouped count, partial aggregation per task."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))


def row_index(df: DataFrame, order_col: str, tie_cols: list[str] | None = None,
              out: str = "row_index") -> DataFrame:
    """Consecutive 0-based index in key order after rows were dropped."""
    return key_rank(df, order_col, tie_cols, out)
