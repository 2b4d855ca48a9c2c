"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loam.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401  (re-exported)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with all its columns under neutral names, which no column of an
    operator clashes with, and the new name of each."""
    names = {c: f"_k{i}" for i, c in enumerate(df.columns)}
    return df.select(*[df[c].alias(n) for c, n in names.items()]), names


def show(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The hidden columns under their own names again."""
    return df.select(*[df[n].alias(c) for c, n in names.items()])


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Cut an Arrow batch into runs of rows that hold about ``max_bytes`` of
    ``column`` (one row at least), so working memory follows bytes, not rows."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    off = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(binary_lengths(col), out=off[1:])
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
        end = max(start + 1, min(end, n))
        yield batch.slice(start, end - start)
        start = end
    give_back()


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps its own rules
        return None


def give_back() -> None:
    """Returns to the system what this worker has freed: workers are used again
    by later stages, beside the heap of their executor."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def binary_lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    lens = pc.fill_null(pc.binary_length(col), 0)
    return np.asarray(lens.to_numpy(zero_copy_only=False), dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash (vectorised, wraps on purpose)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def pair64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit hash of two 64-bit hashes."""
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x2545F4914F6CDD1D)))
