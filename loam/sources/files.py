"""File sources and sinks.

Listing goes through the Hadoop ``FileSystem`` of the session, so the same
code works on local disk, HDFS and object stores; only file *names* reach
the driver, never data.
"""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens the pandas CSV reader treats as missing by default.
PANDAS_NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


class SourceNotFoundError(FileNotFoundError):
    """Folder or file does not exist."""


def _na_to_null(c: Column, tokens: list[str]) -> Column:
    return F.when(c.isin(tokens), F.lit(None)).otherwise(c)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    na_tokens: list[str] | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV scan with header.

    Every column is scanned as text so that missing-value tokens can be
    nulled before typing; with ``schema`` given, columns are then typed by
    position with ``try_cast`` (a bad cell becomes null, no job fails).
    Without a schema the columns stay text; :func:`loam.functions.cleaning.
    parse_locale_numbers` decides per column.
    """
    tokens = PANDAS_NA_TOKENS if na_tokens is None else na_tokens
    raw = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("inferSchema", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    cols = [_na_to_null(F.col(f"`{c}`"), tokens).alias(c) for c in raw.columns]
    out = raw.select(*cols)
    if schema is None:
        return out
    if len(schema.fields) != len(out.columns):
        raise ValueError(
            f"schema has {len(schema.fields)} fields, file has {len(out.columns)} columns"
        )
    return out.select(
        *[
            F.col(f"`{c}`").try_cast(f.dataType).alias(f.name)
            for c, f in zip(out.columns, schema.fields)
        ]
    )


def _fs_and_path(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(hconf), p


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[dict]:
    """Names and sizes of the files in ``folder`` ending with ``suffix``.

    Raises :class:`SourceNotFoundError` when the folder is missing; returns
    an empty list when it holds no matching file.
    """
    fs, p = _fs_and_path(spark, folder)
    if not fs.exists(p):
        raise SourceNotFoundError(f"folder not found: {folder}")
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.endswith(suffix):
            out.append(
                {"name": name, "size": int(st.getLen()), "is_dir": bool(st.isDirectory())}
            )
    return sorted(out, key=lambda r: r["name"])


def header_layouts(spark: SparkSession, folder: str) -> list[tuple[str, list[str]]]:
    """(header line, names of the files that start with it) of the ``*.csv``
    files of a folder; files without any line are left out.

    One distributed job: the first line of each file is the smallest row number
    among the lines of its first block (numbers alone are aggregated: with the
    lines beside them Spark would sort all lines by file), and files meet by that
    line, so the driver receives one row per layout.
    """
    names = [f["name"] for f in list_files(spark, folder) if not f["is_dir"]]
    if not names:
        raise SourceNotFoundError(f"no CSV file in {folder}")
    base = folder.rstrip("/")
    lines = spark.read.text([f"{base}/{n}" for n in names]).select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.withColumn("row", F.monotonically_increasing_id()).where("start = 0")
    first = lines.groupBy("file").agg(F.min("row").alias("row"))  # one row per file
    heads = (
        lines.join(F.broadcast(first), ["file", "row"], "left_semi")
        .groupBy(F.col("value").alias("head")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    )
    # the hidden column may give a name in URL form
    plain = {**{quote(n): n for n in names}, **{n: n for n in names}}
    return sorted((r["head"], [plain[f] for f in r["files"]]) for r in heads.collect())


def read_csv_folder(
    spark: SparkSession,
    folder: str,
    na_tokens: list[str] | None = None,
    rename: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Read every ``*.csv`` of a folder, keeping the file name.

    Files are grouped by their header line (:func:`header_layouts`) and each
    group is one scan, so a file with its columns in another order is read by
    its own header; ``rename`` harmonises the names of each group. Groups are
    put together by name, a column that a group lacks is null. The file name
    comes from the hidden ``_metadata`` column of the file source.
    """
    tokens = PANDAS_NA_TOKENS if na_tokens is None else na_tokens
    out = None
    for _, names in header_layouts(spark, folder):
        paths = [f"{folder.rstrip('/')}/{n}" for n in names]
        raw = spark.read.option("header", True).option("inferSchema", False).csv(paths)
        cols = [_na_to_null(F.col(f"`{c}`"), tokens).alias(c) for c in raw.columns]
        part = raw.select(*cols, F.col("_metadata.file_name").alias("source_file"))
        if rename is not None:
            part = rename(part)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise SourceNotFoundError(f"no CSV file with a header in {folder}")
    return out.select(*[c for c in out.columns if c != "source_file"], "source_file")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV sink with header, decimal point and no index column (S3)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


#: Folder beside the versions in which numbers are claimed; hidden from readers.
_CLAIMS = "_claims"
#: Writers of one process claim in turn: none of them sees another's claim that
#: is then withdrawn, which would leave a number out.
_TURN = threading.Lock()


def next_version(spark: SparkSession, base_dir: str, prefix: str = "version=") -> int:
    """Next version number in ``base_dir``: ``max(existing) + 1`` (S4), where a
    claimed number exists even if its version is not written, or is gone.

    Counting the entries (and adding one) would overwrite after a deletion,
    so the largest existing number is used instead.
    """
    fs, p = _fs_and_path(spark, base_dir)
    if not fs.exists(p):
        fs.mkdirs(p)
        return 1
    best = 0
    for folder in (p, _fs_and_path(spark, f"{base_dir.rstrip('/')}/{_CLAIMS}")[1]):
        if not fs.exists(folder):
            continue
        for st in fs.listStatus(folder):
            name = st.getPath().getName()
            if not name.startswith(prefix):
                continue
            rest = name[len(prefix):]
            rest = rest.partition(".")[0] if folder is not p else rest.removesuffix(".csv")
            if rest.isdigit():
                best = max(best, int(rest))
    return best + 1


def claim_version(spark: SparkSession, base_dir: str, prefix: str = "version=") -> int:
    """A version number that no other writer gets.

    Creating a file only if it is absent is no single step in every file
    system, so a writer lays a claim of its own name and then looks: alone, the
    number is its own (whoever comes later sees the claim); otherwise all who
    see each other withdraw and try again after a random wait. This needs
    listings that show what was created before, as HDFS and object stores do.
    """
    with _TURN:
        while True:
            n = next_version(spark, base_dir, prefix)
            fs, folder = _fs_and_path(spark, f"{base_dir.rstrip('/')}/{_CLAIMS}")
            fs.mkdirs(folder)
            own = f"{prefix}{n}.{uuid.uuid4().hex}"
            claim = _fs_and_path(spark, f"{base_dir.rstrip('/')}/{_CLAIMS}/{own}")[1]
            fs.create(claim, False).close()
            rivals = [st.getPath().getName() for st in fs.listStatus(folder)]
            if not any(r.startswith(f"{prefix}{n}.") and r != own for r in rivals):
                return n
            fs.delete(claim, False)
            time.sleep(random.random() * 0.2)


def write_versioned(
    df: DataFrame,
    base_dir: str,
    prefix: str = "version=",
    fmt: str = "csv",
) -> tuple[str, int]:
    """Write ``df`` to ``base_dir/<prefix><n>`` with ``n`` a version claimed for
    this writer alone, creating the folder if needed (S4). Returns (path, n); a
    version is complete once it holds Spark's ``_SUCCESS`` marker."""
    spark = df.sparkSession
    n = claim_version(spark, base_dir, prefix)
    path = f"{base_dir.rstrip('/')}/{prefix}{n}"
    w = df.write.mode("errorifexists")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path, n


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns): one count job; the column count is free."""
    return df.count(), len(df.columns)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows, as a lazy plan."""
    return df.limit(n)


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per-column profile: rows, nulls, min, max (S1/S8 report).

    One aggregation pass computes every statistic (partial aggregation on
    each task, a single-row final merge); the row is then unpivoted with
    ``stack``. For text columns min/max are of the character length.
    """
    cols = columns or df.columns
    numeric = (T.NumericType,)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        col = F.col(f"`{c}`")
        val = col.cast("double") if isinstance(dt, numeric) else F.length(col).cast("double")
        aggs += [
            F.count_if(col.isNull()).alias(f"__null{i}"),
            F.min(val + F.lit(0.0)).alias(f"__min{i}"),
            F.max(val + F.lit(0.0)).alias(f"__max{i}"),
        ]
    one = df.agg(*aggs)
    parts = ", ".join(
        f"'{c}', __null{i}, __min{i}, __max{i}" for i, c in enumerate(cols)
    )
    return one.selectExpr(
        "__n AS n_rows",
        f"stack({len(cols)}, {parts}) AS (column_name, n_null, min_value, max_value)",
    ).select("column_name", "n_rows", "n_null", "min_value", "max_value")
