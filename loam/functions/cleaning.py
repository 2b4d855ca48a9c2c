"""Cleaning: locale number parsing, outlier masks, completeness, range rules
(C1-C8). All column expressions; the only action is the one aggregate that
decides which text columns are numeric (C1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.schema import FEATURES

# Inclusive physical limits per canonical feature.
RANGE_LIMITS = {
    "p25_4": (0.0, 100.0),
    "p9_5": (0.0, 100.0),
    "p4_8": (0.0, 100.0),
    "p2_0": (0.0, 100.0),
    "p0_42": (0.0, 100.0),
    "p0_076": (0.0, 100.0),
    "ll": (0.0, 100.0),
    "ip": (0.0, 80.0),
    "w_opt": (5.0, 40.0),
    "d_max": (1200.0, 2200.0),
}

# Outlier mask bounds of the cleaning job (value kept when
# 1 <= x <= 3000) and the columns it checks by default.
OUTLIER_LO = 1.0
OUTLIER_HI = 3000.0
OUTLIER_COLUMNS = FEATURES + ["cbr"]


def locale_text_to_number_text(c: Column, mode: str = "strict_br") -> Column:
    """Rewrite a locale-formatted number as plain ``1234.5`` text.

    ``strict_br``: drop spaces, drop every ``.``, turn ``,`` into ``.``,
    trim -- the source rule, which also turns ``100.0`` into ``1000``.
    ``auto``: drop white space; the last ``.`` or ``,`` of a token is the
    decimal separator and every earlier one is a thousands separator.
    """
    if mode == "strict_br":
        # replacements of whole bytes: several times faster than translate
        bare = F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("."), F.lit(""))
        return F.replace(bare, F.lit(","), F.lit("."))
    if mode == "auto":
        s = F.regexp_replace(c, r"\s", "")
        s = F.regexp_replace(s, r"[.,](?=.*[.,])", "")
        return F.regexp_replace(s, ",", ".")
    raise ValueError(f"unknown mode {mode!r}")


def number_or_null(text: Column) -> Column:
    """Text as double, null unless it is written as a plain decimal number.

    Spark's cast also takes type suffixes and words (``12D``, ``7f``,
    ``Infinity``); only digits, sign, point and exponent count here."""
    plain = F.trim(text).rlike(r"^[0-9+\-.eE]*\z")
    return F.when(plain, text.try_cast("double"))


def parse_locale_numbers(
    df: DataFrame,
    columns: list[str] | None = None,
    mode: str = "strict_br",
    return_decisions: bool = False,
):
    """All-or-nothing numeric parse of text columns.

    A text column becomes double only when *every* non-missing cell parses;
    one bad cell keeps the whole column as text, unchanged. The decision is
    one aggregation over the data (a count of "present before, null after"
    per column, partially aggregated per task); the conversion itself is a
    lazy projection.
    """
    text_cols = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    ]
    if not text_cols:
        return (df, {}) if return_decisions else df
    # one function over the cells of a row: the same expressions spelt out for
    # each column would outgrow the methods that the JVM compiles (8,000 bytes)
    cells = F.array(*[F.col(f"`{c}`") for c in text_cols])
    cleaned = F.transform(cells, lambda c: locale_text_to_number_text(c, mode))
    texts = df.select(cleaned.alias("text"))
    both = texts.select("text", F.transform("text", number_or_null).alias("number"))
    # '' after cleaning is a missing value, not a bad one
    bad = [F.count_if((F.col("text")[i] != "") & F.col("number")[i].isNull()).alias(f"b{i}") for i in range(len(text_cols))]
    row = both.agg(*bad).first()
    decisions = {c: row[f"b{i}"] == 0 for i, c in enumerate(text_cols)}
    good = [c for c in text_cols if decisions[c]]
    if not good:
        return (df, decisions) if return_decisions else df
    # positions instead of names, which no name of the table clashes with
    kept = [c for c in df.columns if c not in good]
    numbers = F.transform(F.array(*[F.col(f"`{c}`") for c in good]), lambda c: number_or_null(locale_text_to_number_text(c, mode)))
    wide = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], numbers.alias("_numbers"))
    out = wide.select(*[(F.col("_numbers")[good.index(c)] if c in good else F.col(f"_{kept.index(c)}")).alias(c) for c in df.columns])
    return (out, decisions) if return_decisions else out


def parse_decimal_comma(c: Column) -> Column:
    """One value with ``,`` or ``.`` as decimal separator; bad text -> null."""
    return number_or_null(F.translate(c, ",", "."))


def mask_outliers(
    df: DataFrame,
    columns: list[str] | None = None,
    lo: float = OUTLIER_LO,
    hi: float = OUTLIER_HI,
    bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Null every value outside [lo, hi] in numeric listed columns.

    ``bounds`` overrides the limits per column. Columns that are absent or
    not numeric are left alone. NaN compares greater than any number in
    Spark, so NaN is nulled too.
    """
    cols = OUTLIER_COLUMNS if columns is None else columns
    bounds = bounds or {}
    present = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        dt = present[name]
        if name in cols and isinstance(dt, T.NumericType):
            l, h = bounds.get(name, (lo, hi))
            exprs.append(F.when((c >= F.lit(l)) & (c <= F.lit(h)), c).cast(dt).alias(name))
        else:
            exprs.append(c)
    return df.select(*exprs)


def _complete(columns: list[str], df: DataFrame) -> Column:
    conds = []
    for c in columns:
        col = F.col(f"`{c}`")
        cond = col.isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            cond = cond & ~F.isnan(col)
        conds.append(cond)
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with any missing (null or NaN) value."""
    return df.na.drop("any", subset=columns)


def cleaning_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows before / after / removed by :func:`drop_incomplete` (C4).

    One aggregation pass over the masked table; no second scan.
    """
    cols = columns or df.columns
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(_complete(cols, df)).alias("rows_after"),
    ).select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
    )


def clean(
    df: DataFrame,
    columns: list[str] | None = None,
    mode: str = "strict_br",
    lo: float = OUTLIER_LO,
    hi: float = OUTLIER_HI,
    bounds: dict | None = None,
) -> DataFrame:
    """The cleaning job: parse numbers, mask outliers, drop incomplete rows."""
    parsed = parse_locale_numbers(df, mode=mode)
    masked = mask_outliers(parsed, columns, lo, hi, bounds)
    return drop_incomplete(evaluated_once(masked))


def evaluated_once(df: DataFrame) -> DataFrame:
    """``df`` behind a one-row generator: a later filter is not pushed below
    it, so the parse and the mask run once per row and not once more inside
    the filter."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    return df.select(F.inline(F.array(row)))


def _within(c: Column, lo: float, hi: float) -> Column:
    # null and NaN are never valid
    return c.isNotNull() & ~F.isnan(c) & (c >= F.lit(lo)) & (c <= F.lit(hi))


def range_valid(df: DataFrame, rules: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows whose every ruled value lies inside its inclusive limits."""
    rules = RANGE_LIMITS if rules is None else rules
    cond = F.lit(True)
    for c, (lo, hi) in rules.items():
        cond = cond & _within(F.col(f"`{c}`").cast("double"), lo, hi)
    return df.filter(cond)


def range_violations(
    df: DataFrame,
    key_cols: list[str],
    rules: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """One row per (row, broken rule): key, rule, value, lo, hi.

    Each row builds an array of the rules it breaks and the array is
    exploded, so the work stays inside one codegen'd map stage; no shuffle.
    """
    rules = RANGE_LIMITS if rules is None else rules
    items = []
    for c, (lo, hi) in rules.items():
        v = F.col(f"`{c}`").cast("double")
        items.append(
            F.when(
                ~_within(v, lo, hi),
                F.struct(
                    F.lit(c).alias("rule"),
                    v.alias("value"),
                    F.lit(float(lo)).alias("lo"),
                    F.lit(float(hi)).alias("hi"),
                ),
            )
        )
    broken = F.filter(F.array(*items), lambda s: s.isNotNull())
    return (
        df.select(*[F.col(f"`{k}`") for k in key_cols], F.explode(broken).alias("v"))
        .select(*key_cols, "v.rule", "v.value", "v.lo", "v.hi")
    )


def fill_missing_features(
    df: DataFrame, features: list[str], default: float = 0.0
) -> DataFrame:
    """Add absent feature columns as a neutral constant."""
    missing = [c for c in features if c not in df.columns]
    if not missing:
        return df
    return df.withColumns({c: F.lit(float(default)) for c in missing})
