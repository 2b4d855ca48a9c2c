"""Canonical schema of the soil table and column-name harmonising.

Raw headers carry dots, spaces, accents and trailing blanks, which neither
unquoted SQL nor ``VectorAssembler`` accept, so every job renames to the
canonical names first and all later code assumes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Canonical feature names in the order the models use them,
# and the canonical target name.
FEATURES = [
    "p25_4",
    "p9_5",
    "p4_8",
    "p2_0",
    "p0_42",
    "p0_076",
    "ll",
    "ip",
    "w_opt",
    "d_max",
]
TARGET = "cbr"

# Display labels for the features (importance tables).
FEATURE_LABELS = {
    "p25_4": "25.4mm (IG)",
    "p9_5": "9.5mm (EXP)",
    "p4_8": "4.8mm (D3)",
    "p2_0": "2.0mm (D4)",
    "p0_42": "0.42mm (D5)",
    "p0_076": "0.076mm (D6)",
    "ll": "LL",
    "ip": "IP",
    "w_opt": "Umidade Ótima (CH)",
    "d_max": "Densidade máxima (CY)",
}

# Header spellings that must resolve to each canonical name.
# The first block is the shipped CSV header (after trimming), the second the
# known alias spellings, in the order they are listed for the source data.
HEADER_NAMES = {
    "25.4mm": "p25_4",
    "9.5mm": "p9_5",
    "4.8mm": "p4_8",
    "2.0mm": "p2_0",
    "0.42mm": "p0_42",
    "0.076mm": "p0_076",
    "LL": "ll",
    "IP": "ip",
    "Umidade Ótima": "w_opt",
    "Densidade máxima": "d_max",
    "CBR": "cbr",
}
ALIASES = {
    "25,4mm": "p25_4",
    "9,5mm": "p9_5",
    "4,8mm": "p4_8",
    "2,0mm": "p2_0",
    "0,42mm": "p0_42",
    "0,076mm": "p0_076",
    "P25.4": "p25_4",
    "P9.5": "p9_5",
    "P4.8": "p4_8",
    "P2.0": "p2_0",
    "P0.42": "p0_42",
    "P0.076": "p0_076",
    "Ll": "ll",
    "ll": "ll",
    "L.L": "ll",
    "L.L.": "ll",
    "Limite de Liquidez": "ll",
    "Ip": "ip",
    "ip": "ip",
    "I.P": "ip",
    "I.P.": "ip",
    "Índice de Plasticidade": "ip",
    "Indice de Plasticidade": "ip",
    "Wot": "w_opt",
    "wot": "w_opt",
    "W_ot": "w_opt",
    "Umidade otima": "w_opt",
    "Umidade Otima": "w_opt",
    "Umidade ótima": "w_opt",
    "w_ot": "w_opt",
    "Densidade Maxima": "d_max",
    "Densidade Máxima": "d_max",
    "densidade máxima": "d_max",
    "densidade maxima": "d_max",
    "d_max": "d_max",
    "Dmax": "d_max",
    "γdmax": "d_max",
    "ydmax": "d_max",
    "CBR": "cbr",
    "cbr": "cbr",
    "Cbr": "cbr",
}

SOIL_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType(), True) for c in FEATURES + [TARGET]]
)


class MissingColumnsError(ValueError):
    """Required columns are absent after renaming."""

    def __init__(self, missing: list[str], actual: list[str]):
        self.missing = missing
        self.actual = actual
        super().__init__(
            f"missing columns {missing}; columns present after renaming: {actual}"
        )


class AliasClashError(ValueError):
    """Two input columns resolve to the same canonical name."""


def canonical_name_map(extra: dict | None = None) -> dict[str, str]:
    m = dict(HEADER_NAMES)
    m.update(ALIASES)
    if extra:
        m.update(extra)
    return m


def canonicalize_columns(df: DataFrame, extra_aliases: dict | None = None) -> DataFrame:
    """Trim header names (P1) and map known spellings to canonical names.

    Pure projection (``toDF``): no data is touched. Unknown names are kept
    as trimmed. Raises :class:`AliasClashError` if two columns would get
    the same name.
    """
    mapping = canonical_name_map(extra_aliases)
    new_names = [mapping.get(c.strip(), c.strip()) for c in df.columns]
    seen: dict[str, str] = {}
    for old, new in zip(df.columns, new_names):
        if new in seen:
            raise AliasClashError(
                f"columns {seen[new]!r} and {old!r} both resolve to {new!r}"
            )
        seen[new] = old
    return df.toDF(*new_names)


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail with the missing and the actual names."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(missing, list(df.columns))
    return df


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column projection in the given order."""
    require_columns(df, columns)
    return df.select(*columns)


def drop_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Drop the target column and keep the other names (P5)."""
    return df.drop(target)


def to_soil_table(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Canonicalise, check and project to key columns + 10 features + target,
    all features as double (density arrives as int in the source)."""
    df = canonicalize_columns(df)
    keys = list(key_cols or [])
    require_columns(df, keys + FEATURES + [TARGET])
    return df.select(
        *keys, *[df[c].cast("double").alias(c) for c in FEATURES + [TARGET]]
    )
