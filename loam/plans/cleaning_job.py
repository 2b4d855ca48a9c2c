"""The cleaning job end to end (S1, S2, C1-C4, S4): read every CSV of a
folder (or one file), harmonise names, parse locale numbers, mask
outliers, drop incomplete rows, report the counts and write the result as
the next numbered version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.functions import cleaning
from loam.schema import canonicalize_columns
from loam.sources import files


def run(spark: SparkSession, source: str, out_base: str, mode: str = "strict_br",
        prefix: str = "cleaned_v") -> dict:
    """Returns the output path, version, and the before/after row counts."""
    if files.is_folder(spark, source):
        # every layout gets its canonical names before the layouts meet
        df = files.read_csv_folder(spark, source, rename=canonicalize_columns).drop("source_file")
    else:
        df = canonicalize_columns(files.read_csv(spark, source))
    parsed = cleaning.parse_locale_numbers(df, mode=mode)
    masked = cleaning.evaluated_once(cleaning.mask_outliers(parsed))
    report = cleaning.cleaning_report(masked).first().asDict()
    cleaned: DataFrame = cleaning.drop_incomplete(masked)
    path, version = files.write_versioned(cleaned, out_base, prefix=prefix)
    return {"path": path, "version": version, **report}
