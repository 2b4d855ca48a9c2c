"""Scoring of arriving samples with Structured Streaming.

The stream runs the very same :func:`loam.plans.scoring.score` as batch
input: every step is stateless (range rules, features, scaling, model,
inverse transform, alert), so no watermark or state store is needed and
each micro-batch is independent. Rejected rows go to their own sink with
the broken rule, instead of a console prompt asking again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loam.plans import scoring
from loam.sources.artifacts import Artifacts


def sample_stream(spark: SparkSession, path: str, schema: T.StructType,
                  fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Arriving sample files as a stream (explicit schema: a stream cannot
    infer one)."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def start_scoring(stream: DataFrame, art: Artifacts, key_cols: list[str], out_path: str,
                  checkpoint: str, rejected_path: str | None = None,
                  available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """Score every micro-batch and write predictions (and rejections) under
    ``<out>/batch=<id>``.

    ``foreachBatch`` lets each micro-batch use the batch scorer unchanged
    and write two outputs; the checkpoint folder makes the query restart
    where it stopped after a failure.
    """

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch id, overwritten on replay: a batch re-run after
        # a failure replaces its own output instead of appending it twice
        batch = batch.persist()
        scoring.score(batch, art, key_cols).write.mode("overwrite").format(fmt) \
            .save(f"{out_path}/batch={batch_id}")
        if rejected_path:
            scoring.rejected(batch, art, key_cols).write.mode("overwrite").format(fmt) \
                .save(f"{rejected_path}/batch={batch_id}")
        batch.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def table_stream(spark: SparkSession, folder: str, file_glob: str,
                 schema: T.StructType | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Files of one table in ``folder`` (``file_glob``) as a stream; the
    schema is taken from the current files when not given."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def run_stateless(stream: DataFrame, transform, out_path: str, checkpoint: str,
                  available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """Apply a batch transform to every micro-batch and append the result.

    The transform is the same function the batch path uses, so batch and
    stream results agree by construction; the checkpoint makes restarts
    resume from the last committed batch.
    """

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # idempotent per batch id (see start_scoring)
        transform(batch).write.mode("overwrite").format(fmt).save(f"{out_path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
