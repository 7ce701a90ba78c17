"""Keep current job states up to date from a stream of job updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import JOB_FIELDS, latest_fields
from ..operators.layout import Transform
from ..sinks.catalog import create_table, resolve_table, table_exists
from .compaction import BATCH_COLUMN, live_rows, merge_batches, merged_batch
from .ingest import replace_batch


def follow_job_states(
    updates: DataFrame,
    table: str,
    checkpoint: str,
    *,
    fields: Sequence[str] = JOB_FIELDS,
) -> None:
    """Fold all new updates of a stream into a log of changed job states, then stop.

    Spark's state store keeps one row per job; each micro-batch writes only jobs that changed.
    """
    spark = updates.sparkSession
    name = resolve_table(spark, table)
    states = latest_fields(updates, fields)
    if not table_exists(spark, name):
        full = T.StructType([*states.schema, T.StructField(BATCH_COLUMN, T.LongType())])
        create_table(spark, name, full, transforms=[Transform(BATCH_COLUMN)])
    (
        states.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: replace_batch(batch, batch_id, name))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def followed_states(spark: SparkSession, table: str) -> DataFrame:
    """The newest state per job from the log."""
    return _newest(live_rows(spark, table))


def merge_job_states(spark: SparkSession, table: str, *, keep: int = 1) -> int:
    """Shorten the log to one row per job, but for the newest ``keep`` batches; returns how many
    batches were merged. Reading then costs by jobs and recent batches, not by all updates."""
    return merge_batches(spark, table, keep=keep, fold=_newest)


def _newest(log: DataFrame) -> DataFrame:
    """One row per job; a merge is as new as the last batch in it."""
    names = [c for c in log.columns if c not in ("job_id", BATCH_COLUMN)]
    batch = F.col(BATCH_COLUMN)
    age = F.when(batch < 0, merged_batch(batch)).otherwise(batch)
    newest = log.groupBy("job_id").agg(F.max_by(F.struct(*names), age).alias("state"))
    return newest.select("job_id", "state.*")
