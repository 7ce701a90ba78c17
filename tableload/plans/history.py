"""Append load updates to the history table, and keep it short.

The table is partitioned by generation. Updates are appended to the open generation, whose number
is a table property. Retention closes it by opening the next one and rewrites only what is closed,
so updates appended meanwhile are in a partition that it does not touch.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import UPDATE_SCHEMA, job_states, retained_jobs
from ..operators.layout import Transform
from ..sinks.catalog import (
    create_table,
    quoted,
    resolve_table,
    set_properties,
    table_exists,
    table_properties,
)
from ..sinks.overwrite import finish_replacement
from ..sinks.table import write_table
from ..streaming.compaction import BATCH_COLUMN, live_rows, merge_batches

OPEN_PROPERTY = "tableload.open_generation"


def _step(done: str) -> None:
    """Called between the steps of appending and retention; tests act here."""


def _text(value) -> str | None:
    if isinstance(value, bool):
        return str(value).lower()
    return None if value is None else str(value)


class JobLog:
    """Writes one job's updates; each is one appended row."""

    def __init__(self, spark: SparkSession, table: str, job_id: str) -> None:
        self._spark, self._table, self._job_id = spark, table, job_id
        self._seq = 0

    def _append(self, kind: str, **fields) -> None:
        self._seq += 1
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        texts = {k: _text(v) for k, v in fields.items()}
        row = [(self._job_id, now, self._seq, kind, texts)]
        update = self._spark.createDataFrame(row, UPDATE_SCHEMA).coalesce(1)
        append_updates(update, self._table)

    def create(self, **fields) -> None:
        self._append("create", status="pending", **fields)

    def update(self, **fields) -> None:
        self._append("update", **fields)

    def progress(self, percent: int) -> None:
        self._append("progress", progress=percent)

    def complete(self, success: bool, **fields) -> None:
        given = {k: v for k, v in fields.items() if v is not None}
        self._append("complete", status="completed" if success else "failed", **given)


def _has_generations(spark: SparkSession, name: str) -> bool:
    return BATCH_COLUMN in spark.table(quoted(name)).columns


def _create(spark: SparkSession, name: str) -> None:
    empty = spark.createDataFrame([], UPDATE_SCHEMA).schema
    schema = T.StructType([*empty, T.StructField(BATCH_COLUMN, T.LongType())])
    create_table(spark, name, schema, transforms=[Transform(BATCH_COLUMN)])


def _open_generation(spark: SparkSession, name: str) -> int:
    return int(table_properties(spark, name).get(OPEN_PROPERTY, 0))


def append_updates(updates: DataFrame, table: str) -> None:
    """Append updates (``UPDATE_SCHEMA``) to a history table, creating it when it is missing.

    If the generation written to was closed before the write was over, retention may have passed
    the rows over, so they are appended to the one open now as well. An update that is there
    twice changes no state."""
    spark = updates.sparkSession
    name = resolve_table(spark, table)
    finish_replacement(spark, name)
    if not table_exists(spark, name):
        _create(spark, name)
    if not _has_generations(spark, name):  # a history kept before there were generations
        write_table(updates, name)
        return
    written = None
    while written != (generation := _open_generation(spark, name)):
        _step("opened")
        rows = updates.withColumn(BATCH_COLUMN, F.lit(generation).cast("bigint"))
        target = spark.table(quoted(name)).columns
        rows.select(target).write.insertInto(quoted(name))
        written = generation
        _step("appended")


def load_history(spark: SparkSession, table: str) -> DataFrame:
    """All updates of a history table, empty when nothing was recorded yet."""
    name = resolve_table(spark, table)
    finish_replacement(spark, name)
    if not table_exists(spark, name):
        return spark.createDataFrame([], UPDATE_SCHEMA)
    if not _has_generations(spark, name):
        return spark.table(quoted(name))
    return live_rows(spark, name).drop(BATCH_COLUMN)


def apply_retention(spark: SparkSession, table: str, now, **limits) -> None:
    """Keep only the updates of retained jobs among those recorded so far.

    The open generation is closed first. All closed ones are then merged into one, which also
    merges the many single-row files that appends leave behind; setting a property commits that,
    and a retention that fails before or after can be repeated. Updates appended meanwhile go to
    the next generation and stay. At most ``keep`` job ids survive, so the semi join's small side
    has a fixed bound. One retention of a table may run at a time.
    """
    name = resolve_table(spark, table)
    finish_replacement(spark, name)
    if not table_exists(spark, name):
        return
    if not _has_generations(spark, name):
        updates = load_history(spark, name)
        keyed = updates.withColumn(BATCH_COLUMN, F.lit(0).cast("bigint"))
        write_table(keyed, name, mode="overwrite", transforms=[Transform(BATCH_COLUMN)])
    closing = _open_generation(spark, name)
    set_properties(spark, name, {OPEN_PROPERTY: str(closing + 1)})
    _step("closed")
    spark.catalog.refreshTable(quoted(name))
    updates = load_history(spark, name)
    kept = retained_jobs(job_states(updates), now, **limits).select("job_id")

    def retained(rows: DataFrame) -> DataFrame:
        return rows.join(kept, "job_id", "left_semi").select(rows.columns)

    merge_batches(spark, name, through=closing, fold=retained)
