"""Incremental, restartable loads of a growing directory of delimited text."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import column
from ..operators.columns import chosen_columns
from ..operators.layout import (
    Transform,
    add_partition_columns,
    drop_partition_columns,
    spread_by_partition,
)
from ..operators.profile import merge_sketches, profile_of_sketches, profile_sketches
from ..operators.schema import (
    apply_schema,
    apply_schema_observed,
    rejected_counts,
    rounded_counts,
)
from ..plans.load import prepare
from ..session import path_exists
from ..sinks.catalog import create_table, quoted, resolve_table, table_exists, table_transforms
from ..sources.csv import INPUT_GLOB, Dialect, header_names, read_text, text_schema
from .compaction import BATCH_COLUMN, live_rows, merge_batches


@dataclass
class IngestResult:
    """What one run of an ingest added; the counts are those of a load."""

    rows: int = 0
    batches: int = 0
    rejected: dict[str, int] = field(default_factory=dict)
    rounded: dict[str, int] = field(default_factory=dict)
    ragged: int = 0
    merged: int = 0


# What a stream of files tells of each; the content is never read.
_FILES = "path string, modificationTime timestamp, length long, content binary"
_RAGGED = "__ragged"


class _Agreed(NamedTuple):
    """What the first run fixes: the header's names, whether other headers can be compared with
    them, the columns loaded (name in the header, name in the table) and their schema."""

    names: list[str]
    checked: bool
    columns: list[tuple[str, str]]
    schema: T.StructType


def _stored_schema(spark: SparkSession, path: str) -> _Agreed | None:
    # The marker appears only once the schema is completely written.
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return None
    content = json.loads(spark.read.text(path).head()["value"])
    names = content["names"]
    columns = [tuple(c) for c in content.get("columns", [(n, n) for n in names])]
    schema = T.StructType.fromJson(content["schema"])
    # Stored before columns were: the names are the table's, so headers cannot be compared.
    checked = content.get("checked", False) and "columns" in content
    return _Agreed(names, checked, columns, schema)


def _agreed_schema(
    spark: SparkSession,
    directory: str,
    checkpoint: str,
    dialect: Dialect,
    schema: T.StructType | str | None,
    **options,
) -> _Agreed:
    """The names, columns and types fixed by the first run and stored beside the checkpoint."""
    path = checkpoint.rstrip("/") + "-schema"
    stored = _stored_schema(spark, path)
    if stored:
        return stored
    names, checked = header_names(spark, directory, dialect, path_glob=INPUT_GLOB)
    text, load_schema, _ = prepare(
        spark,
        directory,
        dialect=dialect,
        schema=schema,
        path_glob=INPUT_GLOB,
        names=names,
        **options,
    )
    chosen = chosen_columns(names, options.get("include"), options.get("exclude"))
    columns = list(zip(chosen, text.columns))
    content = json.dumps(
        {"names": names, "columns": columns, "schema": load_schema.jsonValue(), "checked": checked}
    )
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return _Agreed(names, checked, columns, load_schema)


def _read_files(batch: DataFrame, agreed: _Agreed, dialect: Dialect) -> DataFrame:
    """The text of a micro-batch's files, read as a load reads them."""
    # One row per file, as the source itself lists them on the driver; odd names come twice.
    found = {r["path"] for r in batch.collect()}
    paths = sorted(re.sub(r"([\\*?\[\]{},^])", r"\\\1", path) for path in found)
    read = read_text(
        batch.sparkSession,
        paths,
        dialect,
        names=agreed.names,
        check_header=agreed.checked,
        ragged_flag=_RAGGED,
    )
    return read.select(*[column(a).alias(b) for a, b in agreed.columns], _RAGGED)


def replace_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """Write one micro-batch; safe to repeat, as it replaces only its own batch's partitions.

    The stream's session is its own, so the overwrite mode set here reaches nobody else.
    """
    session = batch.sparkSession
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    stamped = batch.withColumn(BATCH_COLUMN, F.lit(batch_id).cast("bigint"))
    target = session.table(quoted(table)).columns
    stamped.select([column(c) for c in target]).write.insertInto(quoted(table), overwrite=True)


def ingest_dir(
    spark: SparkSession,
    directory: str,
    table: str,
    checkpoint: str,
    *,
    dialect: Dialect = Dialect(),
    schema: T.StructType | str | None = None,
    sample_rows: int | None = None,
    include: str | Iterable[str] | None = None,
    exclude: str | Iterable[str] | None = None,
    transforms: Sequence[Transform] = (),
    max_files_per_batch: int | None = None,
    merge_keep: int | None = None,
    profile_table: str | None = None,
    on_batch: Callable[[IngestResult], None] | None = None,
) -> IngestResult:
    """Load every file the checkpoint has not seen yet, then stop.

    The stream is one of file names; each micro-batch reads its files as ``load_csv`` does, so
    quoted cells may hold newlines and rows with too many or too few cells are counted.
    Restarting after a failure neither loses nor repeats rows. The first run fixes the columns
    (``include``, ``exclude``) and the schema; later cells that do not fit it become null and are counted. A file with another header and a
    null in a required column fail the run; nothing of that micro-batch is stored. ``on_batch``
    sees the running totals after every micro-batch. With ``merge_keep`` the run ends by merging
    the partitions of all batches but the newest ``merge_keep``; read such a table through
    ``read_ingested``. ``profile_table`` keeps each batch's column sketches, so that
    ``ingested_profile`` needs no look at the data.
    """
    name = resolve_table(spark, table)
    agreed = _agreed_schema(
        spark,
        directory,
        checkpoint,
        dialect,
        schema,
        sample_rows=sample_rows,
        include=include,
        exclude=exclude,
    )
    load_schema = agreed.schema
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", INPUT_GLOB)
    if max_files_per_batch:
        files = files.option("maxFilesPerTrigger", max_files_per_batch)
    empty = spark.createDataFrame([], text_schema([b for _, b in agreed.columns]))
    shape = add_partition_columns(apply_schema(empty, load_schema), transforms).schema
    if not table_exists(spark, name):
        full = T.StructType([*shape, T.StructField(BATCH_COLUMN, T.LongType())])
        create_table(spark, name, full, transforms=[Transform(BATCH_COLUMN), *transforms])
    elif BATCH_COLUMN not in spark.table(quoted(name)).columns:
        raise ValueError(f"{name} has no {BATCH_COLUMN} column; ingest needs a table of its own")

    if profile_table:
        profile_table = _profile_table(spark, profile_table, apply_schema(empty, load_schema))

    result = IngestResult()

    def write(batch: DataFrame, batch_id: int) -> None:
        watch = Observation(f"ingest-{uuid.uuid4().hex[:8]}")
        odd = Observation(f"shape-{uuid.uuid4().hex[:8]}")
        text = _read_files(batch, agreed, dialect)
        text = text.observe(odd, F.count_if(F.col(_RAGGED)).alias("ragged")).drop(_RAGGED)
        typed = apply_schema_observed(text, load_schema, watch, enforce_required=True)
        laid_out = spread_by_partition(add_partition_columns(typed, transforms), transforms)
        replace_batch(laid_out, batch_id, name)
        if profile_table:
            stored = batch.sparkSession.table(quoted(name)).where(F.col(BATCH_COLUMN) == batch_id)
            own = stored.select([column(f.name) for f in load_schema])
            replace_batch(profile_sketches(own).coalesce(1), batch_id, profile_table)
        result.rows += watch.get["rows"]
        result.batches += 1
        result.ragged += odd.get["ragged"]
        for key, lost in rejected_counts(watch.get).items():
            result.rejected[key] = result.rejected.get(key, 0) + lost
        for key, lost in rounded_counts(watch.get).items():
            result.rounded[key] = result.rounded.get(key, 0) + lost
        if on_batch:
            on_batch(result)

    (
        files.load(directory)
        .select("path")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    if merge_keep:
        result.merged = merge_batches(spark, name, keep=merge_keep)
    return result


def _profile_table(spark: SparkSession, table: str, rows: DataFrame) -> str:
    name = resolve_table(spark, table)
    if not table_exists(spark, name):
        fields = profile_sketches(rows).schema.fields
        kept = [T.StructField(f.name, f.dataType) for f in fields]
        full = T.StructType([*kept, T.StructField(BATCH_COLUMN, T.LongType())])
        create_table(spark, name, full, transforms=[Transform(BATCH_COLUMN)])
    return name


def ingested_profile(spark: SparkSession, profile_table: str) -> DataFrame:
    """The profile of all batches ingested so far, from their stored sketches: what a profile of
    the whole table by sketches says. Batches are added up, none is read again."""
    return profile_of_sketches(merge_sketches(live_rows(spark, profile_table).drop(BATCH_COLUMN)))


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    """An ingest table's data columns, whether its batches are merged or not."""
    transforms = table_transforms(spark, resolve_table(spark, table))
    return drop_partition_columns(live_rows(spark, table), transforms).drop(BATCH_COLUMN)
