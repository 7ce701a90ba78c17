"""Write frames to tables: create, append, overwrite, aligned by column name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import column, parse_cell
from ..operators.layout import (
    Transform,
    add_partition_columns,
    drop_partition_columns,
    spread_by_partition,
)
from .catalog import (
    quoted,
    remember_transforms,
    resolve_table,
    table_exists,
    table_transforms,
)
from .overwrite import finish_replacement, replace_table

# Sources whose catalog commits an overwrite as one snapshot.
_SNAPSHOT_SOURCES = ("iceberg", "delta")


def align_to_table(df: DataFrame, target: T.StructType) -> DataFrame:
    """The frame in the target's column order and types, matched by name.

    A target column the frame lacks is null; a frame column the target lacks is an error. A
    value that does not fit the target type becomes null.
    """
    supplied = {f.name.lower(): f for f in df.schema}
    unknown = set(supplied) - {f.name.lower() for f in target}
    if unknown:
        raise ValueError(f"columns not in the target table: {sorted(unknown)}")
    out = []
    for f in target:
        source = supplied.get(f.name.lower())
        if source is None:
            value = F.lit(None).cast(f.dataType)
        elif source.dataType == f.dataType:
            value = column(source.name)
        elif isinstance(source.dataType, T.StringType):
            value = parse_cell(column(source.name), f.dataType)
        else:
            value = column(source.name).try_cast(f.dataType)
        out.append(value.alias(f.name))
    return df.select(out)


def _laid_out(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    return spread_by_partition(add_partition_columns(df, transforms), transforms)


def _create_filled(
    df: DataFrame,
    name: str,
    using: str,
    transforms: Sequence[Transform],
    max_records_per_file: int | None,
    mode: str = "errorifexists",
) -> None:
    writer = _laid_out(df, transforms).write.format(using).mode(mode)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if transforms:
        writer = writer.partitionBy(*[t.partition_column for t in transforms])
    writer.saveAsTable(quoted(name))
    remember_transforms(df.sparkSession, name, transforms)


def _append(
    df: DataFrame, name: str, transforms: Sequence[Transform], max_records_per_file: int | None
) -> None:
    spark = df.sparkSession
    derived = add_partition_columns(df, transforms)
    aligned = align_to_table(derived, spark.table(quoted(name)).schema)
    writer = spread_by_partition(aligned, transforms).write
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.insertInto(quoted(name))


def write_table(
    df: DataFrame,
    table: str,
    *,
    mode: str = "append",
    transforms: Sequence[Transform] = (),
    replace_schema: bool = True,
    max_records_per_file: int | None = None,
    using: str | None = None,
) -> None:
    """Write a frame, creating the table when it is missing.

    ``append`` adds rows; transforms given must be the table's. ``overwrite`` leaves exactly this
    frame: with ``replace_schema`` the table is rebuilt, without, it keeps its schema and layout.
    Either way the new rows are complete in a table of their own before they replace the old
    ones, so a failed load leaves the old rows and a frame may read the table it replaces; a
    replacement that a crash cuts off is finished by the next use of the table (``overwrite``).
    Provider (unless ``using`` is given), comments, properties and the folder survive. One Spark
    job writes all rows; an overwrite of a folder of the user's choice takes another.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode must be append or overwrite, not {mode!r}")
    spark = df.sparkSession
    name = resolve_table(spark, table)
    if using in _SNAPSHOT_SOURCES:
        _write_snapshot(df, name, mode, transforms, replace_schema, using)
        return
    finish_replacement(spark, name)
    if not table_exists(spark, name):
        _create_filled(df, name, using or "parquet", transforms, max_records_per_file)
    elif mode == "append" or not replace_schema:
        kept = table_transforms(spark, name)
        if transforms and list(transforms) != kept:
            raise ValueError(
                f"{name} is laid out by {[str(t) for t in kept]}, not {[str(t) for t in transforms]}"
            )
        if mode == "append":
            _append(df, name, kept, max_records_per_file)
        else:
            target = drop_partition_columns(spark.table(quoted(name)), kept).schema
            replace_table(align_to_table(df, target), name, None, kept, max_records_per_file)
    else:
        replace_table(df, name, using, transforms, max_records_per_file)


def _write_snapshot(
    df: DataFrame,
    name: str,
    mode: str,
    transforms: Sequence[Transform],
    replace_schema: bool,
    using: str,
) -> None:
    """Table formats with snapshots and native transforms need neither derived columns nor a
    staging table."""
    spark = df.sparkSession
    exists = table_exists(spark, name)
    if exists and (mode == "append" or not replace_schema):
        writer = align_to_table(df, spark.table(quoted(name)).schema).writeTo(quoted(name))
        writer.append() if mode == "append" else writer.overwrite(F.lit(True))
        return
    native = {
        "identity": lambda t: column(t.column),
        "year": lambda t: F.partitioning.years(column(t.column)),
        "month": lambda t: F.partitioning.months(column(t.column)),
        "day": lambda t: F.partitioning.days(column(t.column)),
        "bucket": lambda t: F.partitioning.bucket(t.width, column(t.column)),
    }
    parts = []
    for t in transforms:
        if t.kind not in native:
            raise ValueError(f"{using} tables take no {t.kind} transform from a frame writer")
        parts.append(native[t.kind](t))
    writer = df.writeTo(quoted(name)).using(using)
    if parts:
        writer = writer.partitionedBy(*parts)
    writer.createOrReplace()


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """A table without its derived partition columns."""
    name = resolve_table(spark, table)
    finish_replacement(spark, name)
    return drop_partition_columns(spark.table(quoted(name)), table_transforms(spark, name))


def file_stats(spark: SparkSession, table: str) -> DataFrame:
    """One row on the files behind a table: how many, their rows and bytes."""
    rows = spark.table(quoted(resolve_table(spark, table)))
    per_file = rows.groupBy(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count("*").alias("rows"))
    return per_file.agg(
        F.count("*").alias("files"),
        F.sum("rows").alias("total_rows"),
        F.avg("rows").alias("avg_rows"),
        F.max("rows").alias("max_rows"),
        F.sum("bytes").alias("total_bytes"),
    )
