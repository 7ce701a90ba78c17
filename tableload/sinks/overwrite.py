"""Replace a table's rows so that a crash at any point leaves the old table or the new one.

The new rows are written into a table of their own beside the old one, with its comments and
properties, and a property on that table is the commit. From then on the steps that are left (drop
the old table, give its name to the new one, take the rows to the folder the user chose) can be
repeated, and whatever reads or writes the table through this library repeats them first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions.cells import column
from ..operators.layout import Transform, add_partition_columns, spread_by_partition
from ..session import scratch_database
from .catalog import (
    TRANSFORMS_PROPERTY,
    comment_on,
    drop_table,
    quoted,
    quoted_part,
    remember_transforms,
    set_properties,
    sql_text,
    table_details,
    table_exists,
    table_properties,
)

REPLACES = "tableload.replaces"  # set on the new table: it is complete
HOME = "tableload.home"  # the folder of the user's choice that the rows go back to
VERSION = "tableload.version"  # the folder they are in until then


def _step(done: str) -> None:
    """Called after each step; tests stop a replacement here."""


def next_table(name: str) -> str:
    """The table that will take the name."""
    return f"{name}__tableload_next"


def _with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """The frame with the columns' comments; its own win."""
    out = []
    for f in df.schema:
        told = comments.get(f.name.lower())
        kept = {**({"comment": told} if told else {}), **f.metadata}
        out.append(column(f.name).alias(f.name, metadata=kept) if kept else column(f.name))
    return df.select(out)


def replace_table(
    df: DataFrame,
    name: str,
    using: str | None,
    transforms: Sequence[Transform],
    max_records_per_file: int | None,
) -> None:
    """Put the frame's rows and columns in the place of the table ``name``.

    Kept are the provider (unless ``using``), whether dropping the table removes its files, the
    comments of the table and of columns that stay, the properties, and a folder of the user's
    choice: such a table's rows are written a second time, into that folder, after the commit.
    """
    spark = df.sparkSession
    old = table_details(spark, name)
    comments = {
        f.name.lower(): f.metadata["comment"]
        for f in spark.table(quoted(name)).schema
        if f.metadata.get("comment")
    }
    properties = table_properties(spark, name)
    new = next_table(name)
    drop_table(spark, new)  # left by a replacement that failed before its commit
    laid_out = add_partition_columns(df, transforms)
    laid_out = spread_by_partition(_with_comments(laid_out, comments), transforms)
    writer = laid_out.write.format(using or old.provider).mode("overwrite")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if transforms:
        writer = writer.partitionBy(*[t.partition_column for t in transforms])
    if old.managed:
        database, table = new.split(".")[-2:]
        folder = f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{table}"
    else:
        folder = f"{old.location.rstrip('/')}__tableload_next"
        writer = writer.option("path", folder)
        properties |= {HOME: old.location, VERSION: folder}
    try:
        writer.saveAsTable(quoted(new))
    except PySparkException as error:
        if error.getCondition() != "LOCATION_ALREADY_EXISTS":
            raise
        remove_folder(spark, folder)  # files of a replacement that failed while it wrote
        writer.saveAsTable(quoted(new))
    _step("written")
    if old.comment:
        comment_on(spark, new, old.comment)
    set_properties(spark, new, {k: v for k, v in properties.items() if k != TRANSFORMS_PROPERTY})
    remember_transforms(spark, new, transforms)
    _step("described")
    set_properties(spark, new, {REPLACES: name})
    _step("committed")
    finish_replacement(spark, name)


def finish_replacement(spark: SparkSession, name: str) -> None:
    """Do what a committed replacement of ``name`` has left to do, if any."""
    new = next_table(name)
    if table_exists(spark, new) and REPLACES in table_properties(spark, new):
        drop_table(spark, name)
        _step("dropped")
        two_parts = ".".join(quoted(name).split(".")[-2:])
        spark.sql(f"ALTER TABLE {quoted(new)} RENAME TO {two_parts}")
        _step("renamed")
    if not table_exists(spark, name):
        return
    properties = table_properties(spark, name)
    if REPLACES not in properties:
        return
    spark.catalog.refreshTable(quoted(name))
    partitions = [c.name for c in spark.catalog.listColumns(quoted(name)) if c.isPartition]
    if HOME in properties:
        _take_home(spark, name, properties[HOME], properties[VERSION], partitions)
    elif partitions:
        _find_partitions(spark, name)
    _step("placed")
    names = ", ".join(sql_text(p) for p in (REPLACES, HOME, VERSION) if p in properties)
    spark.sql(f"ALTER TABLE {quoted(name)} UNSET TBLPROPERTIES ({names})")
    spark.catalog.refreshTable(quoted(name))


def _find_partitions(spark: SparkSession, name: str) -> None:
    """Partitions of the folder the table is in; those of other folders are forgotten."""
    spark.sql(f"MSCK REPAIR TABLE {quoted(name)} SYNC PARTITIONS")


def _take_home(
    spark: SparkSession, name: str, home: str, version: str, partitions: list[str]
) -> None:
    """Write the rows of the folder ``version`` to ``home`` and let the table be there. The table
    reads from ``version`` until that is complete."""
    here = table_details(spark, name)
    if here.location.rstrip("/") != home.rstrip("/"):
        rows = spark.table(quoted(name))
        if partitions:
            rows = rows.hint("rebalance", *[column(p) for p in partitions])
        writer = rows.write.format(here.provider).mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).save(home)
        _step("copied")
        spark.sql(f"ALTER TABLE {quoted(name)} SET LOCATION {sql_text(home)}")
        _step("home")
    remove_folder(spark, version)
    _step("removed")
    if partitions:
        _find_partitions(spark, name)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system: a table that owns it is dropped."""
    database = scratch_database(spark)
    gone = f"{database}.gone"
    try:
        spark.sql(f"CREATE TABLE {gone} (id BIGINT) USING parquet")
        spark.sql(f"ALTER TABLE {gone} SET LOCATION {sql_text(path)}")
        drop_table(spark, gone)
    finally:
        spark.sql(f"DROP DATABASE {quoted_part(database)} CASCADE")
