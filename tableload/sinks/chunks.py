"""Expected output files of a frame, by stored bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import as_text, column

FILE_BYTES = 128 << 20

_WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
}


def _cell_bytes(field: T.StructField) -> Column:
    cell = column(field.name)
    width = _WIDTHS.get(type(field.dataType))
    size = F.octet_length(as_text(cell, field.dataType)) if width is None else F.lit(width)
    return F.when(cell.isNotNull(), size).otherwise(0)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values before encoding and compression; nulls take none."""
    total = F.lit(0).cast("bigint")
    for f in df.schema:
        total = total + _cell_bytes(f)
    return total


def file_sizing(rows: Column, size: Column, max_bytes: int = FILE_BYTES) -> list[Column]:
    """``rows_per_chunk`` (what to pass as ``max_records_per_file``) and ``chunks``, so that no
    file holds more than about ``max_bytes``; null and 0 without rows."""
    fitting = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) * rows / size))
    per_file = F.when(rows == 0, None).when(size == 0, rows).otherwise(fitting).cast("bigint")
    return [
        per_file.alias("rows_per_chunk"),
        F.coalesce(F.ceil(rows / per_file), F.lit(0)).cast("bigint").alias("chunks"),
    ]


def chunk_plan(df: DataFrame, *, max_bytes: int = FILE_BYTES) -> DataFrame:
    """One row: total rows and bytes, rows per file of at most ``max_bytes``, and files needed.

    Integer sums keep the result independent of how the input is split. Files are written
    smaller than this, as formats encode and compress.
    """
    totals = df.agg(
        F.count("*").alias("total_rows"),
        F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("total_bytes"),
    )
    rows, size = F.col("total_rows").cast("double"), F.col("total_bytes")
    return totals.select("*", *file_sizing(rows, size, max_bytes))
