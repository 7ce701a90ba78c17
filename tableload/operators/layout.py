"""Physical partition layout: transforms as derived columns, and predicates that prune them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import column

_TEXT_FORM = re.compile(r"(?:(\w+)\((?:(\d+),\s*)?(.+?)(?:,\s*(\d+))?\)|(.+))\Z", re.DOTALL)
_SUFFIXES = {
    "year": "year",
    "month": "month",
    "day": "day",
    "bucket": "bucket",
    "truncate": "trunc",
}


@dataclass(frozen=True)
class Transform:
    """How one source column becomes a partition value."""

    column: str
    kind: str = "identity"
    width: int | None = None

    def __post_init__(self) -> None:
        if self.kind != "identity" and self.kind not in _SUFFIXES:
            raise ValueError(f"unknown partition transform {self.kind!r}")
        if self.kind in ("bucket", "truncate") and not self.width:
            raise ValueError(f"{self.kind} needs a width")

    @property
    def partition_column(self) -> str:
        """Name of the column the table is partitioned by."""
        return self.column if self.kind == "identity" else f"{self.column}_{_SUFFIXES[self.kind]}"

    def __str__(self) -> str:
        if self.kind == "identity":
            return self.column
        if self.kind == "bucket":
            return f"bucket({self.width}, {self.column})"
        if self.kind == "truncate":
            return f"truncate({self.column}, {self.width})"
        return f"{self.kind}({self.column})"


def parse_transform(text: str) -> Transform:
    """``month(ts)``, ``bucket(10, id)``, ``truncate(name, 5)`` or a bare column name."""
    kind, first, name, last, bare = _TEXT_FORM.match(text.strip()).groups()
    if bare or kind not in _SUFFIXES:
        return Transform(text.strip())
    width = first or last
    return Transform(name.strip(), kind, int(width) if width else None)


# Day first where both readings of a text are dates.
_TEXT_DATES = ("dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "MM-dd-yyyy")


def text_date(value: Column) -> Column:
    """The date a text holds, year first or last, or null. Of day and month at the front, the
    day comes first unless that is no date."""
    iso = F.translate(value, "/", "-").try_cast("date")
    others = [F.try_to_timestamp(value, F.lit(form)).cast("date") for form in _TEXT_DATES]
    return F.coalesce(F.when(value.rlike(r"^\d{4}[-/]\d"), iso), *others)


def partition_value(transform: Transform, value: Column, data_type: T.DataType) -> Column:
    """The partition value of a source value; null for text that holds no date where one is
    needed."""
    kind, width = transform.kind, transform.width
    if kind in ("year", "month", "day") and isinstance(data_type, T.StringType):
        value = text_date(value)
    if kind == "year":
        return F.year(value)
    if kind == "month":
        return F.substring(F.to_date(value).cast("string"), 1, 7)
    if kind == "day":
        return F.to_date(value)
    if kind == "bucket":
        return F.pmod(F.hash(value), F.lit(width))
    if kind == "truncate":
        if isinstance(data_type, T.StringType):
            return F.substring(value, 1, width)
        return value - F.pmod(value, F.lit(width))
    return value


def add_partition_columns(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    """The frame plus one derived column per transform that is not identity."""
    types = {f.name: f.dataType for f in df.schema}
    added = []
    for t in transforms:
        if t.column not in types:
            raise ValueError(f"no column {t.column!r} to partition by")
        if t.kind == "identity":
            continue
        if t.partition_column in types:
            raise ValueError(f"column {t.partition_column!r} already exists")
        derived = partition_value(t, column(t.column), types[t.column])
        added.append(derived.alias(t.partition_column))
    return df.select("*", *added) if added else df


def spread_by_partition(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    """Bring each partition's rows together before a partitioned write.

    The rebalance hint lets adaptive execution split a partition value that holds a large share
    of the rows over several tasks and merge tiny ones, which a plain repartition would not.
    """
    names = [t.partition_column for t in transforms]
    return df.hint("rebalance", *[column(n) for n in names]) if names else df


def drop_partition_columns(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    """The frame without its derived columns."""
    return df.drop(*[t.partition_column for t in transforms if t.kind != "identity"])


def prune_on(df: DataFrame, name: str, low, high, transforms: Sequence[Transform]) -> DataFrame:
    """Rows with ``low <= name < high``, plus the matching predicates on derived columns.

    The source predicate alone reads every partition; the derived ones let Spark skip them. A
    bucket prunes only when it covers a single value, so ranges leave buckets alone. Text sorts
    otherwise than the dates it holds, so ranges leave the dates of text alone as well.
    """
    data_type = df.schema[name].dataType
    lo, hi = F.lit(low).cast(data_type), F.lit(high).cast(data_type)
    out = df.where((column(name) >= lo) & (column(name) < hi))
    for t in transforms:
        dated_text = t.kind != "truncate" and isinstance(data_type, T.StringType)
        if t.column == name and t.kind not in ("identity", "bucket") and not dated_text:
            part = column(t.partition_column)
            out = out.where(
                (part >= partition_value(t, lo, data_type))
                & (part <= partition_value(t, hi, data_type))
            )
    return out


def prune_equal(df: DataFrame, name: str, value, transforms: Sequence[Transform]) -> DataFrame:
    """Rows with ``name = value``, plus the matching predicate on every derived column."""
    data_type = df.schema[name].dataType
    wanted = F.lit(value).cast(data_type)
    out = df.where(column(name) == wanted)
    for t in transforms:
        if t.column == name and t.kind != "identity":
            out = out.where(
                column(t.partition_column).eqNullSafe(partition_value(t, wanted, data_type))
            )
    return out
