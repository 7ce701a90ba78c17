"""Merge the many small partitions that micro-batches leave behind.

Batches up to some number are merged into one partition, numbered below zero. A table property
says through which batch merging is complete; setting it is the commit. Until then readers see the
batches, from then on the merged partition, and a merge that fails at any point can be repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import column
from ..operators.layout import spread_by_partition
from ..sinks.catalog import quoted, quoted_part, resolve_table, table_properties, table_transforms

# Every row carries the micro-batch that wrote it; replaying a batch replaces its own rows.
BATCH_COLUMN = "load_batch"
MERGED_PROPERTY = "tableload.merged_through"
# Partitions dropped by one statement.
_DROPPED_AT_ONCE = 200


def merged_batch(through: int) -> int:
    """The number of the partition that holds the merge through a batch."""
    return -1 - through


def merged_through(spark: SparkSession, name: str) -> int:
    """The last batch merged; -1 when none was."""
    return int(table_properties(spark, name).get(MERGED_PROPERTY, -1))


def live_rows(spark: SparkSession, table: str) -> DataFrame:
    """The rows that count: of merged batches only their merged copy, of later ones their own.

    The condition is on the partition column, so superseded partitions are not read."""
    name = resolve_table(spark, table)
    through = merged_through(spark, name)
    batch = F.col(BATCH_COLUMN)
    return spark.table(quoted(name)).where((batch > through) | batch.between(merged_batch(through), -1))


def _partitions(spark: SparkSession, name: str) -> list[dict[str, str]]:
    """The partition values of the table, as the catalog keeps them."""
    rows = spark.sql(f"SHOW PARTITIONS {quoted(name)}").collect()
    return [
        {unquote(k): unquote(v) for k, v in (part.split("=", 1) for part in r[0].split("/"))}
        for r in rows
    ]


def _drop(spark: SparkSession, name: str, specs: list[dict[str, str]]) -> None:
    def shown(spec: dict[str, str]) -> str:
        pairs = []
        for key, value in spec.items():
            text = value.replace("\\", "\\\\").replace("'", "\\'")
            null = value == "__HIVE_DEFAULT_PARTITION__"
            pairs.append(f"{quoted_part(key)} = " + ("null" if null else f"'{text}'"))
        return f"PARTITION ({', '.join(pairs)})"

    for at in range(0, len(specs), _DROPPED_AT_ONCE):
        listed = ", ".join(shown(s) for s in specs[at : at + _DROPPED_AT_ONCE])
        spark.sql(f"ALTER TABLE {quoted(name)} DROP IF EXISTS {listed}")


def merge_batches(
    spark: SparkSession,
    table: str,
    *,
    keep: int = 1,
    through: int | None = None,
    fold: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Merge all batches but the newest ``keep`` into one partition; returns how many were merged.
    With ``through`` all up to that number are merged instead, which nothing may write to anymore.

    The newest batch is the only one a restarted stream may replay, so it always keeps a partition
    of its own. Without ``fold``, earlier merges stay as they are and each row is rewritten once.
    ``fold`` maps all rows merged so far to those to keep, such as the newest per key; it then
    replaces the earlier merge. One merge of a table may run at a time; streams may go on writing.
    Readers go through ``live_rows``.
    """
    if keep < 1:
        raise ValueError("the newest batch must stay replaceable: keep at least 1")
    name = resolve_table(spark, table)
    before = merged_through(spark, name)
    found = _partitions(spark, name)
    numbers = {int(spec[BATCH_COLUMN]) for spec in found}
    # Left by a merge that failed after its commit, or before it.
    stale = [n for n in numbers if 0 <= n <= before or n < merged_batch(before)]
    chosen = sorted(n for n in numbers if n > before)
    again = False  # fold earlier merges though no batch is new
    if through is None:
        chosen = chosen[:-keep]
        through = chosen[-1] if chosen else before
    else:
        chosen = [n for n in chosen if n <= through]
        again = through > before and any(merged_batch(before) <= n < 0 for n in numbers)
    if len(chosen) > 1 or (fold and (chosen or again)):
        _drop(spark, name, [s for s in found if int(s[BATCH_COLUMN]) in stale])
        low = merged_batch(before) if fold else before + 1
        rows = spark.table(quoted(name)).where(F.col(BATCH_COLUMN).between(low, through))
        if fold:
            rows = fold(rows)
        target = spark.table(quoted(name)).columns
        merged = rows.withColumn(BATCH_COLUMN, F.lit(merged_batch(through)).cast("bigint"))
        transforms = [t for t in table_transforms(spark, name) if t.column != BATCH_COLUMN]
        laid_out = spread_by_partition(merged.select([column(c) for c in target]), transforms)
        # A session of its own: the overwrite mode reaches nobody else.
        session = spark.newSession()
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        view = f"merged_{uuid.uuid4().hex}"
        laid_out.createOrReplaceGlobalTempView(view)
        try:
            session.table(f"global_temp.{view}").write.insertInto(quoted(name), overwrite=True)
        finally:
            spark.catalog.dropGlobalTempView(view)
        spark.catalog.refreshTable(quoted(name))
        spark.sql(
            f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ('{MERGED_PROPERTY}' = '{through}')"
        )
        replaced = [n for n in numbers if n < 0 and n != merged_batch(through)] if fold else []
        stale = [*chosen, *replaced]
    else:
        chosen = []
    _drop(spark, name, [s for s in found if int(s[BATCH_COLUMN]) in stale])
    return len(chosen)
