"""Load delimited text into a table, or report what a load would do."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import column
from ..functions.fixed import DRY_RUN_ROWS_PER_SECOND
from ..functions.names import clean_name
from ..operators.columns import clean_columns, select_columns, unknown_columns
from ..operators.compat import compare_schemas, schema_verdict
from ..operators.layout import Transform, add_partition_columns
from ..operators.schema import (
    apply_schema,
    apply_schema_observed,
    create_table_sql,
    declared_schema,
    infer_schema,
    load_counts,
    rejected_counts,
    rounded_counts,
    schema_rows,
)
from ..sinks.catalog import (
    quoted,
    resolve_table,
    table_exists,
    table_rows,
    table_transforms,
)
from ..sinks.chunks import FILE_BYTES, file_sizing, row_bytes
from ..sinks.overwrite import finish_replacement
from ..sinks.table import write_table
from ..sources.csv import Dialect, input_bytes, read_text
from .history import JobLog
from .progress import task_progress


@dataclass
class LoadResult:
    """What a load did. ``ragged`` counts rows with too many fields, which lost the surplus, or
    too few, which end in nulls; ``rounded`` counts cells per declared decimal column that were
    stored with fewer digits than given."""

    table_name: str
    success: bool = False
    rows_processed: int = 0
    batches: int = 0
    duration: float = 0.0
    error: str | None = None
    rejected: dict[str, int] = field(default_factory=dict)
    rounded: dict[str, int] = field(default_factory=dict)
    ragged: int = 0
    ignored_columns: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    dry_run: dict | None = None

    @property
    def metrics(self) -> dict[str, float]:
        """Rows, input partitions read, seconds, and the averages of these."""
        batches, seconds = self.batches or 1, self.duration
        return {
            "total_rows": self.rows_processed,
            "total_batches": self.batches,
            "total_processing_time": seconds,
            "avg_batch_size": self.rows_processed / batches,
            "avg_batch_time": seconds / batches,
            "processing_rate": self.rows_processed / seconds if seconds else 0.0,
        }


class Prepared(NamedTuple):
    """Input ready to type: text columns, their schema, and column choices nobody knows."""

    text: DataFrame
    schema: T.StructType
    ignored: list[str]


_RAGGED = "__ragged"


class IncompatibleSchema(ValueError):
    """The input does not fit the existing table."""


def prepare(
    spark: SparkSession,
    path: str | list[str],
    *,
    dialect: Dialect = Dialect(),
    schema: T.StructType | str | None = None,
    sample_rows: int | None = None,
    include: str | Iterable[str] | None = None,
    exclude: str | Iterable[str] | None = None,
    path_glob: str | None = None,
    names: list[str] | None = None,
    ragged_flag: str | None = None,
) -> Prepared:
    """The chosen columns as text under clean names, and the schema they load under.

    ``ragged_flag`` adds the column of that name that marks rows with too many or few fields."""
    read = read_text(spark, path, dialect, names=names, path_glob=path_glob, ragged_flag=ragged_flag)
    source = read.drop(ragged_flag) if ragged_flag else read
    text = select_columns(source, include, exclude)
    ignored = unknown_columns(source.columns, include, exclude)
    flag = [F.col(ragged_flag)] if ragged_flag else []
    chosen = read.select(*[column(n) for n in text.columns], *flag) if flag else text
    if isinstance(schema, str):
        schema = declared_schema(schema)
    if schema is None:
        clean = clean_columns(text)
        flags = [ragged_flag] if ragged_flag else []
        return Prepared(
            chosen.toDF(*clean.columns, *flags), infer_schema(clean, sample_rows), ignored
        )
    text = chosen
    clean = T.StructType(
        [
            T.StructField(
                clean_name(f.name),
                f.dataType,
                f.nullable,
                {**f.metadata, "source": f.metadata.get("source", f.name)},
            )
            for f in schema
        ]
    )
    return Prepared(text, clean, ignored)


def fit_to_target(spark: SparkSession, schema: T.StructType, table: str) -> T.StructType:
    """The schema with the existing table's type wherever the names match.

    Cells are then read straight into the type they are stored under, and every cell that does
    not fit is counted as rejected.
    """
    comparison = compare_schemas(table_rows(spark, quoted(table)), schema_rows(spark, schema))
    verdict = schema_verdict(comparison).head()
    if not verdict["compatible"]:
        raise IncompatibleSchema(
            f"{table}: {verdict['matched']} of {verdict['columns']} columns match, "
            f"{verdict['mismatched']} with another type"
        )
    target = {f.name.lower(): f for f in spark.table(quoted(table)).schema}
    fitted = []
    for f in schema:
        kept = target.get(f.name.lower(), f)
        meta = {**f.metadata, "source": f.metadata.get("source", f.name)}
        fitted.append(T.StructField(f.name, kept.dataType, f.nullable, meta))
    return T.StructType(fitted)


def plan_load(
    spark: SparkSession,
    path: str | list[str],
    table: str,
    *,
    mode: str = "append",
    replace_schema: bool = True,
    transforms: Sequence[Transform] = (),
    file_bytes: int = FILE_BYTES,
    **prepare_options,
) -> DataFrame:
    """Dry run: one row on what ``load_csv`` would do; nothing is written.

    The input is read as the load reads it. Rows, ``ragged`` rows, ``rejected`` and ``rounded``
    cells and ``required_nulls`` (which would fail the load) per column and the bytes of the
    values are exact; ``files`` is how many of about ``file_bytes`` hold them.
    """
    name = resolve_table(spark, table)
    finish_replacement(spark, name)
    flagged, schema, _ = prepare(spark, path, **prepare_options, ragged_flag=_RAGGED)
    text = flagged.drop(_RAGGED)
    exists = table_exists(spark, name)
    rebuilds = exists and mode == "overwrite" and replace_schema
    creates = rebuilds or not exists
    if not creates:
        schema = fit_to_target(spark, schema, name)
    typed = apply_schema(text, schema)
    laid_out = add_partition_columns(
        typed, transforms if creates else table_transforms(spark, name)
    )
    ddl = create_table_sql(quoted(name), laid_out.schema) if creates else None
    size = F.coalesce(F.sum(row_bytes(typed)), F.lit(0)).alias("total_bytes")
    rows = F.col("total_rows").cast("double")
    per_file, files = file_sizing(rows, F.col("total_bytes"), file_bytes)
    ragged = F.count_if(F.col(_RAGGED)).alias("ragged")
    return load_counts(flagged, schema, size, ragged, kept=[_RAGGED]).select(
        F.lit(name).alias("table_name"),
        F.lit(mode).alias("mode"),
        F.lit(ddl).cast("string").alias("ddl"),
        "total_rows",
        "total_bytes",
        per_file.alias("rows_per_file"),
        files.alias("files"),
        "rejected",
        "rounded",
        "required_nulls",
        "ragged",
        (F.col("total_rows") / DRY_RUN_ROWS_PER_SECOND).alias("estimated_seconds"),
        F.lit(int(not exists)).alias("tables_created"),
        F.lit(int(exists)).alias("tables_modified"),
    )


def load_csv(
    spark: SparkSession,
    path: str | list[str],
    table: str,
    *,
    mode: str = "append",
    replace_schema: bool = True,
    transforms: Sequence[Transform] = (),
    dry_run: bool = False,
    max_records_per_file: int | None = None,
    using: str | None = None,
    dialect: Dialect = Dialect(),
    schema: T.StructType | str | None = None,
    sample_rows: int | None = None,
    include: str | Iterable[str] | None = None,
    exclude: str | Iterable[str] | None = None,
    path_glob: str | None = None,
    history_table: str | None = None,
    job_id: str | None = None,
    progress: Callable[[int], None] | None = None,
    progress_seconds: float | None = None,
) -> LoadResult:
    """Read, infer or apply a schema, check it against the table, lay out and write.

    Inference reads the whole input once more than the write does; a declared schema or
    ``sample_rows`` saves that scan, and cells the sample misjudged show up in ``rejected``.
    Quoted cells may hold newlines (see ``Dialect``). A folder whose files differ in their
    headers fails the load before it commits. Failures are reported in the result, not
    raised. ``progress`` is told 0 and 100, and with ``progress_seconds`` as often the share of
    the write's tasks that are done, from another thread.
    """
    began = time.monotonic()
    result = LoadResult(table_name=table)
    job = None
    try:
        if history_table:
            log = JobLog(spark, history_table, job_id or uuid.uuid4().hex)
            shown = path if isinstance(path, str) else ",".join(path)
            log.create(table_name=table, mode=mode, original_filename=shown)
            job = log
        name = result.table_name = resolve_table(spark, table)
        result.log.append(f"target {name}, mode {mode}")
        options = dict(
            dialect=dialect,
            schema=schema,
            sample_rows=sample_rows,
            include=include,
            exclude=exclude,
            path_glob=path_glob,
        )
        if dry_run:
            report = plan_load(
                spark,
                path,
                table,
                mode=mode,
                replace_schema=replace_schema,
                transforms=transforms,
                **options,
            ).head()
            result.dry_run = report.asDict()
            result.rows_processed = report["total_rows"]
            result.rejected = report["rejected"]
            result.rounded = report["rounded"]
            result.ragged = report["ragged"]
        else:
            finish_replacement(spark, name)
            if progress:
                progress(0)
            text, load_schema, result.ignored_columns = prepare(
                spark, path, **options, ragged_flag=_RAGGED
            )
            rebuilds = mode == "overwrite" and replace_schema
            if table_exists(spark, name) and not rebuilds:
                load_schema = fit_to_target(spark, load_schema, name)
            if job:
                job.update(file_size=input_bytes(spark, path, path_glob=path_glob))
                job.progress(1)
            watch = Observation(f"load-{uuid.uuid4().hex[:8]}")
            shape = Observation(f"shape-{uuid.uuid4().hex[:8]}")
            text = text.observe(shape, F.count_if(F.col(_RAGGED)).alias("ragged")).drop(_RAGGED)
            typed = apply_schema_observed(text, load_schema, watch, enforce_required=True)
            telling = progress and progress_seconds
            with task_progress(spark, progress, progress_seconds) if telling else nullcontext():
                write_table(
                    typed,
                    name,
                    mode=mode,
                    transforms=transforms,
                    replace_schema=replace_schema,
                    max_records_per_file=max_records_per_file,
                    using=using,
                )
            result.rows_processed = watch.get["rows"]
            result.batches = watch.get["batches"]
            result.rejected = rejected_counts(watch.get)
            result.rounded = rounded_counts(watch.get)
            result.ragged = shape.get["ragged"]
            result.log.append(f"wrote {result.rows_processed} rows")
            if progress:
                progress(100)
        result.success = True
    except Exception as error:  # noqa: BLE001 - the result carries the failure
        result.error = str(error)
        result.log.append(f"failed: {error}")
    result.duration = time.monotonic() - began
    if job:
        job.complete(
            result.success,
            rows_processed=result.rows_processed,
            error=result.error,
            stdout="\n".join(result.log),
            performance_metrics=json.dumps(result.metrics),
        )
    return result
