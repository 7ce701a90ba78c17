"""Load history: an append-only table of job updates, folded into the current state.

An update is ``(job_id, update_ts, seq, kind, fields)``; ``kind`` is ``create``, ``update``,
``progress`` or ``complete`` and ``fields`` a string map holding only what the update sets.
``seq`` orders updates with equal timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import zoneless_micros
from ..functions.display import seconds_between
from ..functions.fixed import (
    KEEP_DAYS,
    KEEP_JOBS,
    LATEST_JOBS,
    TERMINAL_STATUSES,
    TEST_JOB_PREFIX,
)

UPDATE_SCHEMA = (
    "job_id string, update_ts timestamp_ntz, seq bigint, kind string, fields map<string,string>"
)
JOB_FIELDS = (
    "status",
    "table_name",
    "original_filename",
    "file_size",
    "mode",
    "is_test",
    "rows_processed",
    "returncode",
    "stdout",
    "stderr",
    "error",
    "performance_metrics",
)
# One more than the largest sequence number.
_SEQ_RANGE = Decimal(10**19)
# Copies of a finished job's cut-off, so that one job's long update list spreads over tasks.
_SALTS = 32


def _order() -> Column:
    """Time and sequence as one number, so that aggregates over it can hash instead of sort."""
    micros = zoneless_micros(F.col("update_ts")).cast("decimal(38,0)")
    return (micros * F.lit(_SEQ_RANGE) + F.col("seq")).cast("decimal(38,0)")


def is_test_job(job_id: Column, flag: Column | None = None) -> Column:
    """Flagged as a test, or named like one."""
    named = job_id.startswith(TEST_JOB_PREFIX)
    return named if flag is None else named | F.coalesce(flag, F.lit(False))


def _field_aggregates(fields: Sequence[str]) -> list[Column]:
    order = _order()
    return [
        F.max_by(
            F.try_element_at("fields", F.lit(name)),
            F.when(F.map_contains_key("fields", name), order),
        ).alias(name)
        for name in fields
    ]


def latest_fields(updates: DataFrame, fields: Sequence[str] = JOB_FIELDS) -> DataFrame:
    """Current value of each field per job: the last update that sets it wins, null included.

    One partially aggregated shuffle, so a job with very many updates is no hot spot. Works on a
    stream as well.
    """
    return updates.groupBy("job_id").agg(
        F.min("update_ts").alias("first_update"),
        F.max("update_ts").alias("last_update"),
        *_field_aggregates(fields),
    )


def _before_finish(progress: DataFrame, finished: DataFrame) -> DataFrame:
    """Progress updates that came before their job's first terminal update.

    The hot side is a job with many progress updates: it is salted, and the one cut-off row per
    job copied to every salt.
    """
    salted = progress.withColumn(
        "__salt", F.pmod(F.xxhash64("update_ts", "seq"), F.lit(_SALTS)).cast("int")
    )
    copies = finished.select(
        "job_id", "finish", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("__salt")
    )
    joined = salted.join(copies, ["job_id", "__salt"], "left")
    return joined.where(F.col("finish").isNull() | (_order() < F.col("finish")))


def _finish_aggregates() -> list[Column]:
    order = _order()
    status = F.try_element_at("fields", F.lit("status"))
    terminal = (F.col("kind") == "complete") & status.isin(*TERMINAL_STATUSES)
    return [
        F.min(F.when(F.col("kind") == "create", F.col("update_ts"))).alias("created_at"),
        F.max(F.when(terminal, F.col("update_ts"))).alias("completed_at"),
        F.max(F.when(terminal & (status == "completed"), order)).alias("last_success"),
        F.max(F.when(terminal & (status == "failed"), order)).alias("last_failure"),
    ]


def _first_finish(updates: DataFrame) -> DataFrame:
    status = F.try_element_at("fields", F.lit("status"))
    ends = updates.where((F.col("kind") == "complete") & status.isin(*TERMINAL_STATUSES))
    return ends.groupBy("job_id").agg(F.min(_order()).alias("finish"))


def _with_progress(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Add status, progress, start and duration to one row per job."""
    raw = F.try_element_at("fields", F.lit("progress")).try_cast("double")
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw))).cast("int")
    progress = (
        updates.where("kind = 'progress'")
        .select("job_id", "update_ts", "seq", percent.alias("percent"))
        .where("percent is not null")
    )
    live = (
        _before_finish(progress, _first_finish(updates))
        .groupBy("job_id")
        .agg(
            F.max_by("percent", _order()).alias("percent"),
            F.min(F.when(F.col("percent") > 0, F.col("update_ts"))).alias("started_at"),
        )
    )
    succeeded = F.col("last_success").isNotNull()
    beaten = F.col("last_failure").isNotNull() & (
        ~succeeded | (F.col("last_failure") > F.col("last_success"))
    )
    status = (
        F.when(beaten, "failed")
        .when(succeeded, "completed")
        .when(F.col("started_at").isNotNull(), "running")
        .otherwise("pending")
    )
    known = [c for c in jobs.columns if c not in ("job_id", "last_success", "last_failure")]
    return jobs.join(live, "job_id", "left").select(
        "job_id",
        status.alias("status"),
        F.when(succeeded, 100).otherwise(F.coalesce("percent", F.lit(0))).alias("progress"),
        "started_at",
        seconds_between(F.col("started_at"), F.col("completed_at")).alias("duration"),
        *known,
    )


def job_progress(updates: DataFrame) -> DataFrame:
    """Status, progress and times per job under the progress rules.

    Progress is clamped to 0-100 and ignored once the job has finished; the first value above 0
    starts the job. A successful finish means 100.
    """
    return _with_progress(updates.groupBy("job_id").agg(*_finish_aggregates()), updates)


def job_states(updates: DataFrame) -> DataFrame:
    """Everything known about each job: progress rules plus its latest other fields."""
    others = [f for f in JOB_FIELDS if f != "status"]
    jobs = updates.groupBy("job_id").agg(
        F.max("update_ts").alias("last_update"),
        *_finish_aggregates(),
        *_field_aggregates(others),
    )
    flag = F.col("is_test").try_cast("boolean")
    return _with_progress(jobs, updates).withColumn(
        "is_test", is_test_job(F.col("job_id"), flag)
    )


def latest_jobs(
    states: DataFrame, *, limit: int = LATEST_JOBS, include_test: bool = False
) -> DataFrame:
    """Newest jobs first: a distributed top-k."""
    kept = states if include_test else states.where(~F.col("is_test"))
    return kept.orderBy(F.desc("created_at"), F.asc("job_id")).limit(limit)


def retained_jobs(
    states: DataFrame, now: Column, *, keep: int = KEEP_JOBS, days: int = KEEP_DAYS
) -> DataFrame:
    """Jobs kept by retention: young enough, and among the newest ``keep``. A job whose creation
    was never recorded is as old as its last update."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    since = F.coalesce("created_at", "last_update")
    return states.where(since >= cutoff).orderBy(since.desc(), F.asc("job_id")).limit(keep)


def search_jobs(
    states: DataFrame,
    *,
    status: str | None = None,
    table_like: str | None = None,
    since: Column | None = None,
    until: Column | None = None,
) -> DataFrame:
    """Jobs by status, table name (contains, any case) and creation time."""
    out = states
    if status:
        out = out.where(F.col("status") == status)
    if table_like:
        out = out.where(F.lower("table_name").contains(table_like.lower()))
    if since is not None:
        out = out.where(F.col("created_at") >= since)
    if until is not None:
        out = out.where(F.col("created_at") < until)
    return out
