"""Load history over events read as an update log.

A job is a user's events within five days. Sign-ups create jobs, views and clicks report
progress, large purchases and errors finish them, the rest update fields.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tableload.functions.display import (
    duration_label,
    duration_text,
    seconds_between,
    size_label,
    size_text,
    status_label,
    timestamp_label,
)
from tableload.operators.history import (
    job_progress,
    job_states,
    latest_fields,
    latest_jobs,
    retained_jobs,
    search_jobs,
)

from .registry import query, table

STATE_FIELDS = ("status", "table_name", "file_size", "rows_processed", "error")


def updates(events):
    """Events as job updates."""
    kind_of = F.col("event_type")
    done = (kind_of == "purchase") & (F.col("value") > 40)
    failed = (kind_of == "error") & (F.col("value") > 60)
    kind = (
        F.when(kind_of == "signup", "create")
        .when(kind_of.isin("view", "click"), "progress")
        .when(done | failed, "complete")
        .otherwise("update")
    )
    text = F.col("event_id").cast("string")
    fields = (
        F.when(
            kind_of == "signup",
            F.create_map(
                F.lit("status"), F.lit("pending"),
                F.lit("table_name"), F.concat(F.lit("Sales_"), F.col("event_id") % 7),
                F.lit("file_size"), text,
            ),
        )
        .when(kind == "progress", F.create_map(F.lit("progress"), F.col("value").cast("string")))
        .when(done, F.create_map(F.lit("status"), F.lit("completed"), F.lit("rows_processed"), text))
        .when(failed, F.create_map(F.lit("status"), F.lit("failed"), F.lit("error"), text))
        .when(kind_of == "purchase", F.create_map(F.lit("rows_processed"), text))
        .otherwise(F.create_map(F.lit("error"), F.lit(None).cast("string")))
    )
    period = F.floor((F.dayofmonth("ts") - 1) / 5)
    prefix = F.when(F.col("user_id") % 10 == 0, "test_").otherwise("job_")
    return events.select(
        F.concat(prefix, "user_id", F.lit("_"), period).alias("job_id"),
        F.col("ts").alias("update_ts"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        fields.alias("fields"),
    )


def _updates(spark, sf_dir):
    return updates(table(spark, sf_dir, "events"))


_UPDATES = """SELECT CASE WHEN user_id % 10 = 0 THEN 'test_' ELSE 'job_' END || user_id || '_'
           || CAST(floor((day(ts) - 1) / 5) AS BIGINT) AS job_id, ts, event_id, event_type, value,
    event_type = 'purchase' AND value > 40 AS done, event_type = 'error' AND value > 60 AS failed
  FROM events"""

LATEST_SQL = f"""WITH u AS ({_UPDATES})
SELECT job_id, min(ts) AS first_update, max(ts) AS last_update,
  arg_max(CASE WHEN event_type = 'signup' THEN 'pending' WHEN done THEN 'completed'
               ELSE 'failed' END, (ts, event_id))
    FILTER (event_type = 'signup' OR done OR failed) AS status,
  arg_max('Sales_' || event_id % 7, (ts, event_id)) FILTER (event_type = 'signup') AS table_name,
  arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) FILTER (event_type = 'signup') AS file_size,
  arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) FILTER (event_type = 'purchase')
    AS rows_processed,
  nullif(arg_max(CASE WHEN failed THEN CAST(event_id AS VARCHAR) ELSE '-' END, (ts, event_id))
    FILTER (event_type = 'error'), '-') AS error
FROM u GROUP BY job_id"""

_PROGRESS_SQL = f"""WITH u AS ({_UPDATES}),
ends AS (SELECT job_id, min(ts) FILTER (done OR failed) AS first_end,
                max(ts) FILTER (done OR failed) AS completed_at,
                arg_max(CASE WHEN done THEN 'completed' ELSE 'failed' END, ts)
                  FILTER (done OR failed) AS final_status,
                coalesce(bool_or(done), FALSE) AS succeeded,
                min(ts) FILTER (event_type = 'signup') AS created_at
         FROM u GROUP BY job_id),
live AS (SELECT u.job_id, arg_max(greatest(0, least(100, CAST(floor(value) AS INTEGER))), ts) AS p,
                min(ts) FILTER (value >= 1) AS started_at
         FROM u JOIN ends ON u.job_id = ends.job_id
         WHERE event_type IN ('view', 'click') AND (first_end IS NULL OR ts < first_end)
         GROUP BY u.job_id),
p AS (SELECT ends.job_id,
             coalesce(final_status, CASE WHEN started_at IS NULL THEN 'pending' ELSE 'running' END)
               AS status,
             CASE WHEN succeeded THEN 100 ELSE coalesce(p, 0) END AS progress, created_at,
             started_at, completed_at,
             (epoch_us(completed_at) - epoch_us(started_at)) / 1000000 AS duration
      FROM ends LEFT JOIN live ON ends.job_id = live.job_id)
"""

_STATES_SQL = f"""{_PROGRESS_SQL}, latest AS ({LATEST_SQL.replace('WITH u AS (' + _UPDATES + ')', '')}),
states AS (SELECT p.*, table_name, file_size, rows_processed, error, last_update,
                  starts_with(p.job_id, 'test_') AS is_test
           FROM p JOIN latest ON p.job_id = latest.job_id)
"""

_SHOWN = ["job_id", "status", "progress", "created_at", "table_name", "is_test"]


@query("job_state", LATEST_SQL)
def job_state(spark, sf_dir):
    return latest_fields(_updates(spark, sf_dir), STATE_FIELDS)


@query("job_progress", f"{_PROGRESS_SQL} SELECT job_id, status, progress, started_at FROM p")
def job_progress_query(spark, sf_dir):
    return job_progress(_updates(spark, sf_dir)).select(
        "job_id", "status", "progress", "started_at"
    )


@query(
    "job_completion",
    f"""{_PROGRESS_SQL} SELECT job_id, status, completed_at, duration, progress FROM p
        WHERE completed_at IS NOT NULL""",
)
def job_completion(spark, sf_dir):
    done = job_progress(_updates(spark, sf_dir)).where("completed_at is not null")
    return done.select("job_id", "status", "completed_at", "duration", "progress")


@query(
    "job_created",
    f"""{_STATES_SQL} SELECT job_id, created_at, table_name, file_size, is_test FROM states
        WHERE created_at IS NOT NULL""",
)
def job_created(spark, sf_dir):
    return (
        job_states(_updates(spark, sf_dir))
        .where("created_at is not null")
        .select("job_id", "created_at", "table_name", "file_size", "is_test")
    )


@query(
    "latest_jobs",
    f"""{_STATES_SQL} SELECT {", ".join(_SHOWN)} FROM states WHERE NOT is_test
        ORDER BY created_at DESC NULLS LAST, job_id LIMIT 50""",
)
def latest_jobs_query(spark, sf_dir):
    return latest_jobs(job_states(_updates(spark, sf_dir))).select(*_SHOWN)


@query(
    "job_retention",
    f"""{_STATES_SQL} SELECT {", ".join(_SHOWN)} FROM states
        WHERE coalesce(created_at, last_update) >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY
        ORDER BY coalesce(created_at, last_update) DESC, job_id LIMIT 100""",
)
def job_retention(spark, sf_dir):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    return retained_jobs(job_states(_updates(spark, sf_dir)), now, days=14).select(*_SHOWN)


@query(
    "job_search",
    f"""{_STATES_SQL} SELECT {", ".join(_SHOWN)} FROM states
        WHERE status = 'failed' AND contains(lower(table_name), 'sales_3')
          AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-25'""",
)
def job_search(spark, sf_dir):
    found = search_jobs(
        job_states(_updates(spark, sf_dir)),
        status="failed",
        table_like="SALES_3",
        since=F.lit("2024-01-05").cast("timestamp_ntz"),
        until=F.lit("2024-01-25").cast("timestamp_ntz"),
    )
    return found.select(*_SHOWN)


@query(
    "job_display",
    """WITH s AS (SELECT event_id, ts, event_type, value, event_id * 1153 * (event_id % 11) AS size,
                         CASE WHEN event_id % 9 <> 0 THEN value * 37 END AS secs FROM events)
       SELECT event_id,
         CASE WHEN size < 1024 THEN printf('%d B', size)
              WHEN size < 1048576 THEN printf('%.2f KB', size / 1024)
              WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576)
              ELSE printf('%.2f GB', size / 1073741824) END AS size_label,
         CASE WHEN size = 0 THEN '0 B' WHEN size < 1024 THEN printf('%.2f B', size::DOUBLE)
              WHEN size < 1048576 THEN printf('%.2f KB', size / 1024)
              WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576)
              ELSE printf('%.2f GB', size / 1073741824) END AS size_text,
         CASE WHEN secs IS NULL THEN 'N/A'
              ELSE printf('%02d:%02d:%02d', floor(secs)::BIGINT // 3600,
                          floor(secs)::BIGINT % 3600 // 60, floor(secs)::BIGINT % 60)
         END AS duration_label,
         CASE WHEN event_id % 13 = 0 THEN 'N/A' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S')
         END AS created,
         CASE WHEN event_type = 'error' THEN 'Failed' WHEN event_type = 'view' THEN 'Unknown'
              ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS status
       FROM s""",
)
def job_display(spark, sf_dir):
    size = F.col("event_id") * 1153 * (F.col("event_id") % 11)
    seconds = F.when(F.col("event_id") % 9 != 0, F.col("value") * 37)
    raw = F.col("event_type")
    status = F.when(raw == "error", "FAILED").when(raw == "view", "").otherwise(raw)
    return table(spark, sf_dir, "events").select(
        "event_id",
        size_label(size).alias("size_label"),
        size_text(size).alias("size_text"),
        duration_label(seconds).alias("duration_label"),
        timestamp_label(F.when(F.col("event_id") % 13 != 0, F.col("ts"))).alias("created"),
        status_label(status).alias("status"),
    )


@query(
    "duration_text",
    """SELECT event_id, CASE WHEN secs < 60 THEN printf('%.1f seconds', secs)
              WHEN secs < 3600 THEN printf('%.1f minutes', secs / 60)
              ELSE printf('%.2f hours', secs / 3600) END AS took,
              secs
       FROM (SELECT event_id, event_id % 17 * (event_id % 997) * 0.5::DOUBLE AS secs FROM events)""",
)
def duration_text_query(spark, sf_dir):
    secs = F.col("event_id") % 17 * (F.col("event_id") % 997) * F.lit(0.5)
    return table(spark, sf_dir, "events").select(
        "event_id", duration_text(secs).alias("took"), secs.alias("secs")
    )


@query(
    "seconds_between",
    """SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('month', ts))) / 1000000 AS seconds
       FROM events""",
)
def seconds_between_query(spark, sf_dir):
    start = F.trunc("ts", "month").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id", seconds_between(start, F.col("ts")).alias("seconds")
    )
