"""Turn delimited text into well-laid-out tables, on Spark."""

from .operators.advise import advise, present, recommendation_rows
from .operators.columns import clean_columns, select_columns
from .operators.compat import compare_schemas, schema_verdict, types_compatible
from .operators.history import job_states, latest_jobs, retained_jobs, search_jobs
from .operators.layout import Transform, parse_transform, prune_equal, prune_on
from .operators.profile import profile, profile_approx, profile_exact
from .operators.schema import (
    apply_schema,
    declared_schema,
    edit_schema,
    infer_schema,
    inferred_columns,
    schema_of,
)
from .plans.history import JobLog, apply_retention, load_history
from .plans.load import IncompatibleSchema, LoadResult, load_csv, plan_load
from .sinks.table import read_table, write_table
from .sources.csv import Dialect, read_text
from .sources.structure import structure_report
from .streaming.compaction import merge_batches
from .streaming.ingest import ingest_dir, ingested_profile, read_ingested
from .streaming.job_states import follow_job_states, followed_states, merge_job_states

__all__ = [
    "Dialect",
    "IncompatibleSchema",
    "JobLog",
    "LoadResult",
    "Transform",
    "advise",
    "apply_retention",
    "apply_schema",
    "clean_columns",
    "compare_schemas",
    "declared_schema",
    "edit_schema",
    "follow_job_states",
    "followed_states",
    "infer_schema",
    "inferred_columns",
    "ingest_dir",
    "job_states",
    "latest_jobs",
    "load_csv",
    "load_history",
    "merge_batches",
    "merge_job_states",
    "parse_transform",
    "plan_load",
    "present",
    "profile",
    "profile_approx",
    "profile_exact",
    "prune_equal",
    "prune_on",
    "read_ingested",
    "read_table",
    "read_text",
    "recommendation_rows",
    "retained_jobs",
    "schema_of",
    "schema_verdict",
    "search_jobs",
    "select_columns",
    "structure_report",
    "types_compatible",
    "write_table",
]
