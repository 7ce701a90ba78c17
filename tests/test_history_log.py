"""Retention of a history that is appended to meanwhile."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tableload import apply_retention, job_states, load_history
from tableload.operators.history import UPDATE_SCHEMA
from tableload.plans import history
from tableload.plans.history import append_updates
from tableload.session import scratch_database
from tableload.sinks.catalog import resolve_table
from tableload.streaming import compaction

NOW = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def db(spark):
    return scratch_database(spark)


def updates(spark, *jobs, day=0, kind="create"):
    ts = NOW - datetime.timedelta(days=day)
    rows = [(j, ts, 0, kind, {"status": "pending"}) for j in jobs]
    return spark.createDataFrame(rows, UPDATE_SCHEMA).coalesce(1)


def jobs(spark, table):
    return sorted(r.job_id for r in job_states(load_history(spark, table)).collect())


def retain(spark, table, **limits):
    apply_retention(spark, table, F.lit(str(NOW)).cast("timestamp_ntz"), **limits)


def test_appends_during_retention_stay(spark, db, monkeypatch):
    table = f"{db}.busy"
    append_updates(updates(spark, "old", day=90), table)
    append_updates(updates(spark, "kept"), table)
    acted = []

    def act(done):
        """While retention runs: an update to a kept job, one to a job it drops, a new job."""
        if done == "closed" and not acted:
            acted.append(done)
            append_updates(updates(spark, "during"), table)
            append_updates(updates(spark, "old", kind="update"), table)

    monkeypatch.setattr(history, "_step", act)
    dropped = compaction._drop

    def drop(spark_, name, specs):
        """Between the commit and the clearing up, and before."""
        if len(acted) < 3:
            acted.append("drop")
            append_updates(updates(spark, f"while_dropping_{len(acted)}"), table)
        dropped(spark_, name, specs)

    monkeypatch.setattr(compaction, "_drop", drop)
    retain(spark, table, days=30)
    found = jobs(spark, table)
    assert {"kept", "during", "while_dropping_2", "while_dropping_3"} <= set(found)
    created = load_history(spark, table).where("job_id = 'old' and kind = 'create'")
    assert created.count() == 0 and "old" in found  # its later update was not retention's to judge
    monkeypatch.undo()
    append_updates(updates(spark, "after"), table)
    retain(spark, table, days=30)
    assert set(jobs(spark, table)) == set(found) | {"after"}


def test_a_writer_that_saw_the_closed_generation_writes_again(spark, db, monkeypatch):
    table = f"{db}.slow"
    append_updates(updates(spark, "a"), table)

    def act(done):
        if done == "opened":  # the writer knows its generation; now it is closed and merged
            monkeypatch.setattr(history, "_step", lambda done: None)
            retain(spark, table, days=30)

    monkeypatch.setattr(history, "_step", act)
    append_updates(updates(spark, "late"), table)
    assert jobs(spark, table) == ["a", "late"]
    retain(spark, table, days=30)
    assert jobs(spark, table) == ["a", "late"]
    assert load_history(spark, table).where("job_id = 'late'").count() >= 1


@pytest.mark.parametrize("at", ["merge", "commit", "drop"])
def test_retention_cut_off_anywhere_can_be_repeated(spark, db, monkeypatch, at):
    table = f"{db}.cut_{at}"
    name = resolve_table(spark, table)
    append_updates(updates(spark, "old", day=90), table)
    append_updates(updates(spark, "a", "b"), table)
    retain(spark, table, days=365)
    append_updates(updates(spark, "c"), table)
    calls = []

    def stop(*args, **kwargs):
        raise RuntimeError(at)

    with monkeypatch.context() as patch:
        if at == "merge":
            patch.setattr(compaction, "spread_by_partition", stop)
        else:
            real = compaction._drop

            def drop(*args):
                calls.append(1)
                if at == "drop" and len(calls) == 2 or at == "commit" and len(calls) == 1:
                    raise RuntimeError(at)
                real(*args)

            patch.setattr(compaction, "_drop", drop)
        with pytest.raises(RuntimeError, match=at):
            retain(spark, table, days=30)
    assert set(jobs(spark, table)) >= {"a", "b", "c"}
    append_updates(updates(spark, "d"), table)
    retain(spark, table, days=30)
    assert jobs(spark, table) == ["a", "b", "c", "d"]
    retain(spark, table, keep=2)
    assert len(jobs(spark, table)) == 2
    assert compaction.merged_through(spark, name) >= 0
