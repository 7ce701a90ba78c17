"""Incremental loads."""

from __future__ import annotations

import pytest

from tableload import Transform, ingest_dir, merge_batches, read_ingested, write_table
from tableload.session import scratch_database
from tableload.streaming import compaction
from tableload.streaming.compaction import MERGED_PROPERTY, merged_through
from tableload.streaming.ingest import BATCH_COLUMN, replace_batch
from tableload.streaming.job_states import followed_states, merge_job_states
from tableload.sinks.catalog import resolve_table, table_properties


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()

    def add(name, text):
        (path / name).write_text(text, encoding="utf-8")

    add.path = str(path)
    return add


def test_only_new_files_are_loaded(spark, folder, tmp_path):
    target, checkpoint = f"{scratch_database(spark)}.t", str(tmp_path / "ck")
    folder("a.csv", "id,day\n1,2024-01-01\n2,NA\n")
    folder("note.log", "id,day\n99,2024-01-01\n")
    seen = []
    watch = lambda r: seen.append((r.batches, r.rows))
    first = ingest_dir(spark, folder.path, target, checkpoint, on_batch=watch)
    assert (first.rows, first.batches, first.rejected, seen) == (2, 1, {}, [(1, 2)])
    again = ingest_dir(spark, folder.path, target, checkpoint)
    assert (again.rows, again.batches) == (0, 0)
    folder("b.TXT", "id,day\nx,2024-02-01\n4,2024-02-02\n")
    more = ingest_dir(spark, folder.path, target, checkpoint)
    assert (more.rows, more.rejected) == (2, {"id": 1})
    got = sorted(read_ingested(spark, target).collect(), key=str)
    assert len(got) == 4 and {r.id for r in got} == {1, 2, 4, None}
    assert read_ingested(spark, target).columns == ["id", "day"]


def test_replayed_batch_does_not_repeat_rows(spark, folder, tmp_path):
    target = f"{scratch_database(spark)}.t"
    folder("a.csv", "id,k\n1,x\n2,y\n")
    ingest_dir(
        spark, folder.path, target, str(tmp_path / "ck"), transforms=[Transform("id", "bucket", 2)]
    )
    session = spark.newSession()
    stored = session.table(target).where(f"{BATCH_COLUMN} = 0").drop(BATCH_COLUMN)
    copy = session.createDataFrame(stored.collect(), stored.schema)
    replace_batch(copy, 0, resolve_table(spark, target))
    spark.catalog.refreshTable(target)
    assert spark.table(target).count() == 2
    replace_batch(copy, 1, resolve_table(spark, target))
    spark.catalog.refreshTable(target)
    assert spark.table(target).count() == 4


def test_several_batches_and_declared_schema(spark, folder, tmp_path):
    target = f"{scratch_database(spark)}.t"
    for i in range(4):
        folder(f"f{i}.csv", f"id,v\n{i},{i}.5\n")
    schema = '[{"name": "v", "type": "Double"}, {"name": "id", "type": "String"}]'
    result = ingest_dir(
        spark, folder.path, target, str(tmp_path / "ck"), schema=schema, max_files_per_batch=1
    )
    assert (result.rows, result.batches) == (4, 4)
    rows = {tuple(r) for r in read_ingested(spark, target).select("id", "v").collect()}
    assert rows == {(str(i), i + 0.5) for i in range(4)}


def test_failed_batch_is_repeated_without_repeating_rows(spark, folder, tmp_path):
    target, checkpoint = f"{scratch_database(spark)}.t", str(tmp_path / "ck")
    folder("a.csv", "id\n1\n")
    folder("b.csv", "id\n2\n")
    calls = []

    def fail_late(result):
        calls.append(result.rows)
        if len(calls) == 2:
            raise RuntimeError("lost after writing")

    options = dict(max_files_per_batch=1)
    with pytest.raises(Exception, match="lost after writing"):
        ingest_dir(spark, folder.path, target, checkpoint, on_batch=fail_late, **options)
    result = ingest_dir(spark, folder.path, target, checkpoint, **options)
    assert (result.rows, result.batches) == (1, 1)
    assert sorted(r.id for r in read_ingested(spark, target).collect()) == [1, 2]


def test_plain_table_is_refused(spark, folder, tmp_path):
    target = f"{scratch_database(spark)}.t"
    write_table(spark.range(1), target)
    folder("a.csv", "id\n1\n")
    with pytest.raises(ValueError, match="table of its own"):
        ingest_dir(spark, folder.path, target, str(tmp_path / "ck"))


def _six_batches(spark, folder, tmp_path):
    target = resolve_table(spark, f"{scratch_database(spark)}.t")
    for i in range(6):
        folder(f"f{i}.csv", f"id,k\n{i},a/b={i % 2}\n{i + 10},\n")
    ingest_dir(
        spark, folder.path, target, str(tmp_path / "ck"), max_files_per_batch=1,
        transforms=[Transform("k")],
    )
    return target


def _ids(spark, target):
    return sorted(r.id for r in read_ingested(spark, target).collect())


ALL_IDS = [*range(6), *range(10, 16)]


def test_merged_batches_keep_their_rows(spark, folder, tmp_path):
    target = _six_batches(spark, folder, tmp_path)
    assert spark.sql(f"SHOW PARTITIONS {target}").count() == 12
    assert merge_batches(spark, target, keep=2) == 4
    assert _ids(spark, target) == ALL_IDS
    # Two values and null in the merge, one value and null in each batch that stays.
    assert spark.sql(f"SHOW PARTITIONS {target}").count() == 7
    assert spark.table(target).count() == 12
    assert merge_batches(spark, target, keep=2) == 0
    more = {f"g{i}.csv": f"id,k\n{i + 20},x\n" for i in range(3)}
    for name, text in more.items():
        folder(name, text)
    result = ingest_dir(
        spark, folder.path, target, str(tmp_path / "ck"), max_files_per_batch=1,
        transforms=[Transform("k")], merge_keep=1,
    )
    assert (result.batches, result.merged) == (3, 4)
    assert _ids(spark, target) == [*ALL_IDS, 20, 21, 22]
    with pytest.raises(ValueError, match="at least 1"):
        merge_batches(spark, target, keep=0)


def test_newest_batch_may_be_replayed_after_a_merge(spark, folder, tmp_path):
    target = _six_batches(spark, folder, tmp_path)
    session = spark.newSession()
    stored = session.table(target).where(f"{BATCH_COLUMN} = 5").drop(BATCH_COLUMN)
    copy = session.createDataFrame(stored.collect(), stored.schema)
    merge_batches(spark, target)
    replace_batch(copy, 5, target)
    spark.catalog.refreshTable(target)
    assert _ids(spark, target) == ALL_IDS


@pytest.mark.parametrize("committed", [False, True])
def test_interrupted_merge_loses_and_repeats_nothing(
    spark, folder, tmp_path, monkeypatch, committed
):
    target = _six_batches(spark, folder, tmp_path)
    calls = []

    def fail(*args):
        calls.append(args)
        if len(calls) == 2:  # the first call, before the merge, clears leftovers
            raise RuntimeError("lost")

    monkeypatch.setattr(compaction, "_drop", fail)
    with pytest.raises(RuntimeError, match="lost"):
        merge_batches(spark, target, keep=2)
    monkeypatch.undo()
    assert table_properties(spark, target)[MERGED_PROPERTY] == "3"
    if not committed:
        spark.sql(f"ALTER TABLE {target} SET TBLPROPERTIES ('{MERGED_PROPERTY}' = '-1')")
    assert _ids(spark, target) == ALL_IDS
    merge_batches(spark, target, keep=1)
    assert _ids(spark, target) == ALL_IDS and spark.table(target).count() == 12
    assert merged_through(spark, target) == (3 if committed else 4)


def test_merged_job_states_are_the_newest(spark, tmp_path):
    target = resolve_table(spark, f"{scratch_database(spark)}.states")
    schema = f"job_id string, status string, {BATCH_COLUMN} bigint"
    rows = [("a", "old", 0), ("b", "only", 0), ("a", "mid", 1), ("a", "new", 2), ("c", None, 3)]
    write_table(
        spark.createDataFrame(rows, schema), target, transforms=[Transform(BATCH_COLUMN)]
    )
    expected = {("a", "new"), ("b", "only"), ("c", None)}

    def states():
        return {tuple(r) for r in followed_states(spark, target).collect()}

    assert states() == expected
    assert merge_job_states(spark, target, keep=2) == 2 and states() == expected
    assert merge_job_states(spark, target) == 1 and states() == expected
    assert spark.table(target).count() == 3
