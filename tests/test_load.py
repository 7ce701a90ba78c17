"""Writes, whole loads, layout and history tables."""

from __future__ import annotations

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tableload import (
    IncompatibleSchema,
    JobLog,
    Transform,
    apply_retention,
    job_states,
    latest_jobs,
    load_csv,
    load_history,
    parse_transform,
    plan_load,
    prune_equal,
    prune_on,
    read_table,
    write_table,
)
from tableload.operators.history import UPDATE_SCHEMA, job_progress, latest_fields
from tableload.plans.load import fit_to_target
from tableload.plans.progress import task_progress
from tableload.session import scratch_database, scratch_path, scratch_root
from tableload.sinks.catalog import (
    create_table,
    drop_table,
    ensure_database,
    resolve_table,
    table_exists,
    table_location,
    table_transforms,
)
from tableload.sinks.chunks import chunk_plan
from tableload.sinks.table import file_stats
from tableload.operators.schema import infer_schema


@pytest.fixture
def db(spark):
    return scratch_database(spark)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_append_overwrite_and_counts(spark, db, write_file):
    first = write_file("id,name\n1,a\n2,b\n")
    second = write_file("id,name\n3,c\n", "second.csv")
    target = f"{db}.t"
    assert load_csv(spark, first, target).rows_processed == 2
    assert load_csv(spark, second, target).rows_processed == 1
    assert spark.table(target).count() == 3
    result = load_csv(spark, second, target, mode="overwrite")
    assert result.success and result.table_name == f"spark_catalog.{target}"
    assert [tuple(r) for r in spark.table(target).collect()] == [(3, "c")]


def test_overwrite_with_empty_input_empties_the_table(spark, db, write_file):
    target = f"{db}.t"
    load_csv(spark, write_file("id,name\n1,a\n"), target)
    assert load_csv(spark, write_file("id,name\n", "e.csv"), target, mode="overwrite").success
    assert spark.table(target).count() == 0


@pytest.mark.parametrize("setting", ["static", "dynamic"])
def test_keep_schema_overwrite_replaces_all_partitions(spark, db, setting):
    name = "spark.sql.sources.partitionOverwriteMode"
    target = f"{db}.t"
    df = spark.createDataFrame([(i, f"k{i % 3}") for i in range(9)], "id int, k string")
    write_table(df, target, transforms=[Transform("k")])
    spark.conf.set(name, setting)
    try:
        write_table(df.where("id = 1"), target, mode="overwrite", replace_schema=False)
        assert spark.conf.get(name).lower() == setting
    finally:
        spark.conf.unset(name)
    assert [tuple(r) for r in spark.table(target).collect()] == [(1, "k1")]


def test_failed_overwrite_keeps_the_old_rows(spark, db, write_file):
    target = f"{db}.t"
    load_csv(spark, write_file("id\n1\n"), target)
    schema = '[{"name": "id", "type": "Long", "required": true}]'
    result = load_csv(
        spark, write_file("id\nx\n", "bad.csv"), target, mode="overwrite", schema=schema
    )
    assert not result.success and "required column id" in result.error
    assert [r.id for r in spark.table(target).collect()] == [1]


def test_load_after_a_failed_first_load(spark, db, write_file):
    target = f"{db}.t"
    schema = '[{"name": "id", "type": "Long", "required": true}]'
    bad = write_file("id\n" + "1\n" * 1000 + "x\n", "bad.csv")
    assert not load_csv(spark, bad, target, schema=schema).success
    assert not table_exists(spark, target)
    assert load_csv(spark, write_file("id\n2\n"), target, schema=schema).success
    assert [r.id for r in spark.table(target).collect()] == [2]


def test_incompatible_schema_is_refused(spark, db, write_file):
    target = f"{db}.t"
    write_table(spark.createDataFrame([(1.5, 2.5)], "a double, b double"), target)
    result = load_csv(spark, write_file("a,b\n1,2\n"), target)
    assert not result.success and "0 with another type" not in result.error
    assert spark.table(target).count() == 1
    text = spark.createDataFrame([("1", "2")], "a string, b string")
    with pytest.raises(IncompatibleSchema):
        fit_to_target(spark, infer_schema(text), f"spark_catalog.{target}")


def test_unknown_column_on_append_is_an_error(spark, db, write_file):
    target = f"{db}.t"
    load_csv(spark, write_file("a,b,c\n1,2,3\n"), target)
    result = load_csv(spark, write_file("a,b,c,z\n1,2,3,4\n", "more.csv"), target)
    assert not result.success and "['z']" in result.error


def test_rejects_are_counted_and_rows_kept(spark, db, write_file):
    schema = '[{"name": "id", "type": "Long"}, {"name": "v", "type": "Double"}]'
    path = write_file("id,v\n1,1.5\nx,oops\n3,NA\n")
    result = load_csv(spark, path, f"{db}.t", schema=schema)
    assert (result.rows_processed, result.rejected) == (3, {"id": 1, "v": 1})
    assert spark.table(f"{db}.t").count() == 3


def test_metrics(spark, db, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 4000, numPartitions=4).write.option("header", True).csv(path)
    result = load_csv(spark, path, f"{db}.t")
    metrics = result.metrics
    assert metrics["total_rows"] == 4000 and metrics["total_batches"] == result.batches >= 1
    assert metrics["avg_batch_size"] == 4000 / result.batches
    assert metrics["processing_rate"] == 4000 / result.duration


def test_names_are_cleaned_and_columns_chosen(spark, db, write_file):
    path = write_file("user id,select,1st,junk\n1,x,2,3\n")
    result = load_csv(spark, path, f"{db}.t", exclude="junk, nope", progress=lambda p: None)
    assert result.success, result.error
    assert result.ignored_columns == ["nope"]
    assert spark.table(f"{db}.t").columns == ["user_id", "col_select", "col_1st"]


def test_declared_names_match_cleaned_headers(spark, db, write_file):
    path = write_file("user id,1st\n7,x\n")
    schema = '[{"name": "user_id", "type": "Long"}, {"name": "1st", "type": "String"}]'
    assert load_csv(spark, path, f"{db}.t", schema=schema).success
    assert [r.asDict() for r in spark.table(f"{db}.t").collect()] == [
        {"user_id": 7, "col_1st": "x"}
    ]


def test_missing_file_is_reported(spark, db, tmp_path):
    result = load_csv(spark, str(tmp_path / "none.csv"), f"{db}.t")
    assert not result.success and result.error


def test_round_trip(spark, db, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events")
    as_text = df.withColumn("ts", F.col("ts").cast("string"))
    as_text.write.options(header=True, escape='"').csv(path)
    assert load_csv(spark, path, f"{db}.t").success
    loaded = spark.table(f"{db}.t")
    assert loaded.schema.simpleString() == df.schema.simpleString()
    assert loaded.exceptAll(df).count() == 0 and df.exceptAll(loaded).count() == 0


def test_layout_is_hidden_remembered_and_reused(spark, db):
    df = spark.createDataFrame(
        [(i, datetime.datetime(2024, 1 + i % 3, 1), f"name{i}") for i in range(30)],
        "id bigint, ts timestamp_ntz, name string",
    )
    layout = [
        Transform("ts", "month"),
        Transform("id", "bucket", 4),
        Transform("name", "truncate", 2),
    ]
    target = f"{db}.t"
    write_table(df, target, transforms=layout)
    assert table_transforms(spark, target) == layout
    assert read_table(spark, target).columns == ["id", "ts", "name"]
    write_table(df, target)
    stored = spark.table(target)
    assert stored.count() == 60
    assert stored.where("ts_month is null or id_bucket is null or name_trunc is null").count() == 0
    assert read_table(spark, target).exceptAll(df.union(df)).count() == 0


def test_transform_text():
    for text in ("year(ts)", "bucket(10, id)", "truncate(name, 5)", "plain", "a b"):
        assert str(parse_transform(text)) == text
    with pytest.raises(ValueError, match="width"):
        Transform("id", "bucket")
    with pytest.raises(ValueError, match="unknown"):
        Transform("id", "hour")


def test_partitions_are_pruned(spark, db):
    target = f"{db}.t"
    month, bucket = Transform("ts", "month"), Transform("id", "bucket", 4)
    df = spark.range(1000).select(
        "id",
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 300 as int))").alias("ts"),
    )
    write_table(df, target, transforms=[month, bucket])
    stored = spark.table(target)
    ranged = prune_on(stored, "ts", "2024-03-10", "2024-04-02", [month, bucket])
    assert ranged.count() == df.where(
        "ts >= timestamp_ntz'2024-03-10' and ts < timestamp_ntz'2024-04-02'"
    ).count()
    filters = plan_text(ranged).split("PartitionFilters: [")[1].split("]")[0]
    assert "ts_month" in filters
    assert len(ranged.inputFiles()) > 0
    single = prune_equal(stored, "id", 17, [month, bucket])
    assert "id_bucket" in plan_text(single).split("PartitionFilters: [")[1].split("]")[0]
    assert single.count() == 1


def test_null_partition_values_survive(spark, db):
    target = f"{db}.t"
    df = spark.createDataFrame([(1, None), (2, datetime.date(2024, 1, 1))], "id int, d date")
    write_table(df, target, transforms=[Transform("d", "month"), Transform("id", "bucket", 2)])
    assert read_table(spark, target).exceptAll(df).count() == 0


def test_integer_truncate_floors(spark):
    from tableload.operators.layout import add_partition_columns

    df = spark.createDataFrame([(-1,), (0,), (99,), (100,)], "v int")
    out = add_partition_columns(df, [Transform("v", "truncate", 100)])
    assert [r.v_trunc for r in out.collect()] == [-100, 0, 0, 100]


def test_partition_column_clash(spark, db):
    df = spark.createDataFrame([(1, 2)], "id int, id_bucket int")
    with pytest.raises(ValueError, match="already exists"):
        write_table(df, f"{db}.t", transforms=[Transform("id", "bucket", 2)])


def test_hot_partition_is_split_over_tasks(spark, db):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(200_000).select(
            F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5))
            .alias("k"),
            F.rand(1).alias("x"),
            F.rand(2).alias("y"),
        ).repartition(8)
        write_table(df, f"{db}.t", transforms=[Transform("k")])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = spark.table(f"{db}.t").where("k = 'hot'").select("_metadata.file_path").distinct()
    assert files.count() > 1
    assert spark.table(f"{db}.t").count() == 200_000


def test_chunk_plan(spark, db):
    df = spark.createDataFrame(
        [(1, "it's", None, True, datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3))],
        "a int, b string, c string, d boolean, e date, f timestamp_ntz",
    )
    assert tuple(chunk_plan(df, max_bytes=100).head()) == (1, 4 + 4 + 1 + 4 + 8, 4, 1)
    many = spark.range(1200)
    assert tuple(chunk_plan(many, max_bytes=80).head()) == (1200, 9600, 10, 120)
    assert tuple(chunk_plan(many, max_bytes=1).head())[2:] == (1, 1200)
    assert tuple(chunk_plan(many.limit(0)).head()) == (0, 0, None, 0)
    nulls = spark.range(3).select(F.lit(None).cast("string").alias("c"))
    assert tuple(chunk_plan(nulls).head()) == (3, 0, 3, 1)


def test_max_records_per_file(spark, db):
    write_table(spark.range(0, 2000, numPartitions=2), f"{db}.t", max_records_per_file=500)
    stats = file_stats(spark, f"{db}.t").head()
    assert (stats["files"], stats["max_rows"], stats["total_rows"]) == (4, 500, 2000)


def test_dry_run_writes_nothing(spark, db, write_file):
    path = write_file("id,day\n" + "".join(f"{i},2024-01-0{1 + i % 5}\n" for i in range(1200)))
    result = load_csv(spark, path, f"{db}.t", dry_run=True)
    assert not table_exists(spark, f"{db}.t")
    report = result.dry_run
    assert report["total_rows"] == result.rows_processed == 1200
    assert (report["total_bytes"], report["files"]) == (1200 * 12, 1)
    assert (report["rejected"], report["required_nulls"]) == ({}, {})
    assert report["estimated_seconds"] == 1200 / 5000
    assert (report["tables_created"], report["tables_modified"]) == (1, 0)
    assert "`day` DATE" in report["ddl"]
    load_csv(spark, path, f"{db}.t")
    again = plan_load(spark, path, f"{db}.t").head()
    assert (again["ddl"], again["tables_created"], again["tables_modified"]) == (None, 0, 1)


def test_catalog_steps(spark, db, tmp_path):
    current = spark.catalog.currentDatabase()
    assert resolve_table(spark, "t") == f"spark_catalog.{current}.t"
    assert resolve_table(spark, "d.t") == "spark_catalog.d.t"
    assert resolve_table(spark, "c.d.t") == "c.d.t"
    for wrong in ("", "a.b.c.d", "a..b"):
        with pytest.raises(ValueError, match="not a table name"):
            resolve_table(spark, wrong)
    name = f"made_{uuid.uuid4().hex}"
    ensure_database(spark, name, str(tmp_path / "made"))
    ensure_database(spark, name)
    schema = spark.createDataFrame([], "a int, b string").schema
    create_table(
        spark, f"{name}.t", schema, properties={"team": "me"}, location=str(tmp_path / "place")
    )
    assert table_exists(spark, f"{name}.t")
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}.t").collect()}
    assert props["team"] == "me"
    drop_table(spark, f"{name}.t")
    drop_table(spark, f"{name}.t")
    assert not table_exists(spark, f"{name}.t")
    assert table_location("/wh/", "c", "s", "t") == "/wh/c/s.db/t"


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_bad_mode(spark, db):
    with pytest.raises(ValueError, match="mode"):
        write_table(spark.range(1), f"{db}.t", mode="merge")


def test_load_is_recorded(spark, db, write_file):
    path = write_file("id\n1\n2\n")
    load_csv(spark, path, f"{db}.t", history_table=f"{db}.jobs", job_id="one")
    load_csv(spark, path, f"{db}.t", mode="merge", history_table=f"{db}.jobs", job_id="two")
    states = {r.job_id: r for r in job_states(load_history(spark, f"{db}.jobs")).collect()}
    one, two = states["one"], states["two"]
    assert (one.status, one.progress, one.rows_processed, one.mode) == (
        "completed",
        100,
        "2",
        "append",
    )
    assert one.started_at >= one.created_at and one.duration >= 0
    assert int(one.file_size) == len("id\n1\n2\n") and "wrote 2 rows" in one.stdout
    assert '"total_rows": 2' in one.performance_metrics
    assert two.status == "failed" and "mode must be" in two.error
    assert load_history(spark, f"{db}.none").count() == 0


def _at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def _updates(spark, rows):
    full = [(job, _at(m), i, kind, fields) for i, (job, m, kind, fields) in enumerate(rows)]
    return spark.createDataFrame(full, UPDATE_SCHEMA)


def test_progress_rules(spark):
    updates = _updates(
        spark,
        [
            ("a", 0, "create", {"status": "pending"}),
            ("a", 1, "progress", {"progress": "0"}),
            ("a", 2, "progress", {"progress": "-5"}),
            ("a", 3, "progress", {"progress": "40"}),
            ("a", 4, "progress", {"progress": "30"}),
            ("b", 0, "create", {"status": "pending"}),
            ("b", 5, "progress", {"progress": "70"}),
            ("b", 6, "complete", {"status": "failed"}),
            ("b", 7, "progress", {"progress": "99"}),
            ("c", 0, "create", {"status": "pending"}),
            ("c", 8, "complete", {"status": "completed"}),
            ("c", 9, "progress", {"progress": "10"}),
            ("d", 0, "create", {"status": "pending"}),
            ("d", 1, "progress", {"progress": "250"}),
            ("d", 1, "progress", {"progress": "junk"}),
            ("e", 0, "create", {"status": "pending"}),
        ],
    )
    got = {r.job_id: r for r in job_progress(updates).collect()}
    assert {k: (r.status, r.progress) for k, r in got.items()} == {
        "a": ("running", 30),
        "b": ("failed", 70),
        "c": ("completed", 100),
        "d": ("running", 100),
        "e": ("pending", 0),
    }
    assert got["a"].started_at == _at(3)
    assert (got["b"].completed_at, got["b"].duration) == (_at(6), 60.0)
    assert (got["c"].started_at, got["c"].duration) == (None, None)


def test_equal_times_follow_the_sequence_and_null_overwrites(spark):
    updates = _updates(
        spark,
        [
            ("a", 0, "update", {"error": "boom", "mode": "append"}),
            ("a", 0, "update", {"error": None}),
            ("a", 0, "update", {"stdout": "x"}),
        ],
    )
    row = latest_fields(updates).head()
    assert (row.error, row.mode, row.stdout, row.table_name) == (None, "append", "x", None)


def test_one_job_with_most_updates(spark):
    hot = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("j"), F.col("id") % 1000))
        .otherwise("hot").alias("job_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("update_ts"),
        F.col("id").alias("seq"),
        F.when(F.col("id") == 50_000, "complete").otherwise("progress").alias("kind"),
        F.when(F.col("id") == 50_000, F.create_map(F.lit("status"), F.lit("failed")))
        .otherwise(F.create_map(F.lit("progress"), (F.col("id") % 101).cast("string")))
        .alias("fields"),
    )
    row = job_progress(hot).where("job_id = 'hot'").head()
    assert (row.status, row.progress) == ("failed", 49_999 % 101)


def test_retention_rewrites_the_table(spark, db):
    table = f"{db}.jobs"
    now = datetime.datetime(2024, 3, 1)
    rows = [
        (f"j{i:03}", now - datetime.timedelta(days=i), 0, "create", {"status": "pending"})
        for i in range(60)
    ]
    rows.append(("test_x", now, 0, "create", {"status": "pending"}))
    rows.append(("bare", now - datetime.timedelta(days=3), 0, "progress", {"progress": "5"}))
    write_table(spark.createDataFrame(rows, UPDATE_SCHEMA), table)
    states = job_states(load_history(spark, table))
    assert [r.job_id for r in latest_jobs(states, limit=2).collect()] == ["j000", "j001"]
    assert latest_jobs(states, limit=1, include_test=True).head().job_id == "j000"
    apply_retention(spark, table, F.lit("2024-03-01").cast("timestamp_ntz"), keep=20)
    left = {r.job_id for r in load_history(spark, table).collect()}
    assert left == {f"j{i:03}" for i in range(18)} | {"test_x", "bare"}
    apply_retention(spark, table, F.lit("2024-03-01").cast("timestamp_ntz"), days=5)
    assert load_history(spark, table).count() == 8


def test_job_log(spark, db):
    log = JobLog(spark, f"{db}.jobs", "x")
    log.create(table_name="t", is_test=True)
    log.update(rows_processed=5)
    log.complete(False, error="no")
    state = job_states(load_history(spark, f"{db}.jobs")).head()
    assert (state.status, state.error, state.rows_processed, state.is_test) == (
        "failed",
        "no",
        "5",
        True,
    )


def test_progress_between_start_and_end(spark):
    seen = []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "mine")
    try:
        with task_progress(spark, seen.append, 0.005):
            for _ in range(2):
                spark.range(0, 400_000, 1, 200).repartition(3).write.format("noop").mode(
                    "overwrite"
                ).save()
        assert seen and seen == sorted(set(seen)) and 0 < seen[0] and seen[-1] <= 99
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
