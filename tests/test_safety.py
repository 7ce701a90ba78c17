"""Loads that must fail, and what they must leave behind."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tableload import Dialect, Transform, ingest_dir, load_csv, read_table, write_table
from tableload.session import scratch_database, scratch_path
from tableload.sinks.catalog import table_storage, table_transforms
from tableload.streaming.ingest import read_ingested


@pytest.fixture
def db(spark):
    return scratch_database(spark)


@pytest.mark.parametrize("parts", [[], [Transform("g")], [Transform("id", "bucket", 3)]])
@pytest.mark.parametrize("replace_schema", [True, False])
def test_a_failed_overwrite_keeps_the_old_rows(spark, db, parts, replace_schema):
    name = f"{db}.t"
    write_table(spark.range(20).selectExpr("id", "id % 4 as g"), name, transforms=parts, using="orc")
    bad = spark.range(50).select(
        F.when(F.col("id") == 49, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"),
        (F.col("id") % 4).alias("g"),
    )
    options = dict(mode="overwrite", replace_schema=replace_schema)
    given = parts if replace_schema else []
    with pytest.raises(Exception, match="stop"):
        write_table(bad, name, transforms=given, **options)
    assert read_table(spark, name).count() == 20
    for _ in range(2):  # a frame may read the table it replaces, again and again
        own = read_table(spark, name).where("id < 100").select((F.col("id") + 1).alias("id"), "g")
        write_table(own, name, transforms=given, **options)
        rows = read_table(spark, name)
        assert rows.count() == 20 and table_transforms(spark, name) == parts
    assert rows.agg(F.min("id")).head()[0] == 2 and table_storage(spark, name)[0] == "orc"
    write_table(rows.limit(3), name)
    assert read_table(spark, name).count() == 23


def test_other_transforms_on_append_are_refused(spark, db):
    name = f"{db}.t"
    odd = Transform("a;b'c", "truncate", 2)
    write_table(spark.createDataFrame([("xyz", 1)], "`a;b'c` string, n int"), name, transforms=[odd])
    assert table_transforms(spark, name) == [odd]
    with pytest.raises(ValueError, match="laid out by"):
        write_table(read_table(spark, name), name, transforms=[Transform("n")])


def test_files_with_another_header_fail_the_load(spark, db, tmp_path):
    for i, text in enumerate(["id,name\n1,a\n", "name,id\nb,2\n"]):
        (tmp_path / f"{i}.csv").write_text(text)
    result = load_csv(spark, str(tmp_path), f"{db}.t")
    assert not result.success and "header" in result.error.lower()
    assert not spark.catalog.tableExists(f"{db}.t")


def test_newlines_in_quotes_stay_in_their_rows(spark, db, write_file):
    path = write_file('id,text,n\n1,"two\nlines",3\n2,one,4\n')
    blind = load_csv(spark, path, f"{db}.t", dialect=Dialect(quoted_newlines=False))
    assert not blind.success and "multiline=True" in blind.error
    assert not spark.catalog.tableExists(f"{db}.t")
    for dialect in (Dialect(), Dialect(multiline=True)):
        result = load_csv(spark, path, f"{db}.t", dialect=dialect, mode="overwrite")
        assert (result.rows_processed, result.ragged) == (2, 0)
        assert read_table(spark, f"{db}.t").where("id = 1").head()["text"] == "two\nlines"


def test_ragged_rows_are_reported(spark, db, write_file):
    result = load_csv(spark, write_file("id,name\n1,ann,LOST\n2\n3,x\n"), f"{db}.t")
    assert result.success and (result.rows_processed, result.ragged) == (3, 2)


def test_ingest_refuses_other_headers_and_null_in_required_columns(spark, db, tmp_path):
    folder, checkpoint = tmp_path / "in", scratch_path(spark, "checkpoint")
    folder.mkdir()
    (folder / "a.csv").write_text("id,name\n1,a\n")
    schema = '[{"name": "id", "type": "Integer", "required": true}, {"name": "name", "type": "String"}]'
    ingest_dir(spark, str(folder), f"{db}.t", checkpoint, schema=schema)
    (folder / "b.csv").write_text("name,id\nb,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        ingest_dir(spark, str(folder), f"{db}.t", checkpoint, schema=schema)
    (folder / "b.csv").write_text("id,name\n,b\n")
    with pytest.raises(Exception, match="required column id"):
        ingest_dir(spark, str(folder), f"{db}.t", checkpoint, schema=schema)
    assert [tuple(r) for r in read_ingested(spark, f"{db}.t").collect()] == [(1, "a")]


def test_a_bad_history_table_is_reported(spark, db, write_file):
    result = load_csv(spark, write_file("id\n1\n"), f"{db}.t", history_table="a.b.c.d.e")
    assert not result.success and result.error
