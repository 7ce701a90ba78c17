"""Overwrites that a crash cuts off, and what an overwrite keeps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tableload import Transform, load_csv, read_table, write_table
from tableload.session import scratch_database, scratch_path
from tableload.sinks import overwrite
from tableload.sinks.catalog import (
    create_table,
    resolve_table,
    set_properties,
    table_details,
    table_exists,
    table_properties,
    table_transforms,
)

STEPS = ["written", "described", "committed", "dropped", "renamed", "copied", "home", "removed", "placed"]


class Crash(Exception):
    pass


@pytest.fixture(scope="module")
def db(spark):
    return scratch_database(spark)


def frame(spark, start, end):
    return spark.range(start, end).select(
        "id", (F.col("id") % 3).cast("string").alias("g"), F.lit("it's").alias("s")
    )


def make(spark, name, external, parts):
    ids = "id BIGINT COMMENT 'it''s an \\\\ id'"
    place = f"LOCATION '{scratch_path(spark, 'mine')}'" if external else ""
    layout = "PARTITIONED BY (g)" if parts else ""
    spark.sql(
        f"CREATE TABLE {name} ({ids}, s STRING, g STRING) USING orc {layout} {place} "
        "COMMENT 'a table''s comment'"
    )
    if parts:
        set_properties(spark, name, {"tableload.transforms": '[["g", "identity", null]]'})
    set_properties(spark, name, {"it's": "a 'value' \\ here"})
    write_table(frame(spark, 0, 20), name)


@pytest.mark.parametrize("parts", [[], [Transform("g")]])
@pytest.mark.parametrize("external", [False, True])
@pytest.mark.parametrize("replace_schema", [False, True])
def test_a_crash_between_any_steps_leaves_old_or_new(
    spark, db, monkeypatch, external, parts, replace_schema
):
    name = f"{db}.crash_{external}_{bool(parts)}_{replace_schema}".lower()
    make(spark, name, external, parts)
    home = table_details(spark, name).location
    given = parts if replace_schema else []
    reached = []
    for i, step in enumerate(STEPS):
        before = read_table(spark, name).agg(F.min("id")).head()[0]
        start = 100 * (i + 1)

        def crash(done, step=step):
            if done == step:
                reached.append(step)
                raise Crash(step)

        monkeypatch.setattr(overwrite, "_step", crash)
        try:
            write_table(
                frame(spark, start, start + 10), name, mode="overwrite",
                replace_schema=replace_schema, transforms=given,
            )
        except Crash:
            pass
        monkeypatch.setattr(overwrite, "_step", lambda done: None)
        rows = read_table(spark, name)
        counted = rows.agg(F.min("id"), F.max("id"), F.count("*")).head()
        old = (before, 19 if before == 0 else before + 9, 20 if before == 0 else 10)
        new = (start, start + 9, 10)
        assert tuple(counted) == (old if step in STEPS[:2] else new), step
        # Nothing is left half done, and plain readers see the same.
        assert spark.table(name).count() == counted[2]
        assert not table_exists(spark, overwrite.next_table(name)) or step in STEPS[:2]
        if parts:
            assert spark.table(name).where("g = '1'").count() == rows.where("g = '1'").count() > 0
    assert reached == [s for s in STEPS if external or s not in ("copied", "home", "removed")]

    details = table_details(spark, name)
    assert details.location.rstrip("/") == home.rstrip("/")
    assert details.managed is not external and details.provider == "orc"
    assert details.comment == "a table's comment"
    kept = table_properties(spark, name)
    assert kept["it's"] == "a 'value' \\ here" and not [k for k in kept if k == overwrite.REPLACES]
    assert table_transforms(spark, name) == parts
    assert spark.table(name).schema["id"].metadata["comment"] == "it's an \\ id"
    if external:  # others who read the folder see the new rows alone
        assert spark.read.orc(home).count() == 10
    write_table(frame(spark, 0, 5), name)
    assert read_table(spark, name).count() == 15
    spark.sql(f"DROP TABLE {name}")
    if not external:
        create_table(spark, resolve_table(spark, name), frame(spark, 0, 1).schema)


def test_files_of_an_unfinished_write_are_no_hindrance(spark, db):
    name = resolve_table(spark, f"{db}.left")
    write_table(frame(spark, 0, 3), name)
    folder = spark.catalog.getDatabase(db).locationUri.rstrip("/")
    spark.range(3).write.parquet(f"{folder}/left__tableload_next")
    write_table(frame(spark, 5, 7), name, mode="overwrite")
    assert read_table(spark, name).count() == 2


def test_a_load_finishes_what_a_crash_left(spark, db, monkeypatch, write_file):
    name = f"{db}.loaded"
    path = write_file("id,v\n1,a\n2,b\n")
    assert load_csv(spark, path, name).success

    def crash(done):
        if done == "dropped":
            raise Crash(done)

    monkeypatch.setattr(overwrite, "_step", crash)
    failed = load_csv(spark, write_file("id,v\n3,c\n", "b.csv"), name, mode="overwrite")
    assert not failed.success and not spark.catalog.tableExists(name)
    monkeypatch.setattr(overwrite, "_step", lambda done: None)
    assert load_csv(spark, path, name).success
    assert sorted(r.id for r in read_table(spark, name).collect()) == [1, 2, 3]


def test_odd_names_in_ddl(spark, db):
    place = scratch_path(spark, "it's")
    create_table(
        spark, f"{db}.odd", frame(spark, 0, 1).schema, location=place,
        properties={"a'b": "c\\d'"},
    )
    assert table_properties(spark, f"{db}.odd")["a'b"] == "c\\d'"
    assert table_details(spark, f"{db}.odd").location.endswith(place.rsplit("/", 1)[1])
