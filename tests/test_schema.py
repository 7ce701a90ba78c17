"""Inference, declarations and compatibility."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableload import apply_schema, compare_schemas, declared_schema, edit_schema, infer_schema
from tableload import schema_of, schema_verdict, types_compatible
from tableload.functions.fixed import ACCEPTED_TYPES
from tableload.functions.typenames import declared_type, sql_type, type_label
from tableload.operators.schema import (
    create_table_sql,
    required_violations,
    schema_problems,
    schema_rows,
)

KINDS = {
    "true": "boolean",
    "FALSE": "boolean",
    "t": "string",
    "truer": "string",
    "12": "bigint",
    "+12": "bigint",
    "-0": "bigint",
    "0012": "bigint",
    "9223372036854775807": "bigint",
    "9223372036854775808": "string",
    "12345678901234567890": "string",
    "1.5": "double",
    ".5": "double",
    "5.": "double",
    "-1.5E-3": "double",
    "123e-5": "double",
    "1e400": "double",
    "1d": "string",
    "NaN": "string",
    "Infinity": "string",
    "0x10": "string",
    ".": "string",
    "+": "string",
    "1,5": "string",
    " 1": "string",
    "1 ": "string",
    "1\n": "string",
    "2024-01-02": "date",
    "2024/01/02": "date",
    "2024-13-02": "string",
    "2024-02-30": "string",
    "2024-1-2": "string",
    "2024": "bigint",
    "2024-01-02T03:04": "timestamp_ntz",
    "2024-01-02 03:04:05": "timestamp_ntz",
    "2024-01-02 03:04:05.123456": "timestamp_ntz",
    "2024-01-02 03:04:05.123456789": "timestamp_ntz",
    "2024-01-02 25:04:05": "string",
    "2024/01/02 03:04:05": "string",
    "2024-01-02T03:04:05Z": "string",
    "2024-01-02T03:04:05+02:00": "string",
    "03:04:05": "string",
}


def test_every_kind_of_cell(spark):
    cells = list(KINDS)
    names = [f"c{i}" for i in range(len(cells))]
    df = spark.createDataFrame([tuple(cells)], ", ".join(f"{n} string" for n in names))
    schema = infer_schema(df)
    assert {c: f.dataType.simpleString() for c, f in zip(cells, schema)} == KINDS
    values = apply_schema(df, schema).head()
    lost = [c for c, v in zip(cells, values) if v is None]
    assert lost == []


@pytest.mark.parametrize(
    ("cells", "expected"),
    [
        (["1", None], "bigint"),
        (["1", "1.5"], "double"),
        (["1", "true"], "string"),
        (["2024-01-02", "2024-01-02 03:04"], "timestamp_ntz"),
        (["2024-01-02", "7"], "string"),
        (["1.5", "2024-01-02 03:04"], "string"),
        ([None, None], "string"),
    ],
)
def test_mixed_columns(spark, cells, expected):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert infer_schema(df)["c"].dataType.simpleString() == expected


def test_inferred_fields(spark):
    df = spark.createDataFrame([("1", "x")], "` a ` string, b string")
    schema = infer_schema(df)
    assert [(f.name, f.metadata["field_id"], f.nullable) for f in schema] == [
        ("a", 1, True),
        ("b", 2, True),
    ]


def test_parsed_values(spark):
    df = spark.createDataFrame(
        [("7", "1.25", "2024/01/02", "2024-01-02", "TRUE", "1.005", "3000000000")],
        "i string, d string, day string, ts string, b string, m string, n string",
    )
    schema = T.StructType.fromDDL(
        "i int, d float, day date, ts timestamp_ntz, b boolean, m decimal(38,10), n int"
    )
    row = apply_schema(df, schema).head()
    assert row[:5] == (
        7,
        1.25,
        datetime.date(2024, 1, 2),
        datetime.datetime(2024, 1, 2),
        True,
    )
    assert str(row.m) == "1.0050000000" and row.n is None


def test_declared_types():
    schema = declared_schema(
        '[{"id": 4, "name": "a", "type": "Long", "required": true},'
        ' {"name": "b", "type": "Decimal"}, {"name": "c", "type": "decimal(38,18)"},'
        ' {"name": "d", "type": "Blob"}, {"name": "e"}]'
    )
    assert [f.dataType.simpleString() for f in schema] == [
        "bigint",
        "decimal(38,10)",
        "decimal(38,18)",
        "string",
        "string",
    ]
    assert [f.nullable for f in schema] == [False, True, True, True, True]
    assert [f.metadata["field_id"] for f in schema] == [4, 2, 3, 4, 5]
    assert declared_type("int") == T.IntegerType()


def test_required_column_fails_the_job(spark):
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    schema = declared_schema([{"name": "a", "type": "Long", "required": True}])
    counted = required_violations(apply_schema(df, schema), schema)
    assert [tuple(r) for r in counted.collect()] == [("a", 1)]
    with pytest.raises(Exception, match="required column a holds a null"):
        apply_schema(df, schema, enforce_required=True).collect()


def test_edit_schema(spark):
    df = spark.createDataFrame([("1", "2", "3")], "a string, b string, c string")
    schema = edit_schema(infer_schema(df), rename={"a": "x"}, retype={"b": "string"}, remove=["c"])
    again = edit_schema(schema, rename={"x": "y"})
    typed = apply_schema(df, again)
    assert typed.columns == ["y", "b"]
    assert tuple(typed.head()) == (1, "2")


def test_schema_of_frame(spark):
    ddl = (
        "`a b` tinyint, c smallint, d array<int>, e struct<x:int>, f binary, g timestamp,"
        " h decimal(9,2), i map<string,int>, j float, k date"
    )
    schema = schema_of(spark.createDataFrame([], ddl))
    assert schema.names[0] == "a_b"
    labels = [type_label(f.dataType) for f in schema]
    assert labels == [
        "integer", "integer", "string", "string", "string", "timestamp", "decimal(9,2)",
        "string", "float", "date",
    ]
    assert [sql_type(f.dataType) for f in schema][-4:] == ["DECIMAL(9, 2)", "VARCHAR", "REAL", "DATE"]


def test_schema_problems(spark):
    def verdict(rows):
        df = spark.createDataFrame(rows, "field_id int, name string")
        return tuple(schema_problems(df).head())

    assert verdict([(1, "a"), (2, "b")]) == (2, 0, 0, True)
    assert verdict([(1, "a"), (1, "a")]) == (2, 1, 1, False)
    assert verdict([]) == (0, 0, 0, False)


def test_create_table_text():
    schema = T.StructType.fromDDL("a bigint not null, `b c` string")
    assert create_table_sql("`x`.`y`", schema) == (
        "CREATE TABLE `x`.`y` (`a` BIGINT NOT NULL, `b c` STRING) USING parquet"
    )


TYPES = [
    "BOOLEAN", "INTEGER", "BIGINT", "REAL", "DOUBLE", "DATE", "TIMESTAMP(3)", "VARCHAR",
    "CHAR", "DECIMAL(38, 10)", "ROW(a integer)", "timestamp(6) with time zone", "varchar(20)",
]


def test_type_compatibility_matrix(spark):
    pairs = [(a, b) for a in TYPES for b in TYPES]
    df = spark.createDataFrame(pairs, "old string, new string")
    got = {
        (r.old, r.new): r.ok
        for r in df.select("*", types_compatible(df.old, df.new).alias("ok")).collect()
    }

    def expected(old, new):
        a, b = (t.split("(")[0].strip().upper() for t in (old, new))
        if a == b or all("TIMESTAMP" in t for t in (a, b)) or all("DATE" in t for t in (a, b)):
            return True
        return b in ACCEPTED_TYPES[a] if a in ACCEPTED_TYPES else True

    assert got == {p: expected(*p) for p in pairs}
    surprises = {
        ("DOUBLE", "BIGINT"): False,
        ("VARCHAR", "REAL"): False,
        ("VARCHAR", "DECIMAL(38, 10)"): False,
        ("BIGINT", "REAL"): False,
        ("DECIMAL(38, 10)", "BOOLEAN"): True,
        ("INTEGER", "BIGINT"): True,
        ("DATE", "TIMESTAMP(3)"): True,
    }
    assert {k: got[k] for k in surprises} == surprises


@pytest.mark.parametrize(
    ("matched", "mismatched", "total", "ok"),
    [(7, 3, 10, True), (6, 0, 10, False), (10, 4, 10, False), (10, 3, 10, True), (0, 0, 0, False)],
)
def test_verdict_thresholds(spark, matched, mismatched, total, ok):
    inferred = T.StructType([T.StructField(f"c{i}", T.LongType()) for i in range(total)])
    old = [
        T.StructField(f"C{i}", T.DoubleType() if i < mismatched else T.LongType())
        for i in range(matched)
    ]
    existing = schema_rows(spark, T.StructType([*old, T.StructField("extra", T.StringType())]))
    comparison = compare_schemas(existing, schema_rows(spark, inferred))
    verdict = schema_verdict(comparison).head()
    assert verdict["compatible"] == ok
    assert (verdict["matched"], verdict["mismatched"]) == (matched, mismatched)


def test_quoted_existing_names(spark):
    existing = spark.createDataFrame([('"A"', "BIGINT")], "name string, sql_type string")
    inferred = schema_rows(spark, T.StructType([T.StructField("a", T.LongType())]))
    assert compare_schemas(existing, inferred).select(F.col("matched")).head()[0]
