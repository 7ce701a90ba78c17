"""Profiles and advice."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tableload import Transform, advise, profile_approx, read_table, write_table
from tableload import profile as profile_by_sketch
from tableload import profile_exact as profile
from tableload.operators.layout import prune_equal, prune_on
from tableload.session import scratch_database
from tableload.functions.display import round_exact, scaled_round
from tableload.operators.advise import score_columns
from pyspark.sql import functions as F


def test_profile_against_brute_force(spark):
    rng = random.Random(7)
    long_text = "lorem ipsum " * 20
    data = []
    for i in range(3000):
        data.append(
            (
                rng.choice([None, 1, 2, 3]),
                rng.choice([0.5, -0.0, 0.0, None, 1e300]),
                "hot" if i % 3 == 0 else f"v{rng.randrange(500)}",
                long_text + str(i % 4) if i % 10 else None,
                rng.choice([True, False, None]),
                None,
                [rng.randrange(3)],
            )
        )
    ddl = "a int, b double, c string, d string, e boolean, f string, g array<int>"
    df = spark.createDataFrame(data, ddl).repartition(5)
    got = {r["column"]: r for r in profile(df).collect()}
    for i, name in enumerate("abcdef"):
        values = [row[i] for row in data]
        counts = Counter(values)
        filled = sum(v is not None for v in values)
        row = got[name]
        assert row["unique_values"] == len(counts)
        assert row["total_values"] == filled
        assert row["null_count"] == len(values) - filled
        if filled:
            assert row["cardinality_ratio"] == len(counts) / filled
            assert row["evenness"] == 1.0 - max(counts.values()) / filled
        else:
            assert row["cardinality_ratio"] is None
    assert got["g"]["class"] == "other" and got["g"]["unique_values"] == 3
    assert "f" not in {r["column"] for r in score_columns(profile(df)).collect()}


def test_profile_approx_is_close(spark):
    df = spark.range(50_000).select(
        "id", (F.col("id") % 97).alias("few"), F.concat(F.lit("k"), F.col("id") % 5).alias("text"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"),
    )
    exact = {r["column"]: r for r in profile(df).collect()}
    for row in profile_approx(df).collect():
        truth = exact[row["column"]]
        assert abs(row["unique_values"] / truth["unique_values"] - 1) < 0.05
        assert (row["total_values"], row["null_count"]) == (
            truth["total_values"],
            truth["null_count"],
        )
        if row["column"] == "text":
            assert row["evenness"] == truth["evenness"]


@pytest.mark.parametrize(
    ("value", "whole", "anywhere"),
    [
        ("2024-01-02", True, True),
        ("02/01/2024", True, True),
        ("on 02-01-2024, paid", False, True),
        ("2024-1-2", False, False),
        ("x" * 90 + "2024/01/02", False, True),
    ],
)
def test_date_like(spark, value, whole, anywhere):
    df = spark.createDataFrame([("plain",), (value,)], "c string")
    for how in (profile, profile_by_sketch):
        assert how(df, date_share=0, anchored=False).head()["date_like"] == anywhere
        assert how(df, date_share=0).head()["date_like"] == whole
        assert not how(df).head()["date_like"]


def test_one_odd_cell_does_not_flip_a_column(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("c"))
    odd = keys.union(spark.createDataFrame([("2024-01-02",)], "c string"))
    dates = odd.select(F.when(F.col("c") == "k1", "late").otherwise("02/01/2024").alias("c"))
    for how in (profile, profile_by_sketch):
        assert not how(odd).head()["date_like"]
        assert how(dates).head()["date_like"]


@pytest.mark.parametrize("kind", ["year", "month", "day"])
def test_text_dates_can_be_laid_out(spark, kind):
    texts = ["01/02/2024", "2024-02-01", "2024/02/01", "12/31/2024", "31-12-2024", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    table = f"{scratch_database(spark)}.t"
    layout = Transform("d", kind)
    write_table(df, table, transforms=[layout])
    first = {"year": "2024", "month": "2024-02", "day": "2024-02-01"}[kind]
    last = {"year": "2024", "month": "2024-12", "day": "2024-12-31"}[kind]
    stored = {r.d: r.part for r in spark.table(table).select(
        "d", F.col(layout.partition_column).cast("string").alias("part")).collect()}
    assert stored == dict(zip(texts, [first] * 3 + [last] * 2 + [None] * 2))
    assert read_table(spark, table).count() == len(texts)
    whole = spark.table(table)
    assert prune_equal(whole, "d", "soon", [layout]).count() == 1
    assert prune_equal(whole, "d", "31-12-2024", [layout]).count() == 1
    assert prune_on(whole, "d", "0", "4", [layout]).count() == 5


def _scored(spark, kind, ratio, unique, evenness, nulls=0):
    total = 10**12
    df = spark.createDataFrame(
        [(1, "c", kind, kind, unique, total, nulls, ratio, evenness)],
        "field_id int, column string, type string, class string, unique_values bigint,"
        " total_values bigint, null_count bigint, cardinality_ratio double, evenness double",
    )
    row = score_columns(df).head()
    names = [
        r["transform"] + (f" {r['width']}" if r["width"] else "") for r in row["recommendations"]
    ]
    return row["suitability_score"], ",".join(names)


DATETIME = [
    (0.9, 5, 70, "year"),
    (0.8999, 5, 90, "year,month"),
    (0.3, 5, 90, "year,month"),
    (0.2999, 5, 95, "year,month,day"),
    (0.05, 5, 95, "year,month,day"),
    (0.0499, 10, 85, "identity"),
    (0.0499, 9, 75, "identity"),
    (0.0499, 3, 75, "identity"),
    (0.0499, 2, 60, "identity"),
]
NUMERIC = [
    (1.2, 1000, 30, "bucket 100"),
    (0.5001, 999, 30, "bucket 10"),
    (0.5, 1000, 75, "bucket 100"),
    (0.3001, 999, 75, "bucket 10"),
    (0.3, 999, 80, "bucket 10"),
    (0.1501, 999, 80, "bucket 10"),
    (0.15, 999, 85, "bucket 10"),
    (0.05, 999, 85, "bucket 10"),
    (0.0499, 999, 60, "bucket 10"),
    (0.0101, 999, 60, "bucket 10"),
    (0.01, 999, 60, "identity"),
    (0.0099, 999, 30, "identity"),
]
STRING = [
    (0.4001, 5, 0.9, 30, "bucket 50"),
    (0.4, 5, 0.9, 70, "truncate 5,bucket 20"),
    (0.2001, 5, 0.1, 70, "truncate 5,bucket 20"),
    (0.2, 500, 0.7, 85, "identity"),
    (0.05, 500, 0.7, 85, "identity"),
    (0.1, 500, 0.6999, 80, "identity"),
    (0.1, 500, 0.5, 80, "identity"),
    (0.1, 500, 0.4999, 50, "bucket 10"),
    (0.1, 500, -3.0, 50, "bucket 10"),
    (0.0499, 199, 0.6, 75, "identity"),
    (0.02, 199, 0.6, 75, "identity"),
    (0.02, 199, 0.5999, 40, "identity"),
    (0.02, 200, 0.9, 30, "bucket 50"),
    (0.0199, 5, 0.8, 60, "identity"),
    (0.0199, 4, 0.8, 20, "identity"),
    (0.0199, 5, 0.7999, 20, "identity"),
]


@pytest.mark.parametrize(("ratio", "unique", "score", "transforms"), DATETIME)
def test_datetime_thresholds(spark, ratio, unique, score, transforms):
    assert _scored(spark, "datetime", ratio, unique, 0.5) == (score, transforms)


@pytest.mark.parametrize(("ratio", "unique", "score", "transforms"), NUMERIC)
def test_numeric_thresholds(spark, ratio, unique, score, transforms):
    assert _scored(spark, "numeric", ratio, unique, None) == (score, transforms)


@pytest.mark.parametrize(("ratio", "unique", "evenness", "score", "transforms"), STRING)
def test_string_thresholds(spark, ratio, unique, evenness, score, transforms):
    assert _scored(spark, "string", ratio, unique, evenness) == (score, transforms)


def test_boolean_and_other(spark):
    assert _scored(spark, "boolean", 0.1, 3, 0.5, nulls=1) == (30, "identity")
    assert _scored(spark, "boolean", 0.1, 2, 0.5) == (20, "")
    assert _scored(spark, "other", 0.1, 2, 0.5) == (0, "")


def test_advice_keeps_five_in_column_order(spark):
    df = spark.range(1000).select(
        *[(F.col("id") % 100 + i).alias(f"n{i}") for i in range(7)],
        F.to_date(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 200).cast("int")))
        .alias("day"),
    )
    chosen = [r["column"] for r in advise(profile(df)).collect()]
    assert chosen == ["day", "n0", "n1", "n2", "n3"]
    assert advise(profile(df), explain_all=True).count() == 8
    assert advise(profile(df), top=2, min_score=90).count() == 1


def test_advice_texts(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("a b"))
    (rec,) = advise(profile(df)).head()["recommendations"]
    assert rec.asDict() == {
        "transform": "bucket",
        "width": 10,
        "description": "Hash into 10 buckets",
        "example": "PARTITION BY bucket(10, a b)",
    }


def test_rounding_is_that_of_the_stored_number(spark):
    rng = random.Random(3)
    values = [rng.randrange(10**6) / 60 for _ in range(4000)]
    values += [rng.randrange(10**9) / 1024 for _ in range(2000)]
    values += [i / 1000 + 0.005 for i in range(2000)] + [0.0, 0.125, 0.375, 2.5, 1.15, 4.165]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(
        "v", round_exact(df.v, 2).alias("two"), scaled_round(df.v, 1).alias("one")
    ).collect()
    assert [r.two for r in got] == [round(r.v, 2) for r in got]
    assert [r.one / 10 for r in got] == [float(f"{r.v:.1f}") for r in got]
