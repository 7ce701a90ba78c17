"""Quoted cells that run over line ends: records put together over several tasks."""

from __future__ import annotations

import random

import pytest

from tableload import Dialect, ingest_dir, load_csv, read_ingested, read_table, read_text
from tableload.session import scratch_database, scratch_path
from tableload.sources.records import any_open, block_starts, joined_records, text_lines


@pytest.fixture(scope="module")
def db(spark):
    return scratch_database(spark)


@pytest.fixture
def tiny_blocks(spark):
    """Splits files into blocks of 64 bytes, so that records cross them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_two_rows_of_a_split_cell(spark, db, write_file):
    path = write_file('a,b\n1,"x\n2,y"\n3,z\n')
    assert rows(read_text(spark, path)) == [("1", "x\n2,y"), ("3", "z")]
    result = load_csv(spark, path, f"{db}.two")
    assert (result.success, result.rows_processed, result.ragged) == (True, 2, 0)
    plan = load_csv(spark, path, f"{db}.two", dry_run=True)
    assert (plan.success, plan.rows_processed, plan.ragged) == (True, 2, 0)


def test_lines_tell_what_they_leave_open(spark, write_file):
    cases = [
        # line, open behind it if nothing was open, if a cell was
        ("a,b", False, True), ('"a",b', False, False), ('a,"b', True, False),
        ('a,"b""', True, False), ('a,"b""c"', False, False), ('5" pipe,x', False, False),
        ('5" pipe,"x', True, True), ('x",y', False, False), ('x",y,"z', True, True),
        ('"a"b,"c"d', False, False), ('"', True, False), ('""', False, True),
        ('"""', True, False), (',,"', True, False), (' "a', False, False),
        ('x"",y', False, True), ('"a"",b', True, False), ('x"junk"y,z', False, False),
    ]
    path = write_file("\n".join(c[0] for c in cases))
    found = text_lines(spark, path, ",", '"').orderBy("place").collect()
    assert [(r.value, r.if_out, r.if_in) for r in found] == cases
    long = 'a,"' + 'b""' * 200_000 + '",' + "x," * 200_000 + '"'
    row = text_lines(spark, write_file(long, "long.csv"), ",", '"').head()
    assert (row.if_out, row.if_in) == (True, True)


@pytest.mark.parametrize("seed", range(6))
def test_random_text_reads_as_multiline(spark, tmp_path, tiny_blocks, seed):
    rng = random.Random(seed)
    end = "\r\n" if seed % 2 else "\n"

    def cell():
        kind = rng.randrange(6)
        if kind == 0:
            return "".join(rng.choice("abc é") for _ in range(rng.randrange(1, 30)))
        if kind == 1:
            return 'x"y' if seed % 3 else "z"
        inner = "".join(rng.choice(['""', ",", end, "w", " ", "é"]) for _ in range(rng.randrange(40)))
        return f'"{inner}v"'

    for f in range(3):
        lines = [f"{f}{i},{cell()},{cell()}" for i in range(80)]
        (tmp_path / f"{f}.csv").write_bytes((end.join(["k,a,b", *lines]) + end * (f % 2)).encode())
    path = str(tmp_path)
    lines = text_lines(spark, path, ",", '"')
    assert any_open(lines) and lines.rdd.getNumPartitions() > 10
    assert block_starts(lines).count() > 3
    got = read_text(spark, path, ragged_flag="odd")
    whole = read_text(spark, path, Dialect(multiline=True), ragged_flag="odd")
    assert rows(got) == rows(whole) and got.count() == 240
    assert rows(read_text(spark, path).select("b")) == rows(whole.select("b"))


def test_a_record_over_many_blocks_and_an_unclosed_one(spark, tmp_path, tiny_blocks):
    long = "line,\n" * 200
    text = f'1,"{long}",x\n2,"{long}end",y\n3,z,"never closed\nlast'
    (tmp_path / "a.csv").write_text(text)
    got = rows(read_text(spark, str(tmp_path), Dialect(header=False)))
    assert got == [("1", long, "x"), ("2", long + "end", "y"), ("3", "z", "never closed\nlast")]
    # The same if blocks' states are joined by shuffles, which move lines.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(read_text(spark, str(tmp_path), Dialect(header=False))) == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_headers_marks_blank_lines_and_other_dialects(spark, tmp_path, write_file):
    (tmp_path / "a.csv").write_text('﻿k;v\n\n1;\'a\nb\'\n  \n2;c\n')
    (tmp_path / "b.csv").write_text("\n\nk;v\n3;'d\n\ne'\n")
    semi = Dialect(sep=";", quote="'")
    assert rows(read_text(spark, str(tmp_path), semi, names=["k", "v"], check_header=True)) == [
        ("1", "a\nb"), ("2", "c"), ("3", "d\n\ne"),
    ]
    (tmp_path / "c.csv").write_text("v;k\n4;5\n")
    with pytest.raises(Exception, match="header differs"):
        read_text(spark, str(tmp_path), semi, names=["k", "v"], check_header=True).collect()
    latin = tmp_path / "l.txt"
    latin.write_bytes('k,v\n1,"é\nà"\n'.encode("latin-1"))
    assert rows(read_text(spark, str(latin), Dialect(encoding="ISO-8859-1"))) == [("1", "é\nà")]
    double = write_file('k||v\n1||"a||b\nc"\n', "double.csv")
    assert rows(read_text(spark, double, Dialect(sep="||"))) == [("1", "a||b\nc")]
    lines = text_lines(spark, write_file("", "empty.csv"), ",", '"')
    assert not any_open(lines) and joined_records(lines, header=True).count() == 0


def test_ragged_rows_count_alike_in_load_dry_run_and_ingest(spark, db, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a [1] {x}.csv").write_text('Key A,v,w\n1,"x\ny",LOST,MORE\n2\n3,z,q\n')
    (folder / "b.csv").write_text("Key A,v,w\n4,p\n5,r,s,t\n")
    table = f"{db}.ragged"
    plan = load_csv(spark, str(folder), table, dry_run=True)
    done = load_csv(spark, str(folder), table)
    assert (plan.rows_processed, plan.ragged) == (done.rows_processed, done.ragged) == (5, 4)
    checkpoint = scratch_path(spark, "checkpoint")
    got = ingest_dir(spark, str(folder), f"{db}.in", checkpoint, exclude="w")
    assert (got.rows, got.ragged, got.batches) == (5, 4, 1)
    stored = read_ingested(spark, f"{db}.in")
    assert stored.columns == ["Key_A", "v"]
    assert rows(stored) == rows(read_table(spark, table).drop("w"))
    assert ("1", "x\ny") in [(str(r.Key_A), r.v) for r in stored.collect()]
    (folder / "c.csv").write_text('Key A,v,w\n6,"m\n\nn",o\n')
    more = ingest_dir(spark, str(folder), f"{db}.in", checkpoint, exclude="w")
    assert (more.rows, more.ragged) == (1, 0) and read_ingested(spark, f"{db}.in").count() == 6
