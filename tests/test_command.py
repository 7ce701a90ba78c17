"""The spark-submit command."""

from __future__ import annotations

import json

from tableload.__main__ import run
from tableload.session import scratch_database


def test_load_and_dry_run(spark, write_file, capsys):
    path = write_file("id;day\n1;2024-01-02\n2;2024-02-03\n")
    target = f"{scratch_database(spark)}.t"
    common = ["load", "--csv", path, "--table", target, "--delimiter", ";"]
    assert run(spark, [*common, "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["dry_run"]["total_rows"] == 2
    assert run(spark, [*common, "--partition", "month(day)"]) == 0
    assert json.loads(capsys.readouterr().out)["rows_processed"] == 2
    assert spark.table(target).columns == ["id", "day", "day_month"]


def test_declared_schema_and_failure(spark, write_file, capsys):
    schema = write_file('[{"name": "id", "type": "Long", "required": true}]', "schema.json")
    target = f"{scratch_database(spark)}.t"
    bad = write_file("id\nx\n")
    assert run(spark, ["load", "--csv", bad, "--table", target, "--schema", schema]) == 1
    assert "required column id" in json.loads(capsys.readouterr().out)["error"]


def test_analyze(spark, write_file, capsys):
    body = "".join(f"{i % 10},2024-01-{1 + i % 20:02}\n" for i in range(100))
    assert run(spark, ["analyze", "--csv", write_file("k,day\n" + body)]) == 0
    shown = capsys.readouterr().out
    assert "BIGINT" in shown and "[year, month, day]" in shown
