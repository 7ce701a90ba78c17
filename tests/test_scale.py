"""The queries' input is dealt over as many files as its bytes ask for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import REGISTRY, sinks, streams


@pytest.mark.parametrize("name", ["load_split_quotes", "ingest_ragged", "write_overwrite_large"])
def test_no_file_holds_a_fixed_share_of_the_table(spark, tmp_path, monkeypatch, name):
    folders = []

    def noted(function):
        def run(*args, **options):
            folders.append(function(*args, **options))
            return folders[-1]

        return run

    monkeypatch.setattr(sinks, "write_csv", noted(sinks.write_csv))
    monkeypatch.setattr(streams, "scratch_path", noted(streams.scratch_path))
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit("\n"), F.sha2(F.hex("id"), 512)).alias("text"),
        F.lit("en").alias("lang"),
    )
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    lines = spark.range(120_000).select(
        F.xxhash64("id").alias("l_orderkey"), F.lit(1).cast("long").alias("l_linenumber"),
        F.rand(1).alias("l_quantity"), F.timestamp_seconds("id").alias("l_shipdate"),
    )
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        assert REGISTRY[name].run(spark, str(tmp_path)).count() > 0
    finally:
        for key in small:
            spark.conf.unset(key)
    sizes = []
    for folder in folders:
        if "/docs-" in folder or folder.rsplit("/", 1)[-1].startswith(("documents-", "lineitem-")):
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,txt}").load(folder)
            sizes = sorted(r.length for r in files.select("length").collect())
    assert len(sizes) >= 8, sizes
    assert sizes[-1] < sum(sizes) / 6
