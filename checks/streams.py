"""Incremental loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableload.operators.layout import Transform
from tableload.session import scratch_database, scratch_path
from tableload.sources.csv import Dialect
from tableload.streaming.ingest import ingest_dir, ingested_profile, read_ingested
from tableload.streaming.job_states import (
    follow_job_states,
    followed_states,
    merge_job_states,
)

from .history import LATEST_SQL, STATE_FIELDS, updates
from .registry import append_csv, dealt, query, table, write_csv

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("stream_ingest", f"SELECT {_ORDERS} FROM orders")
def stream_ingest(spark, sf_dir):
    path = write_csv(table(spark, sf_dir, "orders").repartition(4, "o_orderkey"), "orders")
    target = f"{scratch_database(spark)}.orders"
    ingest_dir(spark, path, target, scratch_path(spark, "checkpoint"), max_files_per_batch=2)
    return read_ingested(spark, target)


@query("stream_ingest_partitioned", f"SELECT {_ORDERS} FROM orders")
def stream_ingest_partitioned(spark, sf_dir):
    path = write_csv(table(spark, sf_dir, "orders"), "orders")
    target = f"{scratch_database(spark)}.orders"
    year = Transform("o_orderdate", "year")
    checkpoint = scratch_path(spark, "checkpoint")
    ingest_dir(spark, path, target, checkpoint, transforms=[year])
    # Nothing new has arrived: a second run adds nothing.
    ingest_dir(spark, path, target, checkpoint, transforms=[year])
    return read_ingested(spark, target)


@query(
    "stream_ingest_compacted",
    f"""SELECT {_ORDERS}, 3 AS partitions FROM orders""",
)
def stream_ingest_compacted(spark, sf_dir):
    """Twelve batches end as two merges, of seven and of four, and the newest batch."""
    orders = table(spark, sf_dir, "orders").withColumn("file", F.pmod("o_orderkey", F.lit(12)))
    target, checkpoint = f"{scratch_database(spark)}.orders", scratch_path(spark, "checkpoint")
    path = scratch_path(spark, "orders")
    for low, high in ((0, 7), (8, 11)):
        some = orders.where(F.col("file").between(low, high))
        for file in range(low, high + 1):
            append_csv(some.where(F.col("file") == file).drop("file"), path)
        ingest_dir(spark, path, target, checkpoint, max_files_per_batch=1, merge_keep=1)
    partitions = spark.sql(f"SHOW PARTITIONS {target}").count()
    return read_ingested(spark, target).withColumn("partitions", F.lit(partitions))


@query("stream_job_state_merged", LATEST_SQL)
def stream_job_state_merged(spark, sf_dir):
    target = _followed(spark, sf_dir)
    merge_job_states(spark, target)
    return followed_states(spark, target)


@query("stream_job_state", LATEST_SQL)
def stream_job_state(spark, sf_dir):
    return followed_states(spark, _followed(spark, sf_dir))


def _followed(spark, sf_dir):
    """Events as a stream of job updates, folded in three batches; returns the log's name."""
    events = table(spark, sf_dir, "events")
    folder = scratch_path(spark, "events")
    events.repartition(3, "event_id").write.parquet(folder)
    log = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    )
    target = f"{scratch_database(spark)}.states"
    follow_job_states(
        updates(log), target, scratch_path(spark, "checkpoint"), fields=STATE_FIELDS
    )
    return target


@query(
    "ingest_ragged",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE lang END AS lang,
              length("text") AS chars,
              (SELECT count(*) FILTER (doc_id % 7 IN (2, 3)) FROM documents) AS ragged
       FROM documents""",
)
def ingest_ragged(spark, sf_dir):
    """Two batches of texts with newlines in quoted cells, and rows too long or too short."""
    text = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    form = F.col("doc_id") % 7
    line = F.when(form == 3, F.concat_ws(",", "doc_id", text)).otherwise(
        F.concat_ws(",", "doc_id", text, "lang")
    )
    line = F.when(form == 2, F.concat(line, F.lit(",surplus"))).otherwise(line)
    docs = table(spark, sf_dir, "documents")
    target, path = f"{scratch_database(spark)}.docs", scratch_path(spark, "docs")
    checkpoint, ragged = scratch_path(spark, "checkpoint"), 0
    for half in (0, 1):
        some = docs.where(F.col("doc_id") % 2 == half).select(line.alias("value"))
        dealt(some).write.mode("append").option("extension", "csv").text(path)
        schema = """[{"name": "col_0", "type": "Long"}, {"name": "col_1"}, {"name": "col_2"}]"""
        result = ingest_dir(
            spark, path, target, checkpoint, dialect=Dialect(header=False), schema=schema
        )
        ragged += result.ragged
    return read_ingested(spark, target).select(
        F.col("col_0").alias("doc_id"),
        F.col("col_2").alias("lang"),
        F.length("col_1").cast("bigint").alias("chars"),
        F.lit(ragged).cast("bigint").alias("ragged"),
    )


@query(
    "ingested_profile",
    """SELECT 'o_orderstatus' AS "column", count(*) AS total_values, 0 AS null_count,
              1.0 - (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))
                / count(*)::DOUBLE AS evenness, 0.0::DOUBLE AS evenness_error, 4 AS batches
       FROM orders
       UNION ALL
       SELECT 'o_orderpriority', count(*), 0,
              1.0 - (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))
                / count(*)::DOUBLE, 0.0::DOUBLE, 4 FROM orders""",
)
def ingested_profile_of_batches(spark, sf_dir):
    """The profile of four batches, added up from their sketches."""
    path = write_csv(table(spark, sf_dir, "orders").repartition(4, "o_orderkey"), "orders")
    database, checkpoint = scratch_database(spark), scratch_path(spark, "checkpoint")
    result = ingest_dir(
        spark, path, f"{database}.orders", checkpoint, max_files_per_batch=1,
        profile_table=f"{database}.sketches",
    )
    found = ingested_profile(spark, f"{database}.sketches").where("evenness is not null")
    return found.select(
        "column", "total_values", F.col("null_count").cast("int").alias("null_count"), "evenness",
        "evenness_error", F.lit(result.batches).alias("batches"),
    )
