"""Partition layout: transforms applied on write, pruned on read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableload.operators.layout import Transform, prune_equal, prune_on
from tableload.session import scratch_database
from tableload.sinks.table import read_table, write_table

from .registry import query, table


def _written(spark, sf_dir, name, *transforms):
    target = f"{scratch_database(spark)}.{name}"
    write_table(table(spark, sf_dir, name), target, transforms=transforms)
    return target


def _grouped(spark, sf_dir, transform):
    target = _written(spark, sf_dir, "orders", transform)
    return (
        spark.table(target)
        .groupBy(F.col(transform.partition_column).alias("part"))
        .agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))
    )


def _group_sql(expression: str) -> str:
    return f"""SELECT {expression} AS part, count(*) AS "rows",
                      CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1"""


@query("part_identity", _group_sql("o_orderpriority"))
def part_identity(spark, sf_dir):
    return _grouped(spark, sf_dir, Transform("o_orderpriority"))


@query("part_year", _group_sql("CAST(year(o_orderdate) AS INTEGER)"))
def part_year(spark, sf_dir):
    return _grouped(spark, sf_dir, Transform("o_orderdate", "year"))


@query("part_month", _group_sql("strftime(o_orderdate, '%Y-%m')"))
def part_month(spark, sf_dir):
    return _grouped(spark, sf_dir, Transform("o_orderdate", "month"))


@query(
    "part_day",
    """SELECT CAST(ts AS DATE) AS part, count(*) AS "rows", CAST(sum(event_id) AS BIGINT) AS keys
       FROM events GROUP BY 1""",
)
def part_day(spark, sf_dir):
    target = _written(spark, sf_dir, "events", Transform("ts", "day"))
    return (
        spark.table(target)
        .groupBy(F.col("ts_day").alias("part"))
        .agg(F.count("*").alias("rows"), F.sum("event_id").alias("keys"))
    )


@query("part_truncate", _group_sql("substr(o_orderpriority, 1, 5)"))
def part_truncate(spark, sf_dir):
    return _grouped(spark, sf_dir, Transform("o_orderpriority", "truncate", 5))


@query("part_truncate_number", _group_sql("o_custkey - o_custkey % 100"))
def part_truncate_number(spark, sf_dir):
    return _grouped(spark, sf_dir, Transform("o_custkey", "truncate", 100))


@query(
    "part_bucket",
    """SELECT count(*) AS "rows", count(DISTINCT l_orderkey) AS keys,
              CAST(1 AS BIGINT) AS most_buckets_per_key, TRUE AS in_range, TRUE AS spread
       FROM lineitem""",
)
def part_bucket(spark, sf_dir):
    target = _written(spark, sf_dir, "lineitem", Transform("l_orderkey", "bucket", 10))
    per_key = (
        spark.table(target)
        .groupBy("l_orderkey", "l_orderkey_bucket")
        .agg(F.count("*").alias("rows"))
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("buckets"),
            F.sum("rows").alias("rows"),
            F.min("l_orderkey_bucket").alias("bucket"),
        )
    )
    return per_key.agg(
        F.sum("rows").alias("rows"),
        F.count("*").alias("keys"),
        F.max("buckets").alias("most_buckets_per_key"),
        ((F.min("bucket") >= 0) & (F.max("bucket") < 10)).alias("in_range"),
        (F.count_distinct("bucket") == 10).alias("spread"),
    )


@query("part_hidden", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def part_hidden(spark, sf_dir):
    target = _written(
        spark, sf_dir, "orders", Transform("o_orderdate", "month"), Transform("o_orderstatus")
    )
    return read_table(spark, target).select("o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "prune_range",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-03-15' AND o_orderdate < TIMESTAMP '1997-06-02'""",
)
def prune_range(spark, sf_dir):
    month = Transform("o_orderdate", "month")
    target = _written(spark, sf_dir, "orders", month)
    pruned = prune_on(spark.table(target), "o_orderdate", "1997-03-15", "1997-06-02", [month])
    return pruned.select("o_orderkey", "o_orderdate")


@query("prune_bucket", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 77")
def prune_bucket(spark, sf_dir):
    bucket = Transform("l_orderkey", "bucket", 10)
    target = _written(spark, sf_dir, "lineitem", bucket)
    found = prune_equal(spark.table(target), "l_orderkey", 77, [bucket])
    return found.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "part_skewed",
    """SELECT count(*) AS total_rows, count(DISTINCT hot) AS partitions
       FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE l_returnflag END AS hot
             FROM lineitem)""",
)
def part_skewed(spark, sf_dir):
    hot = F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.col("l_returnflag"))
    df = table(spark, sf_dir, "lineitem").withColumn("hot", hot)
    target = f"{scratch_database(spark)}.lineitem"
    write_table(df, target, transforms=[Transform("hot")])
    return spark.table(target).agg(
        F.count("*").alias("total_rows"), F.count_distinct("hot").alias("partitions")
    )
