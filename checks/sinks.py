"""Writes: create, append, overwrite, align; loads, dry runs and their numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tableload.operators.layout import Transform
from tableload.operators.history import job_states
from tableload.plans.history import load_history
from tableload.plans.load import load_csv, plan_load
from tableload.session import scratch_database, scratch_path
from tableload.sinks.catalog import (
    create_table,
    ensure_database,
    resolve_table,
    table_properties,
    table_rows,
    table_storage,
)
from tableload.sinks.chunks import chunk_plan
from tableload.sinks.table import file_stats, write_table
from tableload.sources.csv import Dialect

from .registry import dealt, query, table, write_csv, write_lines

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _target(spark):
    return f"{scratch_database(spark)}.target"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("write_create", f"SELECT {_ORDERS} FROM orders")
def write_create(spark, sf_dir):
    target = _target(spark)
    write_table(_orders(spark, sf_dir), target)
    return spark.table(target)


@query(
    "write_append",
    f"""SELECT {_ORDERS} FROM orders
        UNION ALL SELECT {_ORDERS} FROM orders WHERE o_orderkey % 3 = 0""",
)
def write_append(spark, sf_dir):
    target, orders = _target(spark), _orders(spark, sf_dir)
    write_table(orders, target)
    write_table(orders.where("o_orderkey % 3 = 0"), target)
    return spark.table(target)


@query(
    "write_append_partitioned",
    f"""SELECT {_ORDERS} FROM orders UNION ALL SELECT {_ORDERS} FROM orders
        WHERE o_orderkey % 3 = 0""",
)
def write_append_partitioned(spark, sf_dir):
    target, orders = _target(spark), _orders(spark, sf_dir)
    write_table(orders, target, transforms=[Transform("o_orderdate", "year")])
    write_table(orders.where("o_orderkey % 3 = 0"), target)
    return spark.table(target).drop("o_orderdate_year")


@query(
    "write_align",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
       UNION ALL SELECT o_orderkey + 1000000, NULL, NULL, CAST(o_custkey AS DOUBLE) FROM orders""",
)
def write_align(spark, sf_dir):
    target = _target(spark)
    orders = _orders(spark, sf_dir).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    write_table(orders, target)
    later = orders.select(
        F.col("o_custkey").alias("O_TOTALPRICE"),
        (F.col("o_orderkey") + 1_000_000).alias("o_orderkey"),
    )
    write_table(later, target)
    return spark.table(target)


@query(
    "write_overwrite",
    """SELECT o_orderkey AS "key", o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0""",
)
def write_overwrite(spark, sf_dir):
    target, orders = _target(spark), _orders(spark, sf_dir)
    write_table(orders, target, transforms=[Transform("o_orderstatus")])
    later = orders.where("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")
    )
    write_table(later, target, mode="overwrite", transforms=[Transform("status")])
    return spark.table(target)


@query(
    "write_overwrite_keep_schema",
    """SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, o_totalprice,
              o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0""",
)
def write_overwrite_keep_schema(spark, sf_dir):
    target, orders = _target(spark), _orders(spark, sf_dir)
    write_table(orders, target, transforms=[Transform("o_orderdate", "month")])
    later = orders.where("o_orderkey % 2 = 0").drop("o_orderstatus")
    write_table(later, target, mode="overwrite", replace_schema=False)
    return spark.table(target).drop("o_orderdate_month")


@query(
    "write_overwrite_self",
    f"SELECT {_ORDERS} FROM orders WHERE o_orderstatus <> 'F'",
)
def write_overwrite_self(spark, sf_dir):
    target = _target(spark)
    write_table(_orders(spark, sf_dir), target)
    write_table(spark.table(target).where("o_orderstatus <> 'F'"), target, mode="overwrite")
    return spark.table(target)


_PART_BYTES = "8 + strlen(p_name) + strlen(p_brand) + strlen(p_type) + 4 + 8"


@query(
    "chunk_plan",
    f"""SELECT total_rows, total_bytes, rows_per_chunk,
               CAST(ceil(total_rows / rows_per_chunk) AS BIGINT) AS chunks
        FROM (SELECT total_rows, total_bytes, greatest(1, CAST(floor(
                20000 * total_rows / total_bytes) AS BIGINT)) AS rows_per_chunk
              FROM (SELECT count(*) AS total_rows,
                           CAST(sum({_PART_BYTES}) AS BIGINT) AS total_bytes FROM part))""",
)
def chunk_plan_query(spark, sf_dir):
    return chunk_plan(table(spark, sf_dir, "part"), max_bytes=20_000)


@query(
    "chunked_files",
    """SELECT count(*) AS total_rows, TRUE AS within_limit, TRUE AS enough_files FROM orders""",
)
def chunked_files(spark, sf_dir):
    target = _target(spark)
    write_table(_orders(spark, sf_dir), target, max_records_per_file=500)
    return file_stats(spark, target).select(
        "total_rows",
        (F.col("max_rows") <= 500).alias("within_limit"),
        (F.col("files") * 500 >= F.col("total_rows")).alias("enough_files"),
    )


@query(
    "load_csv",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders""",
)
def load_csv_query(spark, sf_dir):
    target = _target(spark)
    result = load_csv(
        spark,
        write_csv(_orders(spark, sf_dir), "orders"),
        target,
        exclude="o_orderpriority, missing",
        transforms=[Transform("o_orderdate", "year")],
    )
    if not result.success:
        raise RuntimeError(result.error)
    return spark.table(target).drop("o_orderdate_year")


@query(
    "load_csv_append",
    """SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, value FROM events
       UNION ALL SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR)
                        ELSE 'guest' END, value FROM events""",
)
def load_csv_append(spark, sf_dir):
    target = _target(spark)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    write_table(events.withColumn("user_id", F.col("user_id").cast("string")), target)
    guests = events.withColumn(
        "user_id",
        F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("guest"),
    )
    result = load_csv(spark, write_csv(guests, "events"), target)
    if not result.success:
        raise RuntimeError(result.error)
    return spark.table(target)


@query(
    "dry_run",
    """SELECT 'append' AS mode, count(*) AS total_rows, CAST(sum(8 + 8 + strlen(o_orderstatus) + 8
                + 8 + strlen(o_orderpriority)) AS BIGINT) AS total_bytes,
              CAST(0 AS INTEGER) AS columns_losing, count(*) / 5000 AS estimated_seconds,
              1 AS tables_created, 0 AS tables_modified FROM orders""",
)
def dry_run(spark, sf_dir):
    path = write_csv(_orders(spark, sf_dir), "orders")
    losing = F.size(F.map_concat("rejected", "required_nulls")).alias("columns_losing")
    return plan_load(spark, path, _target(spark)).select(
        "mode", "total_rows", "total_bytes", losing, "estimated_seconds", "tables_created",
        "tables_modified",
    )


@query(
    "dry_run_rejects",
    """SELECT count(*) AS total_rows, count(*) FILTER (event_id % 7 = 0) AS lost_value,
              count(*) FILTER (event_id % 7 = 0) AS missing_value, 1 AS columns_losing,
              CAST(ceil(count(*) / floor(100000 * count(*)
                / sum(8 + 8 + CASE WHEN event_id % 7 = 0 THEN 0 ELSE 8 END))) AS BIGINT) AS files
       FROM events""",
)
def dry_run_rejects(spark, sf_dir):
    report = plan_load(
        spark, _misfits(spark, sf_dir), _target(spark), schema=_REQUIRED_VALUE, file_bytes=100_000
    )
    return report.select(
        "total_rows",
        F.col("rejected")["value"].alias("lost_value"),
        F.col("required_nulls")["value"].alias("missing_value"),
        F.size("rejected").alias("columns_losing"),
        "files",
    )


_THREE = """[{"name": "event_id", "type": "Long"}, {"name": "user_id", "type": "Long"},
             {"name": "value", "type": "Double"}]"""
_REQUIRED_VALUE = _THREE.replace('"Double"', '"Double", "required": true')


def _misfits(spark, sf_dir):
    """Events as text in which every seventh value is no number."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    late = F.when(F.col("event_id") % 7 == 0, "late misfit").otherwise(
        F.col("value").cast("string")
    )
    return write_csv(events.withColumn("value", late), "events")


@query(
    "dry_run_overwrite",
    """SELECT 'overwrite' AS mode, TRUE AS rebuilds, count(*) AS total_rows, 0 AS tables_created,
              1 AS tables_modified FROM orders""",
)
def dry_run_overwrite(spark, sf_dir):
    target, orders = _target(spark), _orders(spark, sf_dir)
    write_table(orders.select("o_orderkey"), target)
    report = plan_load(spark, write_csv(orders, "orders"), target, mode="overwrite")
    return report.select(
        "mode",
        F.col("ddl").contains("`o_orderdate` TIMESTAMP_NTZ").alias("rebuilds"),
        "total_rows",
        "tables_created",
        "tables_modified",
    )


@query(
    "load_stats",
    """SELECT count(*) AS "rows", count(*) FILTER (event_id % 7 = 0) AS rejected_value,
              CAST(0 AS BIGINT) AS rejected_user_id FROM events""",
)
def load_stats(spark, sf_dir):
    result = load_csv(spark, _misfits(spark, sf_dir), _target(spark), schema=_THREE)
    if not result.success:
        raise RuntimeError(result.error)
    lost = [result.rejected.get(n, 0) for n in ("value", "user_id")]
    return spark.createDataFrame(
        [(result.rows_processed, *lost)],
        "rows bigint, rejected_value bigint, rejected_user_id bigint",
    )


@query(
    "load_rounded_decimals",
    """SELECT count(*) AS "rows", count(*) FILTER (length(rtrim(p_partkey::VARCHAR, '0')) > 2)
                AS rounded, count(*) FILTER (p_size = 0) AS whole FROM part""",
)
def load_rounded_decimals(spark, sf_dir):
    """Cells of a declared decimal with more than its ten places are counted."""
    number = F.concat("p_size", F.lit(".00000000"), "p_partkey").alias("size")
    path = write_csv(table(spark, sf_dir, "part").select("p_partkey", number), "part")
    schema = """[{"name": "p_partkey", "type": "Long"}, {"name": "size", "type": "Decimal"}]"""
    target = _target(spark)
    result = load_csv(spark, path, target, schema=schema)
    if not result.success or result.rejected:
        raise RuntimeError(result.error or str(result.rejected))
    return spark.table(target).agg(
        F.count("*").alias("rows"),
        F.lit(result.rounded.get("size", 0)).cast("bigint").alias("rounded"),
        F.count_if(F.col("size") == 0).alias("whole"),
    )


@query(
    "load_ragged",
    """SELECT count(*) AS "rows", count(*) FILTER (p_partkey % 5 = 3) AS filled_rows,
              count(*) FILTER (p_partkey % 5 IN (2, 3)) AS ragged FROM part""",
)
def load_ragged(spark, sf_dir):
    """Rows cut or filled on load are counted."""
    form = F.col("p_partkey") % 5
    full = F.concat_ws(",", "p_partkey", "p_brand", "p_size")
    line = F.when(form == 3, F.concat_ws(",", "p_partkey", "p_brand")).otherwise(full)
    line = F.when(form == 2, F.concat(full, F.lit(",surplus"))).otherwise(line)
    lines = table(spark, sf_dir, "part").select(line.alias("value"))
    target = _target(spark)
    schema = """[{"name": "col_0", "type": "Long"}, {"name": "col_1"},
                 {"name": "col_2", "type": "Long"}]"""
    result = load_csv(
        spark, write_lines(lines, "ragged"), target, dialect=Dialect(header=False), schema=schema
    )
    if not result.success:
        raise RuntimeError(result.error)
    return spark.table(target).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("col_2").isNull()).alias("filled_rows"),
        F.lit(result.ragged).cast("bigint").alias("ragged"),
    )


@query(
    "load_progress",
    """SELECT percent, "rows" FROM (VALUES (0), (100)) AS p(percent),
              (SELECT count(*) AS "rows" FROM orders)""",
)
def load_progress(spark, sf_dir):
    seen = []
    path = write_csv(_orders(spark, sf_dir), "orders")
    result = load_csv(spark, path, _target(spark), progress=seen.append)
    told = [(percent, result.rows_processed) for percent in seen]
    return spark.createDataFrame(told, "percent int, rows bigint")


@query(
    "load_progress_steps",
    """SELECT 0 AS first, 100 AS last, TRUE AS rising, count(*) AS "rows" FROM orders""",
)
def load_progress_steps(spark, sf_dir):
    seen = []
    path = write_csv(_orders(spark, sf_dir).repartition(8), "orders")
    result = load_csv(
        spark, path, _target(spark), transforms=[Transform("o_orderdate", "year")],
        progress=seen.append, progress_seconds=0.02,
    )
    rising = all(a < b for a, b in zip(seen, seen[1:]))
    told = [(seen[0], seen[-1], rising, result.rows_processed)]
    return spark.createDataFrame(told, "first int, last int, rising boolean, rows bigint")


@query(
    "load_history_record",
    """SELECT 'completed' AS status, 100 AS progress, 'append' AS mode,
              CAST(count(*) AS VARCHAR) AS rows_processed, TRUE AS has_size, count(*) AS measured,
              TRUE AS has_log FROM orders""",
)
def load_history_record(spark, sf_dir):
    database = scratch_database(spark)
    path = write_csv(_orders(spark, sf_dir), "orders")
    load_csv(spark, path, f"{database}.target", history_table=f"{database}.jobs")
    measured = F.get_json_object("performance_metrics", "$.total_rows").cast("bigint")
    return job_states(load_history(spark, f"{database}.jobs")).select(
        "status",
        "progress",
        "mode",
        "rows_processed",
        (F.col("file_size").cast("bigint") > 0).alias("has_size"),
        measured.alias("measured"),
        F.col("stdout").contains("wrote").alias("has_log"),
    )


@query(
    "create_in_place",
    """SELECT o_orderkey, o_orderstatus, 'sales' AS team, TRUE AS placed FROM orders""",
)
def create_in_place(spark, sf_dir):
    """A database and a table made with a folder and properties of their own."""
    place = scratch_path(spark, "made")
    database = f"made_{uuid.uuid4().hex}"
    for _ in range(2):
        ensure_database(spark, database, f"{place}/db")
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    name = f"{database}.orders"
    create_table(
        spark, name, orders.schema, properties={"team": "sales"}, location=f"{place}/orders"
    )
    write_table(orders, name)
    _, folder = table_storage(spark, name)
    return spark.table(name).withColumns(
        {
            "team": F.lit(table_properties(spark, name)["team"]),
            "placed": F.lit(folder.endswith("/orders") and "made" in folder),
        }
    )


@query(
    "load_result",
    """SELECT TRUE AS success, count(*) AS rows_processed,
              count(*) FILTER (event_id % 7 = 0) AS rejected FROM events""",
)
def load_result(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    late = F.when(F.col("event_id") % 7 == 0, "late misfit").otherwise(
        F.col("value").cast("string")
    )
    result = load_csv(
        spark,
        write_csv(events.withColumn("value", late), "events"),
        _target(spark),
        schema='[{"name": "event_id", "type": "Long"}, {"name": "value", "type": "Double"}]',
    )
    return spark.createDataFrame(
        [(result.success, result.rows_processed, result.rejected.get("value", 0))],
        "success boolean, rows_processed bigint, rejected bigint",
    )


@query(
    "catalog_columns",
    """SELECT CAST(row_number() OVER () AS INTEGER) AS field_id, column_name AS name,
              CASE column_type WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'DOUBLE' THEN 'double'
                   WHEN 'VARCHAR' THEN 'string' ELSE 'long' END AS type
       FROM (DESCRIBE lineitem)""",
)
def catalog_columns(spark, sf_dir):
    target = _target(spark)
    result = load_csv(spark, write_csv(table(spark, sf_dir, "lineitem"), "lineitem"), target)
    if not result.success:
        raise RuntimeError(result.error)
    return table_rows(spark, resolve_table(spark, target)).select("field_id", "name", "type")


@query(
    "write_overwrite_large",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
       WHERE l_linenumber <> 4""",
)
def write_overwrite_large(spark, sf_dir):
    target = _target(spark)
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    write_table(lineitem, target)
    later = dealt(lineitem.where("l_linenumber <> 4"))
    result = load_csv(spark, write_csv(later, "lineitem"), target, mode="overwrite")
    if not result.success:
        raise RuntimeError(result.error)
    return spark.table(target).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query(
    "dry_run_ddl",
    """SELECT '(' || string_agg('`' || column_name || '` ' || CASE column_type
                WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' WHEN 'DOUBLE' THEN 'DOUBLE'
                WHEN 'VARCHAR' THEN 'STRING' ELSE 'BIGINT' END, ', ')
              || ', `l_shipdate_month` STRING) USING parquet' AS ddl,
              (SELECT count(*) FROM lineitem) AS total_rows
       FROM (DESCRIBE lineitem)""",
)
def dry_run_ddl(spark, sf_dir):
    path = write_csv(table(spark, sf_dir, "lineitem"), "lineitem")
    plan = plan_load(spark, path, _target(spark), transforms=[Transform("l_shipdate", "month")])
    return plan.select(F.regexp_extract("ddl", r"(\(.*)", 1).alias("ddl"), "total_rows")


@query(
    "load_split_quotes",
    """SELECT doc_id, length("text") AS chars,
              length("text") - length(replace("text", chr(10), '')) AS newlines,
              0 AS ragged, TRUE AS planned FROM documents""",
)
def load_split_quotes(spark, sf_dir):
    """Quoted cells with newlines load as one row each, and the dry run says so."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path, target = write_csv(dealt(docs), "documents"), _target(spark)
    plan = load_csv(spark, path, target, dry_run=True)
    result = load_csv(spark, path, target)
    if not result.success:
        raise RuntimeError(result.error)
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return spark.table(target).select(
        "doc_id",
        F.length("text").cast("bigint").alias("chars"),
        newlines.cast("bigint").alias("newlines"),
        F.lit(result.ragged).alias("ragged"),
        F.lit((plan.rows_processed, plan.ragged) == (result.rows_processed, 0)).alias("planned"),
    )


@query(
    "dry_run_ragged",
    """SELECT count(*) AS total_rows, count(*) FILTER (p_partkey % 5 IN (2, 3)) AS ragged,
              1 AS columns_losing FROM part""",
)
def dry_run_ragged(spark, sf_dir):
    """Rows that a load would cut or fill are counted before it, around a cell with a newline."""
    form = F.col("p_partkey") % 5
    full = F.concat_ws(",", "p_partkey", F.concat(F.lit('"a\n'), "p_brand", F.lit('"')), "p_type")
    line = F.when(form == 3, F.concat_ws(",", "p_partkey", "p_brand")).otherwise(full)
    line = F.when(form == 2, F.concat(full, F.lit(",surplus"))).otherwise(line)
    lines = write_lines(table(spark, sf_dir, "part").select(line.alias("value")), "ragged")
    schema = """[{"name": "col_0", "type": "Long"}, {"name": "col_1"},
                 {"name": "col_2", "type": "Long"}]"""
    report = plan_load(
        spark, lines, _target(spark), dialect=Dialect(header=False), schema=schema
    )
    losing = F.size("rejected").alias("columns_losing")
    return report.select("total_rows", F.col("ragged").cast("bigint").alias("ragged"), losing)


@query(
    "write_overwrite_in_place",
    """SELECT o_custkey, o_orderkey, 'kept' AS comment, 'EXTERNAL' AS kind FROM orders
       WHERE o_orderkey % 2 = 0""",
)
def write_overwrite_in_place(spark, sf_dir):
    """An overwrite of a table in a folder of its own choice, read from the folder itself."""
    orders, target = _orders(spark, sf_dir), _target(spark)
    folder = scratch_path(spark, "mine")
    spark.sql(
        f"CREATE TABLE {target} (o_orderkey BIGINT COMMENT 'kept', o_custkey BIGINT) "
        f"USING parquet LOCATION '{folder}'"
    )
    write_table(orders.select("o_orderkey", "o_custkey"), target)
    even = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey")
    write_table(even, target, mode="overwrite", replace_schema=False)
    comment = spark.table(target).schema["o_orderkey"].metadata["comment"]
    kind = spark.sql(f"DESCRIBE TABLE EXTENDED {target}").where("col_name = 'Type'").head()[1]
    return spark.read.parquet(folder).select(
        "o_orderkey", "o_custkey", F.lit(comment).alias("comment"), F.lit(kind).alias("kind")
    )
