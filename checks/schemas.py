"""Schemas: declared, edited, inferred, checked and compared."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from tableload.functions.samples import random_sample
from tableload.operators.compat import compare_schemas, schema_verdict
from tableload.operators.schema import (
    apply_schema,
    column_kinds,
    declared_schema,
    edit_schema,
    infer_schema,
    inferred_columns,
    required_violations,
    sample_values,
    schema_of,
    schema_problems,
    schema_rows,
    text_columns,
    type_distribution,
)
from tableload.sources.csv import clear_null_tokens, read_text

from .registry import FLAT_TABLES, query, table, write_csv


@query(
    "declared_schema",
    """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name,
              CAST(c_nationkey AS VARCHAR) AS c_nationkey,
              CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(NULL AS DATE) AS joined
       FROM customer""",
)
def declared_schema_query(spark, sf_dir):
    text = read_text(spark, write_csv(table(spark, sf_dir, "customer"), "customer"))
    declaration = json.dumps(
        [
            {"id": 1, "name": "c_custkey", "type": "Double", "required": True},
            {"id": 2, "name": "c_name", "type": "String"},
            {"id": 3, "name": "c_nationkey", "type": "Unheard"},
            {"id": 4, "name": "c_acctbal", "type": "Decimal"},
            {"id": 5, "name": "joined", "type": "Date"},
        ]
    )
    typed = apply_schema(text, declared_schema(declaration), enforce_required=True)
    return typed.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query(
    "edited_schema",
    """SELECT event_id, CAST(ts AS DATE) AS happened, CAST(user_id AS VARCHAR) AS "user",
              CAST(value AS DOUBLE) AS amount FROM events""",
)
def edited_schema(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.to_date("ts"))
    text = read_text(spark, write_csv(events, "events"))
    schema = edit_schema(
        infer_schema(text),
        rename={"ts": "happened", "user_id": "user", "value": "amount"},
        retype={"user_id": "string", "value": "decimal(38,18)"},
        require={"event_id": True},
        remove=["props", "event_type"],
    )
    typed = apply_schema(text, schema, enforce_required=True)
    return typed.withColumn("amount", F.col("amount").cast("double"))


@query(
    "required_violations",
    """SELECT 'user_id' AS name, count(*) FILTER (event_id % 10 = 0) AS violations FROM events
       UNION ALL SELECT 'value', count(*) FILTER (event_id % 4 = 1) FROM events
       UNION ALL SELECT 'event_id', 0 FROM events WHERE event_id = 0""",
)
def required_violations_query(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 10 == 0, "N/A")
        .otherwise(F.col("user_id").cast("string"))
        .alias("user_id"),
        F.when(F.col("event_id") % 4 == 1, "n.a.")
        .otherwise(F.col("value").cast("string"))
        .alias("value"),
    )
    schema = declared_schema(
        [
            {"name": "event_id", "type": "Long", "required": True},
            {"name": "user_id", "type": "Long", "required": True},
            {"name": "value", "type": "Double", "required": True},
        ]
    )
    return required_violations(apply_schema(clear_null_tokens(df), schema), schema)


def _inferred_sql(name: str, columns) -> str:
    """The type grammar as an aggregate per column."""
    parts = []
    for i, col in enumerate(columns, 1):
        cell = f'CAST("{col}" AS VARCHAR)'
        parts.append(
            f"""SELECT '{name}' AS table_name, {i} AS field_id, '{col}' AS name,
              CASE WHEN count(t) = 0 THEN 'string'
                   WHEN bool_and(regexp_matches(t, '^(?i:true|false)$')) THEN 'boolean'
                   WHEN bool_and(regexp_matches(t, '^[+-]?[0-9]{{1,19}}$')
                                 AND TRY_CAST(t AS BIGINT) IS NOT NULL) THEN 'long'
                   WHEN bool_and(regexp_matches(t,
                      '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) THEN 'double'
                   WHEN bool_and(regexp_matches(t, '^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}$')
                                 AND TRY_CAST(replace(t, '/', '-') AS DATE) IS NOT NULL)
                        THEN 'date'
                   WHEN bool_and(regexp_matches(t,
                      '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\\.[0-9]{{1,9}})?)?)?$')
                                 AND TRY_CAST(t AS TIMESTAMP) IS NOT NULL) THEN 'timestamp'
                   ELSE 'string' END AS type
            FROM (SELECT {cell} AS t FROM {name}
                  WHERE {cell} NOT IN ('', 'NULL', 'null', 'NA', 'N/A', 'na', 'n/a', 'None',
                                       'none'))"""
        )
    return " UNION ALL ".join(parts)


def _inferred(spark, sf_dir, name):
    df = table(spark, sf_dir, name).select(*FLAT_TABLES[name])
    return inferred_columns(clear_null_tokens(text_columns(df))).withColumn(
        "table_name", F.lit(name)
    )


_SQL_NAMES = """CASE type WHEN 'boolean' THEN 'BOOLEAN' WHEN 'long' THEN 'BIGINT'
    WHEN 'double' THEN 'DOUBLE' WHEN 'date' THEN 'DATE' WHEN 'timestamp' THEN 'TIMESTAMP(3)'
    ELSE 'VARCHAR' END"""


@query(
    "infer_schema",
    f"""SELECT field_id, name, type, {_SQL_NAMES} AS sql_type, FALSE AS required
        FROM ({_inferred_sql("orders", FLAT_TABLES["orders"])})""",
)
def infer_schema_query(spark, sf_dir):
    text = read_text(spark, write_csv(table(spark, sf_dir, "orders"), "orders"))
    return inferred_columns(text)


@query(
    "infer_schema_random_sample",
    f"""SELECT field_id, name, type, {_SQL_NAMES} AS sql_type, FALSE AS required
        FROM ({_inferred_sql("lineitem", FLAT_TABLES["lineitem"])})""",
)
def infer_schema_random_sample(spark, sf_dir):
    text = read_text(spark, write_csv(table(spark, sf_dir, "lineitem"), "lineitem"))
    return schema_rows(spark, infer_schema(random_sample(text, 1000)))


_ALL_SQL = " UNION ALL ".join(_inferred_sql(t, cols) for t, cols in FLAT_TABLES.items())


def _all_inferred(spark, sf_dir):
    return reduce(
        lambda a, b: a.unionByName(b), [_inferred(spark, sf_dir, t) for t in FLAT_TABLES]
    )


@query("infer_schema_all", f"SELECT table_name, field_id, name, type FROM ({_ALL_SQL})")
def infer_schema_all(spark, sf_dir):
    return _all_inferred(spark, sf_dir).select("table_name", "field_id", "name", "type")


@query(
    "infer_mixed_kinds",
    """SELECT 1 AS field_id, 'a' AS name, 'double' AS type, count(*) AS filled,
              CAST(0 AS BIGINT) AS nulls FROM orders
       UNION ALL SELECT 2, 'b', 'timestamp', count(*), 0 FROM orders
       UNION ALL SELECT 3, 'c', 'boolean', count(*) FILTER (o_orderkey % 3 <> 2),
                        count(*) FILTER (o_orderkey % 3 = 2) FROM orders
       UNION ALL SELECT 4, 'd', 'string', count(*), 0 FROM orders
       UNION ALL SELECT 5, 'e', 'string', 0, count(*) FROM orders
       UNION ALL SELECT 6, 'f', 'date', count(*), 0 FROM orders""",
)
def infer_mixed_kinds(spark, sf_dir):
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date").cast("string")
    df = table(spark, sf_dir, "orders").select(
        F.when(key % 2 == 0, key.cast("string")).otherwise(F.col("o_totalprice").cast("string")).alias("a"),
        F.when(key % 2 == 0, day).otherwise(F.concat(day, F.lit("T10:30"))).alias("b"),
        F.get(F.array(F.lit("TRUE"), F.lit("false"), F.lit("NA")), (key % 3).cast("int")).alias(
            "c"
        ),
        F.when(key % 100 == 0, day).otherwise(key.cast("string")).alias("d"),
        F.lit("none").alias("e"),
        F.when(key % 2 == 0, day).otherwise(F.translate(day, "-", "/")).alias("f"),
    )
    cells = clear_null_tokens(df)
    kinds = column_kinds(cells).select("field_id", "filled", "nulls")
    return inferred_columns(cells).join(kinds, "field_id").select(
        "field_id", "name", "type", "filled", "nulls"
    )


@query(
    "type_distribution",
    f'SELECT type, count(*) AS "columns" FROM ({_ALL_SQL}) GROUP BY type',
)
def type_distribution_query(spark, sf_dir):
    return type_distribution(_all_inferred(spark, sf_dir))


@query(
    "schema_checks",
    f"""SELECT count(*) AS "columns", count(*) - count(DISTINCT name) AS repeated_names,
               count(*) - count(DISTINCT field_id) AS repeated_ids, FALSE AS "valid"
        FROM ({_ALL_SQL})""",
)
def schema_checks(spark, sf_dir):
    return schema_problems(_all_inferred(spark, sf_dir))


@query(
    "schema_checks_valid",
    f"""SELECT count(*) AS "columns", CAST(0 AS BIGINT) AS repeated_names,
               CAST(0 AS BIGINT) AS repeated_ids, TRUE AS "valid"
        FROM ({_inferred_sql("lineitem", FLAT_TABLES["lineitem"])})""",
)
def schema_checks_valid(spark, sf_dir):
    return schema_problems(_inferred(spark, sf_dir, "lineitem"))


@query(
    "sample_values",
    """SELECT name, position, value FROM (
         SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS position,
                CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
                o_orderstatus, o_orderpriority,
                CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate
         FROM orders ORDER BY orders.o_orderkey LIMIT 3)
       UNPIVOT (value FOR name IN (o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
                                   o_orderdate))""",
)
def sample_values_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.to_date("o_orderdate").alias("o_orderdate"),
    )
    return sample_values(orders, "o_orderkey")


@query(
    "nested_as_text",
    """SELECT vec_id, len(embedding) AS n, label,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
       FROM embeddings""",
)
def nested_as_text(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    assert [f.dataType.simpleString() for f in schema_of(df)] == ["bigint", "string", "int"]
    path = write_csv(df, "vectors")
    text = read_text(spark, path)
    typed = apply_schema(text, schema_of(df))
    numbers = F.from_json("embedding", "array<float>")
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return typed.select(
        "vec_id", F.size(numbers).cast("bigint").alias("n"), "label", F.round(total, 4).alias("total")
    )


@query(
    "type_mapping",
    """SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS tiny, CAST(l_linenumber AS INTEGER) AS small,
              CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
              base64(encode(l_returnflag)) AS raw,
              '{"a":' || l_linenumber || ',"b":"' || l_linestatus || '"}' AS pair,
              l_quantity > 25 AS big, CAST(l_shipdate AS DATE) AS shipped FROM lineitem""",
)
def type_mapping(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("tinyint").alias("tiny"),
        F.col("l_linenumber").cast("smallint").alias("small"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_returnflag").cast("binary").alias("raw"),
        F.struct(F.col("l_linenumber").alias("a"), F.col("l_linestatus").alias("b")).alias("pair"),
        (F.col("l_quantity") > 25).alias("big"),
        F.to_date("l_shipdate").alias("shipped"),
    )
    typed = apply_schema(read_text(spark, write_csv(df, "types")), schema_of(df))
    return typed.withColumn("price", F.col("price").cast("double"))


_EXISTING = {
    "O_ORDERKEY": "double",
    "o_custkey": "int",
    "o_orderstatus": "string",
    "o_totalprice": "string",
    "o_orderdate": "date",
    "extra": "string",
}


def _compared(spark, sf_dir, existing):
    orders = table(spark, sf_dir, "orders")
    old = orders.select(
        [
            (F.col(n) if n.lower() in orders.columns else F.lit(None)).try_cast(t).alias(n)
            for n, t in existing.items()
        ]
    )
    return compare_schemas(
        schema_rows(spark, schema_of(old)), _inferred(spark, sf_dir, "orders")
    )


@query(
    "schema_compat",
    f"""SELECT i.field_id, i.name, {_SQL_NAMES} AS inferred_type, e.t AS existing_type,
               e.t IS NOT NULL AS matched, e.ok AS compatible
        FROM ({_inferred_sql("orders", FLAT_TABLES["orders"])}) i
        LEFT JOIN (VALUES ('o_orderkey', 'DOUBLE', FALSE), ('o_custkey', 'INTEGER', TRUE),
                          ('o_orderstatus', 'VARCHAR', TRUE), ('o_totalprice', 'VARCHAR', TRUE),
                          ('o_orderdate', 'DATE', TRUE)) e(name, t, ok) ON e.name = i.name""",
)
def schema_compat(spark, sf_dir):
    return _compared(spark, sf_dir, _EXISTING)


@query(
    "schema_verdict",
    f"""SELECT count(*) AS "columns", CAST(5 AS BIGINT) AS matched, CAST(1 AS BIGINT) AS mismatched,
               TRUE AS compatible FROM ({_inferred_sql("orders", FLAT_TABLES["orders"])})""",
)
def schema_verdict_query(spark, sf_dir):
    return schema_verdict(_compared(spark, sf_dir, _EXISTING))


@query(
    "schema_verdict_refused",
    f"""SELECT count(*) AS "columns", CAST(4 AS BIGINT) AS matched, CAST(1 AS BIGINT) AS mismatched,
               FALSE AS compatible FROM ({_inferred_sql("orders", FLAT_TABLES["orders"])})""",
)
def schema_verdict_refused(spark, sf_dir):
    fewer = {k: v for k, v in _EXISTING.items() if k != "o_custkey"}
    return schema_verdict(_compared(spark, sf_dir, fewer))
