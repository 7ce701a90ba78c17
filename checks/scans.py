"""Scans: dialects, null tokens, ragged rows, coercion, samples and structure."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableload.functions.names import clean_name_col
from tableload.functions.samples import head_sample, random_sample
from tableload.operators.columns import clean_columns, select_columns
from tableload.operators.schema import (
    apply_schema,
    declared_schema,
    infer_schema,
    typed_columns,
)
from tableload.sources.csv import INPUT_GLOB, Dialect, read_text
from tableload.sources.structure import field_counts, lines, structure_report

from .registry import query, table, write_csv, write_lines


def _loaded(spark, path, dialect=Dialect(), **options):
    text = read_text(spark, path, dialect, **options)
    return apply_schema(text, infer_schema(text))


@query(
    "csv_scan_header",
    "SELECT event_id, ts, user_id, event_type, value, props FROM events",
)
def csv_scan_header(spark, sf_dir):
    return _loaded(spark, write_csv(table(spark, sf_dir, "events"), "events"))


@query(
    "csv_scan_dialect",
    """SELECT s_suppkey, s_name || '; ''' || s_nationkey || '''' AS s_name,
              CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier""",
)
def csv_scan_dialect(spark, sf_dir):
    dialect = Dialect(sep=";", quote="'")
    named = F.concat("s_name", F.lit("; '"), "s_nationkey", F.lit("'"))
    df = table(spark, sf_dir, "supplier").withColumn("s_name", named)
    return _loaded(spark, write_csv(df, "supplier", dialect), dialect)


@query(
    "csv_scan_no_header",
    """SELECT c_custkey AS col_0, c_name AS col_1, CAST(c_nationkey AS BIGINT) AS col_2,
              c_acctbal AS col_3, c_mktsegment AS col_4 FROM customer""",
)
def csv_scan_no_header(spark, sf_dir):
    dialect = Dialect(header=False)
    return _loaded(
        spark, write_csv(table(spark, sf_dir, "customer"), "customer", dialect), dialect
    )


@query(
    "csv_scan_multiline",
    'SELECT doc_id, "text", lang, source, n_chars FROM documents',
)
def csv_scan_multiline(spark, sf_dir):
    path = write_csv(table(spark, sf_dir, "documents"), "documents")
    return _loaded(spark, path, Dialect(multiline=True))


@query(
    "csv_scan_long_cells",
    "SELECT page_id, url, html FROM pages",
)
def csv_scan_long_cells(spark, sf_dir):
    path = write_csv(table(spark, sf_dir, "pages"), "pages")
    return _loaded(spark, path, Dialect(multiline=True))


_CELLS = (
    "", "NULL", "null", "NA", "N/A", "na", "n/a", "None", "none",
    "Null", "NONE", "Na", "n/A", " NA", "0",
)


@query(
    "null_tokens",
    """SELECT o_orderkey, CASE CAST(o_orderkey % 15 AS INTEGER)
                WHEN 9 THEN 'Null' WHEN 10 THEN 'NONE' WHEN 11 THEN 'Na'
                WHEN 12 THEN 'n/A' WHEN 13 THEN ' NA' WHEN 14 THEN '0' END AS status
       FROM orders""",
)
def null_tokens(spark, sf_dir):
    cells = F.array(*[F.lit(c) for c in _CELLS])
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.get(cells, (F.col("o_orderkey") % 15).cast("int")).alias("status")
    )
    schema = declared_schema(
        [{"name": "o_orderkey", "type": "Long"}, {"name": "status", "type": "String"}]
    )
    return apply_schema(read_text(spark, write_csv(df, "tokens")), schema)


@query(
    "ragged_rows",
    """SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE p_size END AS p_size,
              p_partkey % 5 IN (1, 2) AS ragged FROM part""",
)
def ragged_rows(spark, sf_dir):
    short = F.concat_ws(",", "p_partkey", "p_brand")
    full = F.concat_ws(",", "p_partkey", "p_brand", "p_size")
    line = (
        F.when(F.col("p_partkey") % 5 == 1, short)
        .when(F.col("p_partkey") % 5 == 2, F.concat(full, F.lit(",surplus,more")))
        .otherwise(full)
    )
    path = write_lines(table(spark, sf_dir, "part").select(line.alias("value")), "ragged")
    names = ["p_partkey", "p_brand", "p_size"]
    text = read_text(spark, path, Dialect(header=False), names=names, ragged_flag="ragged")
    schema = T.StructType.fromDDL("p_partkey bigint, p_brand string, p_size int")
    return text.select(*typed_columns(text, schema), "ragged")


@query(
    "coerce_bad_cells",
    """SELECT event_id, CASE WHEN event_id % 7 IN (0, 3, 5) THEN NULL ELSE value END AS value
       FROM events""",
)
def coerce_bad_cells(spark, sf_dir):
    left = F.col("event_id") % 7
    cell = (
        F.when(left == 0, F.lit("oops"))
        .when(left == 3, F.lit("1d"))
        .when(left == 5, F.concat("value", F.lit(" ")))
        .otherwise(F.col("value").cast("string"))
    )
    df = table(spark, sf_dir, "events").select("event_id", cell.alias("value"))
    schema = declared_schema(
        [{"name": "event_id", "type": "Long"}, {"name": "value", "type": "Double"}]
    )
    return apply_schema(read_text(spark, write_csv(df, "bad")), schema)


@query(
    "parse_dates",
    """SELECT l_orderkey, l_linenumber,
              CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL
                   WHEN 2 THEN l_shipdate + INTERVAL 1 HOUR
                   WHEN 3 THEN l_shipdate + INTERVAL 90 MINUTE
                   ELSE l_shipdate END AS shipped,
              CASE WHEN l_linenumber % 7 IN (4, 5) THEN CAST(l_shipdate AS DATE) END AS ship_day
       FROM lineitem""",
)
def parse_dates(spark, sf_dir):
    day = F.col("l_shipdate").cast("date").cast("string")
    form = F.col("l_linenumber") % 7
    cell = (
        F.when(form == 0, F.lit("2024-13-02"))
        .when(form == 1, F.concat(day, F.lit("T10:00+02:00")))
        .when(form == 2, F.concat(day, F.lit("T01:00")))
        .when(form == 3, F.concat(day, F.lit(" 01:30:00.000")))
        .when(form == 4, F.translate(day, "-", "/"))
        .when(form == 5, day)
        .otherwise(F.col("l_shipdate").cast("string"))
    )
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", cell.alias("shipped"), cell.alias("ship_day")
    )
    schema = declared_schema(
        [
            {"name": "l_orderkey", "type": "Long"},
            {"name": "l_linenumber", "type": "Integer"},
            {"name": "shipped", "type": "Timestamp"},
            {"name": "ship_day", "type": "Date"},
        ]
    )
    return apply_schema(read_text(spark, write_csv(df, "dates")), schema)


@query(
    "infer_long_integers",
    """SELECT o_orderkey, o_orderkey || '00000000000000000001' AS long_id,
              '12345678901234567' || (o_custkey % 900 + 100) AS mixed FROM orders""",
)
def infer_long_integers(spark, sf_dir):
    """Whole numbers past bigint keep every digit."""
    key = F.col("o_orderkey")
    mixed = F.concat(F.lit("12345678901234567"), F.col("o_custkey") % 900 + 100)
    longer = F.concat(key, F.lit("00000000000000000001"))
    df = table(spark, sf_dir, "orders").select(key, longer.alias("long_id"), mixed.alias("mixed"))
    return _loaded(spark, write_csv(df, "long"))


@query("row_count", 'SELECT count(*) AS "rows" FROM documents')
def row_count(spark, sf_dir):
    path = write_csv(table(spark, sf_dir, "documents"), "documents")
    text = read_text(spark, path, Dialect(multiline=True))
    return text.agg(F.count("*").alias("rows"))


@query(
    "head_sample",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000",
)
def head_sample_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return head_sample(orders, 1000, order_by="o_orderkey")


@query("random_sample", "SELECT TRUE AS size_close, 0 AS repeated_rows, 0 AS foreign_rows")
def random_sample_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    total = orders.count()
    wanted = total // 5
    sample = random_sample(orders, wanted, total=total)
    known = orders.withColumn("known", F.lit(True))
    return sample.join(known, ["o_orderkey", "o_custkey"], "left").agg(
        (F.abs(F.count("*") - wanted) < 0.1 * wanted).alias("size_close"),
        (F.count("*") - F.count_distinct("o_orderkey")).cast("int").alias("repeated_rows"),
        F.count_if(F.col("known").isNull()).cast("int").alias("foreign_rows"),
    )


def _part_lines(spark, sf_dir):
    line = F.concat_ws(",", "p_partkey", "p_name", "p_brand", "p_size")
    odd = F.col("p_partkey") % 7 == 3
    return table(spark, sf_dir, "part").select(
        F.when(odd, F.concat(line, F.lit(",extra")))
        .when(F.col("p_partkey") % 11 == 5, F.lit(""))
        .otherwise(line)
        .alias("value")
    )


@query(
    "field_count_histogram",
    """SELECT CASE WHEN p_partkey % 7 = 3 THEN 5 ELSE 4 END AS fields, count(*) AS "lines"
       FROM part WHERE p_partkey % 7 = 3 OR p_partkey % 11 <> 5 GROUP BY 1""",
)
def field_count_histogram(spark, sf_dir):
    return field_counts(lines(spark, write_lines(_part_lines(spark, sf_dir), "lines")))


@query(
    "structure_check",
    """SELECT FALSE AS "empty", count(*) AS "lines",
              count(*) FILTER (p_partkey % 7 <> 3 AND p_partkey % 11 = 5) AS blank_lines,
              FALSE AS blank_first_line, TRUE AS separator_in_first_line, 4 AS first_fields,
              4 AS usual_fields, CAST(2 AS BIGINT) AS distinct_counts,
              count(*) FILTER (p_partkey % 7 = 3) AS odd_lines, FALSE AS multiline_hint,
              TRUE AS "valid" FROM part""",
)
def structure_check(spark, sf_dir):
    return structure_report(spark, write_lines(_part_lines(spark, sf_dir), "lines"))


@query(
    "structure_multiline_hint",
    """SELECT count(*) AS "lines",
              bool_or((len(line) - len(replace(line, '"', ''))) % 2 = 1) AS multiline_hint
       FROM (SELECT unnest(string_split(
                 CASE WHEN contains("text", chr(10)) THEN '"' || "text" || '"' ELSE "text" END,
                 chr(10))) AS line
             FROM (SELECT replace("text", '"', '') AS "text" FROM documents))""",
)
def structure_multiline_hint(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit('"'))
    cell = F.when(text.contains("\n"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    path = write_lines(table(spark, sf_dir, "documents").select(cell.alias("value")), "prose")
    return structure_report(spark, path).select("lines", "multiline_hint")


@query("input_filter", "SELECT o_orderkey, o_orderstatus FROM orders")
def input_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    even = F.col("o_orderkey") % 2 == 0
    paths = [
        write_csv(orders.where(even), "orders"),
        write_csv(orders.where(~even), "orders", extension="TXT"),
        write_csv(orders, "decoy", extension="log"),
    ]
    text = read_text(spark, paths, path_glob=INPUT_GLOB)
    return apply_schema(text, infer_schema(text))


_CUSTOMER = "customer"


@query("include_columns", "SELECT c_custkey, c_name FROM customer")
def include_columns(spark, sf_dir):
    return select_columns(table(spark, sf_dir, _CUSTOMER), include="c_name, c_custkey, missing")


@query("exclude_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def exclude_columns(spark, sf_dir):
    return select_columns(
        table(spark, sf_dir, _CUSTOMER), exclude=["c_acctbal", "c_nationkey", "missing"]
    )


@query("include_over_exclude", "SELECT c_custkey, c_name FROM customer")
def include_over_exclude(spark, sf_dir):
    return select_columns(
        table(spark, sf_dir, _CUSTOMER), include="c_custkey,c_name", exclude="c_name"
    )


@query(
    "empty_selection",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def empty_selection(spark, sf_dir):
    return select_columns(table(spark, sf_dir, _CUSTOMER), include=["missing"])


_PREFIXES = ("", "1 ", "(x) ", "Größe-", "_", "  ")


@query(
    "clean_names",
    r"""WITH raw AS (
          SELECT p_partkey, CASE WHEN p_partkey % 9 < 6
                   THEN ['', '1 ', '(x) ', 'Größe-', '_', '  '][p_partkey % 9 + 1] || p_name
                   ELSE ['select', '', 'Order'][p_partkey % 9 - 5] END AS raw_name FROM part),
        safe AS (
          SELECT *, regexp_replace(regexp_replace(raw_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'),
                                   '[^\p{L}\p{N}_]', '_', 'g') AS s FROM raw)
        SELECT p_partkey, raw_name,
               CASE WHEN raw_name = '' THEN 'unnamed_column'
                    WHEN NOT regexp_matches(s, '^[\p{L}_]') OR lower(s) IN ('table', 'column',
                         'select', 'where', 'from', 'order', 'group', 'by') THEN 'col_' || s
                    ELSE s END AS cleaned
        FROM safe""",
)
def clean_names(spark, sf_dir):
    form = (F.col("p_partkey") % 9).cast("int")
    prefixes = F.array(*[F.lit(p) for p in _PREFIXES])
    whole = F.array(F.lit("select"), F.lit(""), F.lit("Order"))
    raw = F.when(form < 6, F.concat(F.get(prefixes, form), "p_name")).otherwise(
        F.get(whole, form - 6)
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", raw.alias("raw_name"), clean_name_col(raw).alias("cleaned")
    )


@query(
    "clean_columns",
    'SELECT c_custkey AS col_1_key, c_name AS "col_select", c_acctbal AS balance____ FROM customer',
)
def clean_columns_query(spark, sf_dir):
    df = table(spark, sf_dir, _CUSTOMER).select("c_custkey", "c_name", "c_acctbal")
    text = read_text(spark, write_csv(df.toDF("1-key", "select", "balance ($)"), "names"))
    return apply_schema(clean_columns(text), infer_schema(clean_columns(text)))


@query(
    "csv_scan_quoted_newlines",
    'SELECT doc_id, "text", lang, source, n_chars FROM documents',
)
def csv_scan_quoted_newlines(spark, sf_dir):
    """Texts with newlines in quoted cells, put together from lines."""
    return _loaded(spark, write_csv(table(spark, sf_dir, "documents"), "documents"), Dialect())
