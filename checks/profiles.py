"""Column profiles and partition advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tableload.operators.advise import advise, present, recommendation_rows
from tableload.operators.layout import Transform
from tableload.operators.profile import profile_approx
from tableload.operators.profile import profile_exact as profile
from tableload.operators.schema import apply_schema, infer_schema
from tableload.session import scratch_database
from tableload.sinks.table import write_table
from tableload.sources.csv import read_text

from .registry import FLAT_TABLES, query, table, write_csv

_DATE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}-\d{2}-\d{4}|\d{2}/\d{2}/\d{4}"
_DATE_LIKE = f"^({_DATE})$"


def _profile_sql(source: str, columns: dict[str, str], labels: dict[str, str] | None = None) -> str:
    """Profile rows, one aggregate per column."""
    parts = []
    for i, (col, kind) in enumerate(columns.items(), 1):
        label = (labels or {}).get(col, kind)
        like = f"regexp_matches(v, '{_DATE_LIKE}')" if kind == "string" else "FALSE"
        parts.append(
            f"""SELECT {i} AS field_id, '{col}' AS "column", '{label}' AS type, '{kind}' AS kind,
              count(*) AS unique_values, CAST(sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END)
                AS BIGINT) AS total_values,
              CAST(sum(CASE WHEN v IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_count,
              max(n) AS top_rows, coalesce(bool_or({like}) AND
                sum(n) FILTER ({like}) >= 0.9 * sum(n) FILTER (v IS NOT NULL), FALSE) AS date_like
            FROM (SELECT "{col}" AS v, count(*) AS n FROM {source} GROUP BY 1)"""
        )
    return f"""SELECT *, unique_values / total_values AS cardinality_ratio,
                      1 - top_rows / total_values AS evenness
               FROM ({" UNION ALL ".join(parts)})"""


_SCORED = """SELECT *, CASE
  WHEN kind IN ('date', 'timestamp') OR date_like THEN
    CASE WHEN cardinality_ratio >= 0.9 THEN 70 WHEN cardinality_ratio >= 0.3 THEN 90
         WHEN cardinality_ratio >= 0.05 THEN 95 WHEN unique_values >= 10 THEN 85
         WHEN unique_values >= 3 THEN 75 ELSE 60 END
  WHEN kind IN ('long', 'double') THEN
    CASE WHEN cardinality_ratio BETWEEN 0.05 AND 0.15 THEN 85
         WHEN cardinality_ratio > 0.15 AND cardinality_ratio <= 0.3 THEN 80
         WHEN cardinality_ratio > 0.3 AND cardinality_ratio <= 0.5 THEN 75
         WHEN cardinality_ratio >= 0.01 AND cardinality_ratio < 0.05 THEN 60 ELSE 30 END
  WHEN kind = 'string' THEN
    CASE WHEN cardinality_ratio BETWEEN 0.05 AND 0.2 THEN
           CASE WHEN evenness >= 0.7 THEN 85 WHEN evenness >= 0.5 THEN 80 ELSE 50 END
         WHEN cardinality_ratio >= 0.02 AND cardinality_ratio < 0.05 AND unique_values < 200 THEN
           CASE WHEN evenness >= 0.6 THEN 75 ELSE 40 END
         WHEN cardinality_ratio < 0.02 THEN
           CASE WHEN evenness >= 0.8 AND unique_values >= 5 THEN 60 ELSE 20 END
         WHEN cardinality_ratio > 0.2 AND cardinality_ratio <= 0.4 THEN 70 ELSE 30 END
  WHEN kind = 'boolean' THEN CASE WHEN null_count > 0 THEN 30 ELSE 20 END
  ELSE 0 END AS suitability_score,
  CASE
  WHEN kind IN ('date', 'timestamp') OR date_like THEN
    CASE WHEN cardinality_ratio >= 0.9 THEN 'year' WHEN cardinality_ratio >= 0.3 THEN 'year,month'
         WHEN cardinality_ratio >= 0.05 THEN 'year,month,day' ELSE 'identity' END
  WHEN kind IN ('long', 'double') THEN
    CASE WHEN cardinality_ratio <= 0.01 THEN 'identity'
         WHEN unique_values < 1000 THEN 'bucket 10' ELSE 'bucket 100' END
  WHEN kind = 'string' THEN
    CASE WHEN cardinality_ratio BETWEEN 0.05 AND 0.2 AND evenness < 0.5 THEN 'bucket 10'
         WHEN cardinality_ratio > 0.4 THEN 'bucket 50'
         WHEN cardinality_ratio > 0.2 THEN 'truncate 5,bucket 20'
         WHEN cardinality_ratio >= 0.02 AND cardinality_ratio < 0.05 AND unique_values >= 200
              THEN 'bucket 50'
         ELSE 'identity' END
  WHEN kind = 'boolean' AND null_count > 0 THEN 'identity' ELSE '' END AS transforms
FROM ({profile}) WHERE total_values > 0"""

_ADVICE_COLUMNS = """"column", type, unique_values, total_values, null_count, cardinality_ratio,
  suitability_score, transforms"""


def _scored_sql(source, columns, labels=None):
    return _SCORED.format(profile=_profile_sql(source, columns, labels))


def _advice_sql(source, columns, labels=None):
    return f"""SELECT {_ADVICE_COLUMNS} FROM ({_scored_sql(source, columns, labels)})
               WHERE suitability_score >= 75 AND transforms <> ''
               ORDER BY suitability_score DESC, field_id LIMIT 5"""


def _flat(advice):
    """Advice with its transforms as one text."""
    named = F.transform(
        "recommendations",
        lambda r: F.concat_ws(" ", r["transform"], r["width"].cast("string")),
    )
    return advice.select(
        "column",
        "type",
        "unique_values",
        "total_values",
        "null_count",
        "cardinality_ratio",
        "suitability_score",
        F.array_join(named, ",").alias("transforms"),
    )


# Parquet tables keep 32-bit integers, which profile under their own label.
_INT_LABELS = {
    c: "integer"
    for c in (
        "r_regionkey n_nationkey n_regionkey c_nationkey s_nationkey p_size l_linenumber "
        "quality toxic"
    ).split()
}
_PROFILE_COLUMNS = """"column", type, unique_values, total_values, null_count, cardinality_ratio,
  evenness, date_like"""


def _profiled(df):
    return profile(df).drop("field_id", "class", "evenness_error")


for _name in ("lineitem", "part", "documents"):
    query(
        f"column_profile_{_name}",
        f"""SELECT {_PROFILE_COLUMNS}
            FROM ({_profile_sql(_name, FLAT_TABLES[_name], _INT_LABELS)})""",
    )(
        lambda spark, sf_dir, _name=_name: _profiled(
            table(spark, sf_dir, _name).select(*FLAT_TABLES[_name])
        )
    )


_GAPPY_SQL = """(SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS customer,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice > 250000 END AS dear,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) END AS day,
    CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate END AS moment,
    CAST(NULL AS VARCHAR) AS nothing FROM orders)"""
_GAPPY = {
    "customer": "long",
    "status": "string",
    "dear": "boolean",
    "price": "double",
    "day": "date",
    "moment": "timestamp",
    "nothing": "string",
}


def _gappy(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 3 != 0, F.col("o_custkey")).alias("customer"),
        F.when(key % 2 == 0, F.col("o_orderstatus")).alias("status"),
        F.when(key % 5 != 0, F.col("o_totalprice") > 250000).alias("dear"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 4 == 1, F.to_date("o_orderdate")).alias("day"),
        F.when(key % 4 == 1, F.col("o_orderdate")).alias("moment"),
        F.lit(None).cast("string").alias("nothing"),
    )


@query(
    "column_profile_nulls",
    f"""SELECT "column", type, unique_values, total_values, null_count,
               CASE WHEN total_values > 0 THEN cardinality_ratio END AS cardinality_ratio,
               CASE WHEN total_values > 0 THEN evenness END AS evenness, date_like
        FROM ({_profile_sql(_GAPPY_SQL, _GAPPY)})""",
)
def column_profile_nulls(spark, sf_dir):
    return _profiled(_gappy(spark, sf_dir))


@query(
    "advise_nulls",
    f"SELECT {_ADVICE_COLUMNS} FROM ({_scored_sql(_GAPPY_SQL, _GAPPY)})",
)
def advise_nulls(spark, sf_dir):
    return _flat(advise(profile(_gappy(spark, sf_dir)), explain_all=True))


@query(
    "profile_sketched",
    f"""SELECT "column", unique_values,
               CASE WHEN kind = 'string' AND cardinality_ratio <= 0.25 THEN evenness END AS evenness
        FROM ({_profile_sql("lineitem", FLAT_TABLES["lineitem"])})""",
)
def profile_sketched(spark, sf_dir):
    """Sketched counts within 3% of the exact ones show the exact ones, others as they are."""
    lineitem = table(spark, sf_dir, "lineitem")
    exact = profile(lineitem).select("column", F.col("unique_values").alias("exact"))
    close = F.abs(F.col("unique_values") - F.col("exact")) <= 0.03 * F.col("exact")
    shown = F.when(close, F.col("exact")).otherwise(F.col("unique_values"))
    return profile_approx(lineitem).join(exact, "column").select(
        "column", shown.alias("unique_values"), "evenness"
    )


_DATED_SQL = """(SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso,
    strftime(o_orderdate, '%d/%m/%Y') AS slashed,
    'shipped ' || strftime(o_orderdate, '%m-%d-%Y') || ', paid' AS prose,
    o_orderpriority AS priority FROM orders)"""
_DATED = {"iso": "string", "slashed": "string", "prose": "string", "priority": "string"}


def _dated(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.to_date(day).cast("string").alias("iso"),
        F.date_format(day, "dd/MM/yyyy").alias("slashed"),
        F.concat(F.lit("shipped "), F.date_format(day, "MM-dd-yyyy"), F.lit(", paid")).alias(
            "prose"
        ),
        F.col("o_orderpriority").alias("priority"),
    )


@query("date_like", f"""SELECT "column", date_like FROM ({_profile_sql(_DATED_SQL, _DATED)})""")
def date_like(spark, sf_dir):
    return profile(_dated(spark, sf_dir)).select("column", "date_like")


@query(
    "date_like_anywhere",
    """SELECT 'iso' AS "column", TRUE AS date_like, count(*) AS total_values FROM orders
       UNION ALL SELECT 'slashed', TRUE, count(*) FROM orders
       UNION ALL SELECT 'prose', TRUE, count(*) FROM orders
       UNION ALL SELECT 'priority', FALSE, count(*) FROM orders""",
)
def date_like_anywhere(spark, sf_dir):
    found = profile(_dated(spark, sf_dir), date_share=0, anchored=False)
    return found.select("column", "date_like", "total_values")


@query(
    "date_like_whole",
    """SELECT 'iso' AS "column", bool_or(regexp_matches(CAST(CAST(o_orderdate AS DATE) AS VARCHAR),
              '^\\d{4}-\\d{2}-\\d{2}$')) AS date_like FROM orders
       UNION ALL SELECT 'slashed', count(*) > 0 FROM orders
       UNION ALL SELECT 'prose', FALSE
       UNION ALL SELECT 'priority', FALSE""",
)
def date_like_whole(spark, sf_dir):
    return profile(_dated(spark, sf_dir)).select("column", "date_like")


@query(
    "advise_then_load",
    """SELECT 'iso' AS "column", strftime(o_orderdate, '%Y') AS part, count(*) AS "rows"
       FROM orders GROUP BY ALL
       UNION ALL SELECT 'slashed', strftime(o_orderdate, '%Y'), count(*) FROM orders GROUP BY ALL""",
)
def advise_then_load(spark, sf_dir):
    """Each date-like column laid out by its year, as advice for many distinct dates has it, and
    counted by partition."""
    dated = _dated(spark, sf_dir)
    likely = profile(dated).where("date_like").select("column").orderBy("field_id").collect()
    found = []
    for (name,) in likely:
        target = f"{scratch_database(spark)}.target"
        layout = Transform(name, "year")
        write_table(dated, target, transforms=[layout])
        part = F.col(layout.partition_column).cast("string").alias("part")
        counted = spark.table(target).groupBy(part).agg(F.count("*").alias("rows"))
        found.append(counted.select(F.lit(name).alias("column"), "part", "rows"))
    return reduce(lambda a, b: a.unionByName(b), found)


@query(
    "advise_date_like",
    f"""SELECT {_ADVICE_COLUMNS} FROM ({_scored_sql(_DATED_SQL, _DATED)})""",
)
def advise_date_like(spark, sf_dir):
    return _flat(advise(profile(_dated(spark, sf_dir)), explain_all=True))


# Advice on text loads sees every integer as a long, as a CSV would.
for _name in ("orders", "lineitem", "supplier", "conversations"):
    query(f"advise_{_name}", _advice_sql(_name, FLAT_TABLES[_name], _INT_LABELS))(
        lambda spark, sf_dir, _name=_name: _flat(
            advise(profile(table(spark, sf_dir, _name).select(*FLAT_TABLES[_name])))
        )
    )


@query("advise_part_csv", _advice_sql("part", FLAT_TABLES["part"]))
def advise_part_csv(spark, sf_dir):
    text = read_text(spark, write_csv(table(spark, sf_dir, "part"), "part"))
    return _flat(advise(profile(apply_schema(text, infer_schema(text)))))


_ALL_SCORES = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, {_ADVICE_COLUMNS} FROM
        ({_scored_sql(t, FLAT_TABLES[t], _INT_LABELS)})"""
    for t in FLAT_TABLES
)


@query("advise_all_scores", _ALL_SCORES)
def advise_all_scores(spark, sf_dir):
    scored = [
        _flat(
            advise(
                profile(table(spark, sf_dir, t).select(*FLAT_TABLES[t])), explain_all=True
            )
        ).withColumn("table_name", F.lit(t))
        for t in FLAT_TABLES
    ]
    return reduce(lambda a, b: a.unionByName(b), scored)


@query(
    "advise_recommendations",
    f"""WITH a AS (SELECT * FROM ({_scored_sql("orders", FLAT_TABLES["orders"])})
                   WHERE suitability_score >= 75 AND transforms <> ''
                   ORDER BY suitability_score DESC, field_id LIMIT 5),
        parts AS (
          SELECT *, kind IN ('date', 'timestamp') OR date_like AS dated,
                 unnest(string_split(transforms, ',')) AS part,
                 unnest(range(len(string_split(transforms, ',')))) AS position FROM a)
        SELECT "column", suitability_score, CAST(position AS INTEGER) AS position, split_part(part, ' ', 1) AS transform,
               TRY_CAST(split_part(part, ' ', 2) AS INTEGER) AS width,
               CASE WHEN part LIKE 'bucket %' THEN 'Hash into ' || split_part(part, ' ', 2)
                                                   || ' buckets'
                    WHEN part <> 'identity' THEN 'Partition by ' || part
                    WHEN dated AND unique_values >= 10
                      THEN 'Partition directly by date (low cardinality)'
                    WHEN dated THEN 'Partition directly by date (very low cardinality)'
                    WHEN suitability_score = 85
                      THEN 'Partition directly by this column (excellent distribution)'
                    WHEN suitability_score = 80
                      THEN 'Partition directly by this column (good distribution)'
                    ELSE 'Partition directly by this column' END AS description,
               CASE WHEN part LIKE 'bucket %' THEN 'PARTITION BY bucket('
                      || split_part(part, ' ', 2) || ', ' || "column" || ')'
                    WHEN part = 'identity' THEN 'PARTITION BY ' || "column"
                    ELSE 'PARTITION BY ' || part || '(' || "column" || ')' END AS example
        FROM parts""",
)
def advise_recommendations(spark, sf_dir):
    return recommendation_rows(advise(profile(table(spark, sf_dir, "orders"))))


@query(
    "advise_presented",
    f"""SELECT "column", type, suitability_score,
               CASE WHEN suitability_score >= 90 THEN 'Perfect'
                    WHEN suitability_score >= 80 THEN 'Excellent' ELSE 'Very Good' END AS band,
               CAST(printf('%.2f', cardinality_ratio * 100) AS DOUBLE) AS cardinality_ratio, unique_values,
               total_values, regexp_replace(transforms, ' [0-9]+', '', 'g') AS transforms
        FROM ({_advice_sql("lineitem", FLAT_TABLES["lineitem"], _INT_LABELS)})""",
)
def advise_presented(spark, sf_dir):
    shown = present(advise(profile(table(spark, sf_dir, "lineitem"))))
    return shown.withColumn("transforms", F.array_join("transforms", ","))
