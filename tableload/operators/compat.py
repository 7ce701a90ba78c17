"""Is an inferred schema compatible with an existing table?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ACCEPTED_TYPES, MAX_TYPE_MISMATCH, MIN_COLUMN_MATCH


def base_type(sql_type: Column) -> Column:
    """``DECIMAL(38, 10)`` → ``DECIMAL``."""
    return F.trim(F.upper(F.substring_index(sql_type, "(", 1)))


def types_compatible(existing: Column, inferred: Column) -> Column:
    """Whether a column of type ``existing`` takes values of type ``inferred``.

    An existing type outside the rule table takes everything.
    """
    old, new = base_type(existing), base_type(inferred)
    rules = F.create_map(
        *[
            item
            for known, accepted in ACCEPTED_TYPES.items()
            for item in (F.lit(known), F.array(*[F.lit(a) for a in accepted]))
        ]
    )
    both = [old.contains(k) & new.contains(k) for k in ("TIMESTAMP", "DATE")]
    return (
        F.when((old == new) | both[0] | both[1], True)
        .when(old.isin(*ACCEPTED_TYPES), F.array_contains(F.try_element_at(rules, old), new))
        .otherwise(True)
    )


def compare_schemas(existing: DataFrame, inferred: DataFrame) -> DataFrame:
    """Per inferred column: the existing type of the same name, if any, and the verdict.

    Both inputs are schema rows (``name``, ``sql_type``). Names match without regard to case;
    existing columns the load does not supply are left out.
    """
    old = existing.select(
        F.lower(F.btrim("name", F.lit('"'))).alias("__key"),
        F.col("sql_type").alias("existing_type"),
    )
    new = inferred.select(
        "field_id",
        "name",
        F.col("sql_type").alias("inferred_type"),
        F.lower("name").alias("__key"),
    )
    joined = new.join(old, "__key", "left").drop("__key")
    return joined.select(
        "*",
        F.col("existing_type").isNotNull().alias("matched"),
        F.when(
            F.col("existing_type").isNotNull(),
            types_compatible(F.col("existing_type"), F.col("inferred_type")),
        ).alias("compatible"),
    )


def schema_verdict(comparison: DataFrame) -> DataFrame:
    """One row: enough columns matched and few enough type mismatches?"""
    counts = comparison.agg(
        F.count("*").alias("columns"),
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("compatible")).alias("mismatched"),
    )
    total = F.col("columns")
    enough = F.col("matched") / total >= MIN_COLUMN_MATCH
    few = F.col("mismatched") / total <= MAX_TYPE_MISMATCH
    return counts.withColumn("compatible", F.when(total > 0, enough & few).otherwise(False))
