"""Check the shape of delimited text over the whole input, line by line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per physical line: ``value``."""
    return spark.read.text(path)


def _quoted_cells(sep: str, quote: str) -> str:
    """Pattern of a whole quoted cell and what stands before it."""
    q = re.escape(quote)
    return f"(\\A|{re.escape(sep)}){q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}"


def _fields(sep: str, quote: str) -> Column:
    """How many fields a line has; separators within quoted cells divide none."""
    bare = F.col("value")
    if quote:
        cells = F.regexp_replace("value", _quoted_cells(sep, quote), "$1")
        bare = F.when(bare.contains(quote), cells).otherwise(bare)
    removed = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep)))
    return (removed / len(sep)).cast("int") + 1


def field_counts(line_df: DataFrame, sep: str = ",", quote: str = '"') -> DataFrame:
    """How many non-blank lines have how many fields: ``fields``, ``lines``. Separators within
    quoted cells do not count.

    Partial aggregation leaves one row per distinct field count and task to shuffle.
    """
    return (
        line_df.where(F.trim("value") != "")
        .groupBy(_fields(sep, quote).alias("fields"))
        .agg(F.count("*").alias("lines"))
    )


def structure_report(
    spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"'
) -> DataFrame:
    """One row on the input's shape.

    ``first_fields`` comes from the first line; ``usual_fields`` is the most common count, the
    first line's count winning ties; ``odd_lines`` differ from the first line; separators within
    quoted cells do not count. Lines with an
    odd number of quotes hint at quoted newlines (``multiline_hint``).
    """
    text = lines(spark, path)
    head = text.head()
    first = head["value"] if head else ""
    blank_first = not first.strip()
    bare = re.sub(_quoted_cells(sep, quote), r"\1", first) if quote else first
    first_fields = 0 if blank_first else bare.count(sep) + 1

    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit(quote)))
    split_quote = (quotes % 2 == 1) if quote else F.lit(False)
    shape = text.select(
        F.when(F.trim("value") != "", _fields(sep, quote)).alias("fields"),
        split_quote.alias("split_quote"),
    )
    per_count = shape.groupBy("fields").agg(
        F.count("*").alias("lines"), F.bool_or("split_quote").alias("split_quote")
    )
    filled = F.col("fields").isNotNull()
    rank = F.struct(
        F.col("lines"), (F.col("fields") == first_fields), (-F.col("fields")).alias("fewest")
    )
    return per_count.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(~filled, F.col("lines"))), F.lit(0)).alias("blank_lines"),
        F.lit(blank_first).alias("blank_first_line"),
        F.lit(sep in first).alias("separator_in_first_line"),
        F.lit(first_fields).alias("first_fields"),
        F.max_by("fields", F.when(filled, rank)).alias("usual_fields"),
        F.count("fields").alias("distinct_counts"),
        F.coalesce(
            F.sum(F.when(filled & (F.col("fields") != first_fields), F.col("lines"))), F.lit(0)
        ).alias("odd_lines"),
        F.coalesce(F.bool_or("split_quote"), F.lit(False)).alias("multiline_hint"),
    ).select(
        (F.col("lines") == 0).alias("empty"),
        "*",
        (~((F.col("lines") == 0) | F.col("blank_first_line"))).alias("valid"),
    )
