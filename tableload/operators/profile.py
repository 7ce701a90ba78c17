"""Profile every column: distinct values, nulls, the largest value group, date-like text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import as_text, column, zoneless_micros
from ..functions.fixed import DATE_LIKE_PATTERNS, SCORES
from ..functions.samples import random_sample
from ..functions.typenames import logical_type, type_class, type_label

_ANYWHERE = "|".join(DATE_LIKE_PATTERNS)
_WHOLE = f"^({_ANYWHERE})" + r"\z"

# Text is date-like when at least this share of its filled values are dates.
DATE_LIKE_SHARE = 0.9

# Most frequent values that a sketch tracks exactly, and the type of such a sketch.
TOP_CAPACITY = 8192
_TOP = "struct<sketch:binary,maxItemsTracked:int,itemDataType:bigint,itemDataTypeDDL:string>"
# Where the advice for text asks for evenness.
_THRESHOLDS = sorted(
    {float(x) for rule, _ in SCORES["string"] for x in re.findall(r"\be >= ([0-9.]+)D", rule)}
)

# Text longer than this is grouped by digest, so that prose does not travel through the shuffle.
_DIGEST_BYTES = 64


def _typed_key(cell: Column, data_type: T.DataType, pattern: str) -> dict[str, Column]:
    """One cell as a grouping key: whole numbers and times as bigint, fractions as double,
    everything else as text."""
    if isinstance(data_type, T.DateType):
        return {"whole": F.unix_date(cell).cast("bigint")}
    if isinstance(data_type, T.TimestampNTZType):
        return {"whole": zoneless_micros(cell)}
    if isinstance(data_type, T.TimestampType):
        return {"whole": F.unix_micros(cell)}
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return {"whole": cell.cast("bigint")}
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return {"fraction": cell.cast("double")}
    value = as_text(cell, data_type)
    long_text = F.octet_length(value) > _DIGEST_BYTES
    digest = F.concat(F.lit("sha256:"), F.sha2(value, 256))
    key = {"text": F.when(long_text, digest).otherwise(value)}
    if isinstance(data_type, T.StringType):
        key["hit"] = F.when(long_text, value.rlike(pattern))
    return key


def value_counts(df: DataFrame, *, anchored: bool = True) -> DataFrame:
    """Rows per distinct value of every column: ``pos``, key columns, ``hit``, ``rows``.

    One shuffle, on (column, value). Partial aggregation sends each value at most once per
    task, so a value held by a third of all rows is no hot spot.
    """
    pattern = _WHOLE if anchored else _ANYWHERE
    unused = {
        name: F.lit(None).cast(kind).alias(name)
        for name, kind in (
            ("whole", "bigint"), ("fraction", "double"), ("text", "string"), ("hit", "boolean"),
        )
    }
    keys = []
    for i, f in enumerate(df.schema):
        used = _typed_key(column(f.name), f.dataType, pattern)
        parts = {**unused, **{n: c.alias(n) for n, c in used.items()}}
        keys.append(F.struct(F.lit(i).alias("pos"), *parts.values()))
    return (
        df.select(F.inline(F.array(*keys)))
        .groupBy("pos", "whole", "fraction", "text")
        .agg(F.bool_or("hit").alias("hit"), F.count("*").alias("rows"))
    )


def _named(per_column: DataFrame, schema: T.StructType, *others: str) -> DataFrame:
    """Add name, type and class by position and derive the ratios; ``others`` stay last."""

    def lookup(values: list[str]) -> Column:
        # A constant: parsed once, when the plan is optimised.
        return F.get(F.from_json(F.lit(json.dumps(values)), "array<string>"), F.col("pos"))

    kind = lookup([type_class(f.dataType) for f in schema])
    filled = F.col("total_values") > 0
    return per_column.select(
        (F.col("pos") + 1).alias("field_id"),
        lookup([f.name for f in schema]).alias("column"),
        lookup([_label(f.dataType) for f in schema]).alias("type"),
        F.when((kind == "string") & F.col("date_like"), F.lit("datetime"))
        .otherwise(kind)
        .alias("class"),
        "unique_values",
        "total_values",
        "null_count",
        F.when(filled, F.col("unique_values") / F.col("total_values")).alias("cardinality_ratio"),
        F.when(filled, 1.0 - F.col("top_rows") / F.col("total_values")).alias("evenness"),
        "date_like",
        *others,
    )


def _label(data_type: T.DataType) -> str:
    return type_label(logical_type(data_type)).split("(")[0]


def profile(
    df: DataFrame,
    *,
    exact: bool = False,
    sample_rows: int | None = None,
    date_share: float = DATE_LIKE_SHARE,
    anchored: bool = True,
) -> DataFrame:
    """One row per column.

    ``unique_values`` counts null as a value; it is sketched (see ``profile_approx``) unless
    ``exact`` asks for a shuffle of every distinct value. ``evenness`` is one minus the share of
    the most frequent value, and ``evenness_error`` how much greater it may be, 0 if it was
    counted. ``date_like`` marks text of which at least ``date_share`` of the
    filled values are dates as a whole, or with ``anchored=False`` hold one anywhere; a share of
    0 asks for a single one. Looks at all rows unless ``sample_rows`` asks for a random sample of
    about that many.
    """
    if sample_rows is not None:
        df = random_sample(df, sample_rows)
    how = profile_exact if exact else profile_approx
    return how(df, date_share=date_share, anchored=anchored)


def _date_like(dates: Column, filled: Column, share: float) -> Column:
    return (dates > 0) & (dates >= F.lit(share) * filled)


def profile_exact(
    df: DataFrame, *, date_share: float = DATE_LIKE_SHARE, anchored: bool = True
) -> DataFrame:
    """``profile`` with every value counted: one scan, one shuffle of all distinct values."""
    pattern = _WHOLE if anchored else _ANYWHERE
    string_pos = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)]
    is_null = F.col("whole").isNull() & F.col("fraction").isNull() & F.col("text").isNull()
    looks = F.coalesce(
        "hit", F.when(F.col("pos").isin(*string_pos), F.col("text").rlike(pattern))
    ) if string_pos else F.lit(False)
    per_column = (
        value_counts(df, anchored=anchored)
        .groupBy("pos")
        .agg(
            F.count("*").alias("unique_values"),
            F.coalesce(F.sum(F.when(~is_null, F.col("rows"))), F.lit(0)).alias("total_values"),
            F.coalesce(F.sum(F.when(is_null, F.col("rows"))), F.lit(0)).alias("null_count"),
            F.max("rows").alias("top_rows"),
            F.coalesce(F.sum(F.when(looks, F.col("rows"))), F.lit(0)).alias("dates"),
        )
        .withColumn(
            "date_like", _date_like(F.col("dates"), F.col("total_values"), date_share)
        )
    )
    per_column = per_column.withColumn("evenness_error", F.lit(0.0))
    return _named(per_column, df.schema, "evenness_error")


def profile_sketches(
    df: DataFrame,
    *,
    precision: int = 13,
    capacity: int = TOP_CAPACITY,
    anchored: bool = True,
) -> DataFrame:
    """What one scan tells of each column, such that it adds up over batches: rows, filled and
    date-like cells, a sketch of the distinct values (``distinct``) and, of text, one of the most
    frequent values (``top``). One row per column; no values are shuffled.

    ``precision`` is the base-2 logarithm of the distinct sketch's size; 13 errs by about one
    percent. ``capacity`` values are tracked exactly in ``top``; see ``profile_of_sketches``.
    """
    pattern = _WHOLE if anchored else _ANYWHERE
    aggs = []
    for i, f in enumerate(df.schema):
        is_text = isinstance(f.dataType, T.StringType)
        cell = as_text(column(f.name), f.dataType) if _label(f.dataType) == "string" else column(
            f.name
        )
        dates = F.count_if(cell.rlike(pattern)) if is_text else F.lit(0).cast("bigint")
        # The hash of null is a value of its own, as null is in the count.
        hashed = F.xxhash64(cell)
        top = F.call_function("approx_top_k_accumulate", hashed, F.lit(capacity))
        aggs.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.json()).alias("kind"),
                F.count("*").alias("rows"),
                F.count(cell).alias("filled"),
                dates.alias("dates"),
                F.hll_sketch_agg(hashed, F.lit(precision)).alias("distinct"),
                (top if is_text else F.lit(None).cast(_TOP)).cast(_TOP).alias("top"),
            ).alias(f"c{i}")
        )
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])))


def merge_sketches(sketches: DataFrame, capacity: int = TOP_CAPACITY) -> DataFrame:
    """The sketches of several batches as those of all their rows. Columns go by name; they keep
    the least position and the type of it."""
    first = F.min(F.struct("pos", "kind"))
    sums = (
        sketches.groupBy("column")
        .agg(
            first.alias("first"),
            *[F.sum(c).alias(c) for c in ("rows", "filled", "dates")],
            F.expr("hll_union_agg(distinct, true)").alias("distinct"),
        )
        .select("first.pos", "column", "first.kind", "rows", "filled", "dates", "distinct")
    )
    combine = F.call_function("approx_top_k_combine", "top", F.lit(capacity)).cast(_TOP)
    tops = sketches.where("top is not null").groupBy("column").agg(combine.alias("top"))
    return sums.join(tops, "column", "left").select(*sketches.columns)


def profile_of_sketches(
    sketches: DataFrame, *, capacity: int = TOP_CAPACITY, date_share: float = DATE_LIKE_SHARE
) -> DataFrame:
    """``profile`` from sketches (one row per column), without the data.

    ``evenness`` is there for text whose distinct ratio leaves it open (at most 0.25), and
    ``evenness_error`` says how much greater it may be: nothing while at most ``capacity`` values
    were tracked, else 3.5 rows in each slot of the sketch's table, over the filled ones.
    """
    rows = sketches.select(
        "pos", "column", "kind", "rows", "filled", "dates",
        F.hll_sketch_estimate("distinct").alias("unique_values"),
        F.when(
            F.col("top").isNotNull(),
            F.expr("element_at(approx_top_k_estimate(top, 1), 1).count"),
        ).alias("most"),
    ).collect()  # one small row per column
    fields = [
        {"name": r["column"], "type": json.loads(r["kind"]), "nullable": True, "metadata": {}}
        for r in rows
    ]
    schema = T.StructType.fromJson({"type": "struct", "fields": fields})
    slots = 1 << (-(-4 * capacity // 3) - 1).bit_length()
    found = []
    for i, r in enumerate(rows):
        open_ = r["most"] is not None and r["filled"] and r["unique_values"] <= 0.25 * r["filled"]
        # The distinct count is an estimate too; a tenth is far beyond its error.
        whole = r["unique_values"] * 1.1 <= capacity
        found.append(
            (
                i, r["pos"], r["unique_values"], r["filled"], r["rows"] - r["filled"], r["dates"],
                r["most"] if open_ else None,
                (0.0 if whole else 3.5 / slots * r["rows"] / r["filled"]) if open_ else None,
            )
        )
    per_column = sketches.sparkSession.createDataFrame(
        found,
        "pos int, place int, unique_values bigint, total_values bigint, null_count bigint, "
        "dates bigint, top_rows bigint, evenness_error double",
    ).withColumn("date_like", _date_like(F.col("dates"), F.col("total_values"), date_share))
    named = _named(per_column, schema, "place", "evenness_error")
    return named.withColumn("field_id", F.col("place") + 1).drop("place")


def profile_approx(
    df: DataFrame,
    *,
    precision: int = 13,
    capacity: int = TOP_CAPACITY,
    date_share: float = DATE_LIKE_SHARE,
    anchored: bool = True,
) -> DataFrame:
    """Like ``profile_exact`` with sketches (``profile_sketches``): one scan, and no shuffle of
    values. Text columns whose evenness is known only so closely that a threshold of the advice
    lies within its error are counted by value in a second scan; others report the error."""
    sketches = profile_sketches(df, precision=precision, capacity=capacity, anchored=anchored)
    found = profile_of_sketches(sketches, capacity=capacity, date_share=date_share)
    thresholds = F.array(*[F.lit(t) for t in _THRESHOLDS])
    low, high = F.col("evenness"), F.col("evenness") + F.col("evenness_error")
    spans = F.exists(thresholds, lambda t: (low < t) & (t <= high))
    # One small row per column.
    open_ = [r["column"] for r in found.where("evenness_error > 0").where(spans).collect()]
    if not open_:
        return found
    names = F.array(*[F.lit(n) for n in open_])
    tops = (
        value_counts(df.select([column(n) for n in open_]))
        .groupBy(F.get(names, F.col("pos")).alias("column"))
        .agg(F.max("rows").alias("top_rows"))
    )
    known = F.col("top_rows").isNotNull()
    exact = 1.0 - F.col("top_rows") / F.col("total_values")
    return found.join(tops, "column", "left").select(
        *[
            F.when(known, exact).otherwise(F.col(c)).alias(c) if c == "evenness"
            else F.when(known, 0.0).otherwise(F.col(c)).alias(c) if c == "evenness_error"
            else F.col(c)
            for c in found.columns
        ]
    )
