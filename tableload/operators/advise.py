"""Recommend partition transforms from a column profile."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import round_exact
from ..functions.fixed import BANDS, LOWEST_BAND, MIN_SCORE, SCORES, TOP_COLUMNS, TRANSFORMS

_TEMPLATE = (
    "array<array<struct<"
    "transform:string,width:int,description:string,before:string,after:string>>>"
)


def _rule_number(rules) -> Column:
    """The position of the first rule that holds, counted over all classes."""
    conditions = [(kind, cond) for kind, cases in rules.items() for cond, _ in cases]
    cases = [
        f"WHEN class = '{kind}' AND ({condition}) THEN {i}"
        for i, (kind, condition) in enumerate(conditions)
    ]
    return F.expr(f"CASE {' '.join(cases)} END")


def _template(transform: str, width: int | None, description: str, note: str) -> dict:
    before, after = {
        "identity": ("", ""),
        "bucket": (f"bucket({width}, ", ")"),
        "truncate": ("truncate(", f", {width})"),
    }.get(transform, (f"{transform}(", ")"))
    return {
        "transform": transform,
        "width": width,
        "description": description,
        "before": f"PARTITION BY {before}",
        "after": f"{after}{note}",
    }


def _recommendations(rule: Column) -> Column:
    """The rule's recommendations with the column's name filled in."""
    templates = [
        [_template(*t) for t in transforms]
        for cases in TRANSFORMS.values()
        for _, transforms in cases
    ]
    # A constant: parsed once, when the plan is optimised.
    chosen = F.get(F.from_json(F.lit(json.dumps(templates)), _TEMPLATE), rule)
    filled = F.transform(
        chosen,
        lambda t: F.struct(
            t["transform"].alias("transform"),
            t["width"].alias("width"),
            t["description"].alias("description"),
            F.concat(t["before"], F.col("column"), t["after"]).alias("example"),
        ),
    )
    return F.coalesce(filled, F.array())


def score_columns(profile_df: DataFrame) -> DataFrame:
    """Every profiled column that holds data, with its score and recommendations."""
    ruled = profile_df.where("total_values > 0").select(
        "*",
        F.col("cardinality_ratio").alias("r"),
        F.col("unique_values").alias("u"),
        F.col("evenness").alias("e"),
        F.col("null_count").alias("nulls"),
    )
    scores = [score for cases in SCORES.values() for _, score in cases]
    score = F.get(F.from_json(F.lit(json.dumps(scores)), "array<int>"), _rule_number(SCORES))
    return ruled.select(
        *profile_df.columns,
        F.coalesce(score, F.lit(0)).alias("suitability_score"),
        _recommendations(_rule_number(TRANSFORMS)).alias("recommendations"),
    )


def advise(
    profile_df: DataFrame,
    *,
    top: int = TOP_COLUMNS,
    min_score: int = MIN_SCORE,
    explain_all: bool = False,
) -> DataFrame:
    """The best columns to partition by, best first; equal scores keep column order.

    ``explain_all`` returns every column with its score instead.
    """
    scored = score_columns(profile_df)
    ranking = [F.desc("suitability_score"), F.asc("field_id")]
    if explain_all:
        return scored.orderBy(*ranking)
    good = (F.col("suitability_score") >= min_score) & (F.size("recommendations") > 0)
    return scored.where(good).orderBy(*ranking).limit(top)


def score_band(score: Column) -> Column:
    """``Perfect``, ``Excellent`` or ``Very Good``."""
    out = F
    for least, label in BANDS:
        out = out.when(score >= least, F.lit(label))
    return out.otherwise(F.lit(LOWEST_BAND))


def present(advice: DataFrame) -> DataFrame:
    """Advice for display: ratio as a percentage with two decimals, band, transform names."""
    return advice.select(
        "column",
        "type",
        "suitability_score",
        score_band(F.col("suitability_score")).alias("band"),
        round_exact(F.col("cardinality_ratio") * 100, 2).alias("cardinality_ratio"),
        "unique_values",
        "total_values",
        F.col("recommendations.transform").alias("transforms"),
    )


def recommendation_rows(advice: DataFrame) -> DataFrame:
    """One row per recommended transform, in order."""
    return advice.select(
        "column",
        "suitability_score",
        F.posexplode("recommendations").alias("position", "recommendation"),
    ).select("column", "suitability_score", "position", "recommendation.*")
