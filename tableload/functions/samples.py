"""Samples of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .cells import column

def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """The first rows as read."""
    return df.limit(rows)


def head_sample(df: DataFrame, rows: int, *, order_by: str | None = None) -> DataFrame:
    """The first rows as read, or the first by a key when the choice must be repeatable."""
    return df.orderBy(column(order_by)).limit(rows) if order_by else first_rows(df, rows)


def random_sample(
    df: DataFrame, rows: int, *, seed: int = 42, total: int | None = None
) -> DataFrame:
    """About ``rows`` rows without replacement: a per-partition coin flip, never a shuffle.

    The fraction is ``rows / total`` kept between 1% and everything.
    """
    total = df.count() if total is None else total
    fraction = min(1.0, max(0.01, rows / total)) if total else 1.0
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
