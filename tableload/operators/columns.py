"""Choose and rename columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..functions.cells import column
from ..functions.names import clean_names


def name_list(names: str | Iterable[str] | None) -> list[str]:
    """``"a, b"`` or a list, as a list of stripped names."""
    if not names:
        return []
    parts = names.split(",") if isinstance(names, str) else names
    return [p.strip() for p in parts if p.strip()]


def chosen_columns(
    available: list[str],
    include: str | Iterable[str] | None = None,
    exclude: str | Iterable[str] | None = None,
) -> list[str]:
    """Names kept, in input order. ``include`` wins over ``exclude``; a choice that keeps
    nothing keeps everything."""
    wanted, unwanted = set(name_list(include)), set(name_list(exclude))
    if wanted:
        kept = [n for n in available if n.strip() in wanted]
    else:
        kept = [n for n in available if n.strip() not in unwanted]
    return kept or list(available)


def unknown_columns(
    available: list[str],
    include: str | Iterable[str] | None = None,
    exclude: str | Iterable[str] | None = None,
) -> list[str]:
    """Names asked for that the input does not have; they are ignored, not an error."""
    known = {n.strip() for n in available}
    return [n for n in name_list(include) + name_list(exclude) if n not in known]


def select_columns(
    df: DataFrame,
    include: str | Iterable[str] | None = None,
    exclude: str | Iterable[str] | None = None,
) -> DataFrame:
    """The chosen columns; Catalyst prunes the rest down to the scan."""
    return df.select([column(n) for n in chosen_columns(df.columns, include, exclude)])


def clean_columns(df: DataFrame) -> DataFrame:
    """The frame under cleaned column names."""
    return df.toDF(*clean_names(df.columns))
