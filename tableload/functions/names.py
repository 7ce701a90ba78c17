"""Column names: cleaning, de-duplication and collision checks."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import NAME_PREFIX, RESERVED_NAMES, UNNAMED

# Java and RE2 agree on these classes; Python's \w differs, hence the two forms below.
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_NOT_NAME_CHAR = r"[^\p{L}\p{N}_]"
_NAME_START = r"^[\p{L}_]"


def clean_name(name: str | None) -> str:
    """A column name safe in SQL: letters, digits and underscores, never a reserved word."""
    if not name:
        return UNNAMED
    safe = re.sub(r"\W", "_", name.strip())
    starts_well = safe[:1].isalpha() or safe.startswith("_")
    needs_prefix = not starts_well or safe.lower() in RESERVED_NAMES
    return NAME_PREFIX + safe if needs_prefix else safe


def clean_name_col(name: Column) -> Column:
    """``clean_name`` over a column of names."""
    safe = F.regexp_replace(F.regexp_replace(name, _EDGE_SPACE, ""), _NOT_NAME_CHAR, "_")
    prefixed = F.concat(F.lit(NAME_PREFIX), safe)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit(UNNAMED))
        .when(~safe.rlike(_NAME_START) | F.lower(safe).isin(*RESERVED_NAMES), prefixed)
        .otherwise(safe)
    )


def clean_names(names: list[str]) -> list[str]:
    """Cleaned names in order; two names that clean to the same one are an error."""
    cleaned = [clean_name(n) for n in names]
    clashing = {k for k, n in Counter(c.lower() for c in cleaned).items() if n > 1}
    if clashing:
        sources = [n for n, c in zip(names, cleaned) if c.lower() in clashing]
        raise ValueError(f"column names clash once cleaned: {sources}")
    return cleaned


def unique_names(names: list[str]) -> list[str]:
    """Header names as read, with empty ones filled in and repeats numbered.

    Spark ignores case in names, so names that differ only in case count as repeats. A numbered
    name never takes one the header itself holds.
    """
    filled = [n.strip() or UNNAMED for n in names]
    given = {n.lower() for n in filled}
    used: set[str] = set()
    out: list[str] = []
    for name in filled:
        candidate, repeat = name, 0
        while candidate.lower() in used or (candidate != name and candidate.lower() in given):
            candidate = f"{name}_duplicated_{repeat}"
            repeat += 1
        used.add(candidate.lower())
        out.append(candidate)
    return out
