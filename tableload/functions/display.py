"""Display columns for load history: sizes, durations, timestamps and status labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import zoneless_micros
from .fixed import STATUS_LABELS

_KB, _MB, _GB, _TB = (float(1024**i) for i in range(1, 5))


# Splits a double into two halves whose products with small numbers are exact.
_SPLITTER = 134217729.0


def scaled_round(value: Column, digits: int) -> Column:
    """``value * 10**digits`` rounded to a whole number, judged on the exact binary value.

    Spark's own rounding judges the shortest decimal form, which differs where that form ends
    in 5 and the stored number does not. Exact halves go to the even neighbour.
    """
    scale = F.lit(10.0**digits)
    product = value * scale
    upper = value * _SPLITTER - (value * _SPLITTER - value)
    error = (upper * scale - product) + (value - upper) * scale
    below = F.floor(product)
    part = product - below
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (below % 2 != 0))))
    return below + F.when(up, 1).otherwise(0)


def round_exact(value: Column, digits: int) -> Column:
    """The double nearest to ``value`` rounded to ``digits`` decimals."""
    return scaled_round(value, digits) / F.lit(10.0**digits)


def _fixed(value: Column, digits: int, suffix: str) -> Column:
    """A non-negative value with a fixed number of decimals."""
    whole = scaled_round(value, digits)
    unit = 10**digits
    return F.format_string(
        f"%d.%0{digits}d{suffix}", F.floor(whole / unit), whole % unit
    )


def size_label(size: Column) -> Column:
    """``512 B``, ``1.50 KB``, ``2.25 MB``, ``1.00 GB``."""
    size = size.cast("bigint")
    return (
        F.when(size < int(_KB), F.format_string("%d B", size))
        .when(size < int(_MB), _fixed(size / _KB, 2, " KB"))
        .when(size < int(_GB), _fixed(size / _MB, 2, " MB"))
        .otherwise(F.when(size.isNotNull(), _fixed(size / _GB, 2, " GB")))
    )


def size_text(size: Column) -> Column:
    """Two decimals in every unit up to TB; ``0 B`` when absent or zero."""
    size = size.cast("double")
    return (
        F.when(F.coalesce(size, F.lit(0.0)) == 0.0, F.lit("0 B"))
        .when(size < _KB, _fixed(size, 2, " B"))
        .when(size < _MB, _fixed(size / _KB, 2, " KB"))
        .when(size < _GB, _fixed(size / _MB, 2, " MB"))
        .when(size < _TB, _fixed(size / _GB, 2, " GB"))
        .otherwise(_fixed(size / _TB, 2, " TB"))
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds between two timestamps without zone, with fraction."""
    return (zoneless_micros(end) - zoneless_micros(start)) / F.lit(1e6)


def duration_label(seconds: Column) -> Column:
    """``HH:MM:SS``; ``N/A`` when unknown, never negative."""
    whole = F.floor(F.greatest(seconds.cast("double"), F.lit(0.0))).cast("bigint")
    return F.when(seconds.isNull(), F.lit("N/A")).otherwise(
        F.format_string(
            "%02d:%02d:%02d",
            F.floor(whole / 3600),
            F.floor((whole % 3600) / 60),
            whole % 60,
        )
    )


def duration_text(seconds: Column) -> Column:
    """``12.5 seconds``, ``3.2 minutes`` or ``1.25 hours``."""
    seconds = seconds.cast("double")
    return (
        F.when(seconds.isNull(), F.lit("N/A"))
        .when(seconds < 60, _fixed(seconds, 1, " seconds"))
        .when(seconds < 3600, _fixed(seconds / 60, 1, " minutes"))
        .otherwise(_fixed(seconds / 3600, 2, " hours"))
    )


def timestamp_label(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; ``N/A`` when absent."""
    return F.coalesce(F.substring(ts.cast("string"), 1, 19), F.lit("N/A"))


def status_label(status: Column) -> Column:
    """Capitalised status; ``Unknown`` when absent."""
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    capitalised = F.concat(
        F.upper(F.substring(status, 1, 1)), F.lower(F.substring(status, 2, 2147483647))
    )
    return F.when(F.coalesce(status, F.lit("")) == "", F.lit("Unknown")).otherwise(
        F.coalesce(F.try_element_at(labels, F.lower(status)), capitalised)
    )
