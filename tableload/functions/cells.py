"""Column expressions over CSV cells held as text: null tokens, kinds and typed parsing.

Everything here is built-in Spark expressions, so it runs inside code generation. A cell is
parsed only when it matches the pattern of its type *and* the cast succeeds; the patterns keep
Spark's laxer casts ("1d" as a double, "2024" as a date) out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import (
    BOOLEAN_PATTERN,
    DATE_PATTERN,
    INTEGER_PATTERN,
    NULL_TOKENS,
    NUMBER_PATTERN,
    TIMESTAMP_PATTERN,
)

# One bit per kind of cell, so that a column's kinds combine with bit_or.
BOOLEAN, LONG, DOUBLE, DATE, TIMESTAMP, TEXT = 1, 2, 4, 8, 16, 32

_NUMBER_PARTS = r"^[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\z"
_NUMERIC_START = tuple("+-.0123456789")
_BOOLEAN_START = tuple("tTfF")


def column(name: str) -> Column:
    """The column called exactly ``name``, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_tokens(cell: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """The cell, or null when it is one of the null tokens."""
    return F.when(~cell.isin(*tokens), cell)


def _as_date(cell: Column) -> Column:
    return F.translate(cell, "/", "-").try_cast("date")


def cell_kind(cell: Column) -> Column:
    """The kind bit of one text cell; 0 for null.

    The patterns exclude each other, so cheap tests of length and single characters first rule
    out those that cannot match: prose costs no regular expression, most values only one.
    """
    start = F.substring(cell, 1, 1)
    fifth = F.substring(cell, 5, 1)
    size = F.octet_length(cell)
    numeric = (
        F.when(
            (size == 10) & fifth.isin("-", "/") & cell.rlike(DATE_PATTERN),
            F.when(_as_date(cell).isNotNull(), DATE).otherwise(TEXT),
        )
        .when(
            size.between(16, 29) & (fifth == "-") & cell.rlike(TIMESTAMP_PATTERN),
            F.when(cell.try_cast("timestamp_ntz").isNotNull(), TIMESTAMP).otherwise(TEXT),
        )
        .when(
            (size <= 20) & ~cell.contains(".") & cell.rlike(INTEGER_PATTERN),
            F.when(cell.try_cast("bigint").isNotNull(), LONG).otherwise(TEXT),
        )
        # Whole numbers too long for bigint stay text: a double would merge neighbours.
        .when(
            (cell.contains(".") | cell.contains("e") | cell.contains("E"))
            & cell.rlike(NUMBER_PATTERN),
            DOUBLE,
        )
        .otherwise(TEXT)
    )
    return (
        F.when(cell.isNull(), 0)
        .when(start.isin(*_NUMERIC_START), numeric)
        .when(
            start.isin(*_BOOLEAN_START) & (size <= 5),
            F.when(cell.rlike(BOOLEAN_PATTERN), BOOLEAN).otherwise(TEXT),
        )
        .otherwise(TEXT)
    )


def type_of_mask(mask: int) -> T.DataType:
    """The narrowest type that holds every kind of cell seen in a column."""
    if mask == BOOLEAN:
        return T.BooleanType()
    if mask == LONG:
        return T.LongType()
    if mask and not mask & ~(LONG | DOUBLE):
        return T.DoubleType()
    if mask == DATE:
        return T.DateType()
    if mask and not mask & ~(DATE | TIMESTAMP):
        return T.TimestampNTZType()
    return T.StringType()


def parse_cell(cell: Column, data_type: T.DataType) -> Column:
    """The cell as ``data_type``, or null when it does not hold such a value."""
    if isinstance(data_type, T.StringType):
        return cell
    if isinstance(data_type, T.BooleanType):
        return F.when(cell.rlike(BOOLEAN_PATTERN), F.lower(cell) == "true")
    if isinstance(data_type, T.IntegralType):
        return F.when(cell.rlike(INTEGER_PATTERN), cell.try_cast(data_type))
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return F.when(cell.rlike(NUMBER_PATTERN), cell.try_cast(data_type))
    if isinstance(data_type, T.DateType):
        return F.when(cell.rlike(DATE_PATTERN), _as_date(cell))
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType)):
        return F.when(
            cell.rlike(TIMESTAMP_PATTERN), cell.try_cast(data_type)
        ).when(cell.rlike(DATE_PATTERN), _as_date(cell).try_cast(data_type))
    raise ValueError(f"a CSV cell cannot be read as {data_type.simpleString()}")


def loses_digits(cell: Column, scale: int) -> Column:
    """Whether a number in text has digits other than zero beyond ``scale`` decimal places, so
    that a decimal of that scale rounds it. Null for a null cell."""
    whole, part, power = (F.regexp_extract(cell, _NUMBER_PARTS, i) for i in (1, 2, 3))
    digits = F.concat(whole, part)
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    exponent = F.coalesce(power.try_cast("int"), F.lit(0))
    places = F.length(part) - zeros - exponent
    return digits.rlike("[1-9]") & (places > scale)


def zoneless_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    whole = F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    seconds = F.extract(F.lit("SECOND"), ts) * 1_000_000
    return whole + clock.cast("bigint") * 1_000_000 + seconds.cast("bigint")


def as_text(cell: Column, data_type: T.DataType) -> Column:
    """A value as the text a CSV cell would hold."""
    if isinstance(data_type, T.BinaryType):
        return F.base64(cell)
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(cell)
    return cell.cast("string")
