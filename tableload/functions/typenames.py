"""Logical type labels, SQL type names and declared type names for Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# --- Fixed values: declared type names (JSON schemas use either spelling) ---
DECLARED_TYPES = {
    "Boolean": T.BooleanType(),
    "Integer": T.IntegerType(),
    "Long": T.LongType(),
    "Float": T.FloatType(),
    "Double": T.DoubleType(),
    "Date": T.DateType(),
    "Timestamp": T.TimestampNTZType(),
    "String": T.StringType(),
    "Decimal": T.DecimalType(38, 10),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "string": T.StringType(),
}
_DECIMAL = re.compile(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)\Z", re.IGNORECASE)


def logical_type(data_type: T.DataType) -> T.DataType:
    """The type a loaded column takes: nested, binary and exotic types become text."""
    if isinstance(data_type, (T.ByteType, T.ShortType)):
        return T.IntegerType()
    if isinstance(data_type, T.TimestampType):
        return T.TimestampNTZType()
    kept = (
        T.BooleanType,
        T.IntegerType,
        T.LongType,
        T.FloatType,
        T.DoubleType,
        T.DateType,
        T.TimestampNTZType,
        T.DecimalType,
    )
    return data_type if isinstance(data_type, kept) else T.StringType()


# --- Fixed values: label and SQL name per logical type ---
_LABELS = {
    T.BooleanType: ("boolean", "BOOLEAN"),
    T.IntegerType: ("integer", "INTEGER"),
    T.LongType: ("long", "BIGINT"),
    T.FloatType: ("float", "REAL"),
    T.DoubleType: ("double", "DOUBLE"),
    T.DateType: ("date", "DATE"),
    T.TimestampNTZType: ("timestamp", "TIMESTAMP(3)"),
    T.StringType: ("string", "VARCHAR"),
}


def type_label(data_type: T.DataType) -> str:
    """Lower-case logical label, e.g. ``long`` or ``decimal(38,10)``."""
    logical = logical_type(data_type)
    if isinstance(logical, T.DecimalType):
        return f"decimal({logical.precision},{logical.scale})"
    return _LABELS[type(logical)][0]


def sql_type(data_type: T.DataType) -> str:
    """SQL type name used for compatibility checks, e.g. ``BIGINT``."""
    logical = logical_type(data_type)
    if isinstance(logical, T.DecimalType):
        return f"DECIMAL({logical.precision}, {logical.scale})"
    return _LABELS[type(logical)][1]


def declared_type(name: str) -> T.DataType:
    """The type a JSON schema names; an unknown name is text."""
    decimal = _DECIMAL.match(name.strip())
    if decimal:
        return T.DecimalType(int(decimal[1]), int(decimal[2]))
    return DECLARED_TYPES.get(name.strip(), T.StringType())


def type_class(data_type: T.DataType) -> str:
    """The advice class: datetime, numeric, string, boolean or other."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "string"
    return "boolean" if isinstance(data_type, T.BooleanType) else "other"
