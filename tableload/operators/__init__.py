"""Operators over DataFrames: columns, schemas, profiles, advice, layout and history."""
