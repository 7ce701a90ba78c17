"""Arbitrary cells written by Python's csv module and read back."""

from __future__ import annotations

import csv
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tableload import Dialect, infer_schema, read_text
from tableload.functions.fixed import NULL_TOKENS
from tableload.operators.schema import apply_schema

_CHARS = st.sampled_from(list("abcXYZ 0123456789.,;'\"\\|\t_-+/:éß价😀\n"))
_CELL = st.one_of(
    st.text(_CHARS, max_size=12),
    st.lists(st.sampled_from(["NA", "null", " ", "x"]), max_size=3).map("".join),
    st.sampled_from(NULL_TOKENS),
    st.integers(-(10**20), 10**20).map(str),
    st.floats(allow_nan=False, allow_infinity=False).map(str),
    st.datetimes().map(lambda d: d.isoformat(" ")),
)
_ROWS = st.lists(st.tuples(_CELL, _CELL, _CELL), min_size=1, max_size=60)


@pytest.mark.parametrize(("sep", "quote"), [(",", '"'), (";", "'"), ("\t", '"'), ("|", '"')])
@settings(
    max_examples=6,
    deadline=None,
    derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
@given(rows=_ROWS)
def test_cells_survive(spark, tmp_path, sep, quote, rows):
    path = tmp_path / f"{uuid.uuid4().hex}.csv"
    with path.open("w", encoding="utf-8", newline="") as out:
        writer = csv.writer(
            out, delimiter=sep, quotechar=quote, quoting=csv.QUOTE_ALL, lineterminator="\n"
        )
        writer.writerow(["a", "b", "c"])
        writer.writerows(rows)
    text = read_text(spark, str(path), Dialect(sep=sep, quote=quote, multiline=True))
    expected = [tuple(None if c in NULL_TOKENS else c for c in row) for row in rows]
    assert [tuple(r) for r in text.collect()] == expected
    typed = apply_schema(text, infer_schema(text))
    kept = typed.select([typed[c].isNotNull().alias(c) for c in typed.columns]).collect()
    assert [tuple(r) for r in kept] == [tuple(c is not None for c in row) for row in expected]
