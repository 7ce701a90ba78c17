"""Reading delimited text."""

from __future__ import annotations

import pytest

from tableload import Dialect, infer_schema, read_text, select_columns, structure_report
from tableload.functions.cells import column, loses_digits
from tableload.functions.fixed import NULL_TOKENS
from tableload.functions.names import clean_name, clean_name_col, clean_names, unique_names
from tableload.functions.samples import first_rows, random_sample
from tableload.operators.columns import name_list, unknown_columns
from tableload.operators.schema import apply_schema
from tableload.sources.structure import field_counts, lines


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_tokens_bare_and_quoted(spark, write_file):
    body = "".join(f'{i},{t}\n{i},"{t}"\n' for i, t in enumerate(NULL_TOKENS))
    kept = ["Null", "NONE", "Na", "n/A", "nul", " NA", "NA "]
    body += "".join(f'9,"{t}"\n' for t in kept)
    df = read_text(spark, write_file("k,v\n" + body))
    got = rows(df)
    assert [v for k, v in got if k != "9"] == [None] * (2 * len(NULL_TOKENS))
    assert [v for k, v in got if k == "9"] == kept


def test_quoting(spark, write_file):
    path = write_file('a,b\n"x ""y"" z","1,2"\n"two\nlines",3\n')
    assert rows(read_text(spark, path, Dialect(multiline=True))) == [
        ('x "y" z', "1,2"),
        ("two\nlines", "3"),
    ]


def test_dialect(spark, write_file):
    path = write_file("a;b\n'x;y';2\n")
    assert rows(read_text(spark, path, Dialect(sep=";", quote="'"))) == [("x;y", "2")]
    tabbed = write_file("a\tb\n\t2\n", "tab.csv")
    assert rows(read_text(spark, tabbed, Dialect(sep="\t"))) == [(None, "2")]


@pytest.mark.parametrize("multiline", [False, True])
def test_carriage_returns_end_lines(spark, tmp_path, multiline):
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'a,b\r\n1,"x"\r\n2,y')
    assert rows(read_text(spark, str(path), Dialect(multiline=multiline))) == [
        ("1", "x"),
        ("2", "y"),
    ]


def test_no_header_names(spark, write_file):
    df = read_text(spark, write_file("1,x\n2,y\n"), Dialect(header=False))
    assert df.columns == ["col_0", "col_1"]
    assert rows(df) == [("1", "x"), ("2", "y")]


def test_ragged_rows_are_cut_or_filled(spark, write_file):
    path = write_file("a,b,c\n1,2\n1,2,3,4\n\n5,6,7\n")
    df = read_text(spark, path, ragged_flag="odd")
    assert rows(df) == [
        ("1", "2", None, True),
        ("1", "2", "3", True),
        ("5", "6", "7", False),
    ]
    assert rows(read_text(spark, path).select("c")) == [(None,), ("3",), ("7",)]


def test_header_names_are_exact(spark, write_file):
    path = write_file("a b,a-b,1x,select,,Größe (cm),v,v\n1,2,3,4,5,6,7,8\n")
    names = ["a b", "a-b", "1x", "select", "unnamed_column", "Größe (cm)", "v", "v_duplicated_0"]
    assert read_text(spark, path).columns == names


def test_byte_order_mark_is_no_part_of_a_name(spark, write_file):
    assert read_text(spark, write_file("﻿a,b\n1,2\n")).columns == ["a", "b"]


def test_empty_input_is_an_error(spark, write_file):
    with pytest.raises(ValueError, match="no lines"):
        read_text(spark, write_file(""))


def test_header_only(spark, write_file):
    df = read_text(spark, write_file("a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0
    assert [f.dataType.simpleString() for f in infer_schema(df)] == ["string", "string"]


NAMES = {
    "": "unnamed_column",
    "  ": "col_",
    "plain": "plain",
    " padded ": "padded",
    "a b": "a_b",
    "1x": "col_1x",
    "_x": "_x",
    "Größe (cm)": "Größe__cm_",
    "select": "col_select",
    "By": "col_By",
    "ordering": "ordering",
    "价格": "价格",
    "½": "col_½",
    "a.b": "a_b",
    "-": "_",
}


def test_clean_name_both_forms(spark):
    assert {n: clean_name(n) for n in NAMES} == NAMES
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert dict(rows(df.select("n", clean_name_col(df.n)))) == NAMES
    assert clean_name(None) == "unnamed_column"


def test_clashing_names_are_an_error():
    with pytest.raises(ValueError, match="'a b', 'a-b'"):
        clean_names(["a b", "c", "a-b"])


def test_unique_names():
    assert unique_names(["v", "V", "v"]) == ["v", "V_duplicated_0", "v_duplicated_1"]
    assert unique_names(["v", "v", "v_duplicated_0"]) == ["v", "v_duplicated_1", "v_duplicated_0"]
    assert unique_names(["", " ", "a "]) == ["unnamed_column", "unnamed_column_duplicated_0", "a"]


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b.c` int, d int")
    assert select_columns(df, include="d, a,zz").columns == ["a", "d"]
    assert select_columns(df, exclude=["b.c"]).columns == ["a", "d"]
    assert select_columns(df, include="a", exclude="a").columns == ["a"]
    assert select_columns(df, include="zz").columns == df.columns
    assert select_columns(df, exclude="a,b.c,d").columns == df.columns
    assert unknown_columns(df.columns, "a, zz", "yy") == ["zz", "yy"]
    assert name_list(" a , ,b") == ["a", "b"]


def test_structure(spark, write_file):
    path = write_file('a,b,c\n1,2,3\n1,2\n\n1,2,3,4\n1,"x\ny",3\n')
    report = structure_report(spark, path).head().asDict()
    assert report == {
        "empty": False,
        "lines": 7,
        "blank_lines": 1,
        "blank_first_line": False,
        "separator_in_first_line": True,
        "first_fields": 3,
        "usual_fields": 2,
        "distinct_counts": 3,
        "odd_lines": 4,
        "multiline_hint": True,
        "valid": True,
    }
    counts = dict(rows(field_counts(lines(spark, path))))
    assert counts == {3: 2, 2: 3, 4: 1}


def test_structure_tie_goes_to_the_first_line(spark, write_file):
    report = structure_report(spark, write_file("a,b,c\n1,2\n")).head()
    assert report["usual_fields"] == 3


@pytest.mark.parametrize(("text", "empty"), [("", True), ("\n1,2\n", False)])
def test_structure_rejects(spark, write_file, text, empty):
    report = structure_report(spark, write_file(text)).head()
    assert not report["valid"] and report["empty"] == empty


def test_samples(spark):
    df = spark.range(10_000)
    assert first_rows(df, 7).count() == 7
    assert first_rows(df, 5000).count() == 5000
    sample = random_sample(df, 2000)
    assert 1600 < sample.count() < 2400
    assert sample.distinct().count() == sample.count()
    assert random_sample(df, 50_000).count() == 10_000
    assert random_sample(df.limit(0), 5).count() == 0


def test_late_misfit_is_null_and_row_kept(spark, write_file):
    body = "".join(f"{i}\n" for i in range(1000)) + "oops\n"
    text = read_text(spark, write_file("n\n" + body))
    sampled = infer_schema(text, sample_rows=20)
    assert sampled["n"].dataType.simpleString() == "bigint"
    typed = apply_schema(text, sampled)
    assert (typed.count(), typed.where("n is null").count()) == (1001, 1)
    assert infer_schema(text)["n"].dataType.simpleString() == "string"


def test_digits_beyond_the_scale(spark):
    texts = {
        "1.25": False, "1.250": False, "1.251": True, "-0.001": True, "100e-2": False, ".5e-1": False,
        "5e-3": True, "1.2345E2": False, "1.2345e+1": True, "0.000": False, "0e-9": False, "12": False,
        "x": False, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", loses_digits(column("t"), 2).alias("lost")).collect()
    assert {r.t: r.lost for r in got} == texts


def test_separators_in_quotes_divide_no_fields(spark, write_file):
    path = write_file('a,b,c\n"1,2",x,"y,""z"",q"\n5" pipe,u,v\n1,2\n"m,n",o,p\n')
    report = structure_report(spark, path).head()
    assert (report.first_fields, report.usual_fields, report.odd_lines) == (3, 3, 1)
    counted = {r.fields: r.lines for r in field_counts(lines(spark, path)).collect()}
    assert counted == {3: 4, 2: 1}
    first = write_file('"a,1",b\n"c,2",d\n', "first.csv")
    assert structure_report(spark, first).head().first_fields == 2
