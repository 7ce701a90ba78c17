"""Read delimited text as all-string columns; typing happens later, in one place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import column, null_tokens
from ..functions.fixed import NULL_TOKENS
from ..functions.names import unique_names
from .records import any_open, joined_records, opens_cell, record_cells, text_lines

# Only these inputs are picked up from a directory.
INPUT_GLOB = "*.{[cC][sS][vV],[tT][xX][tT]}"

# Encodings whose line ends are the byte 10, and which Spark decodes.
_BYTE_ENCODINGS = ("UTF-8", "UTF8", "US-ASCII", "ISO-8859-1")


@dataclass(frozen=True)
class Dialect:
    """How the text is delimited.

    Quoted cells may hold newlines: one scan of the lines looks for cells left open at a line's
    end, and only input that has some is put together to records (``records``), over as many
    tasks as it has blocks. ``quoted_newlines=False`` saves that scan where no cell holds a
    newline. ``multiline`` leaves the records to Spark's own parser, one task per file; encodings
    other than UTF-8, ASCII and Latin-1 need it for such cells."""

    sep: str = ","
    quote: str = '"'
    header: bool = True
    multiline: bool = False
    encoding: str = "UTF-8"
    quoted_newlines: bool = True

    def options(self) -> dict[str, str]:
        return {
            "sep": self.sep,
            "quote": self.quote,
            "escape": self.quote or "\\",
            "multiLine": str(self.multiline).lower(),
            "encoding": self.encoding,
            "mode": "PERMISSIVE",
        }

    @property
    def joins_lines(self) -> bool:
        """Whether lines are looked at for quoted cells that run on."""
        known = self.encoding.upper() in _BYTE_ENCODINGS
        return bool(self.quote) and self.quoted_newlines and not self.multiline and known


def header_names(
    spark: SparkSession,
    path: str | list[str],
    dialect: Dialect = Dialect(),
    *,
    path_glob: str | None = None,
) -> tuple[list[str], bool]:
    """Exact header names (read as data, so Spark renames nothing), or ``col_0`` onwards; and
    whether they are the header's cells unchanged, so that other files' headers can be compared
    with them."""
    reader = spark.read.options(**dialect.options())
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    first = reader.csv(path).head()
    if first is not None and dialect.joins_lines:
        texts = spark.read.option("lineSep", "\n")
        if path_glob:
            texts = texts.option("pathGlobFilter", path_glob)
        line = texts.text(path).where("trim(value) <> ''").head()
        if line and opens_cell(line["value"], dialect.sep, dialect.quote):
            first = reader.option("multiLine", "true").csv(path).head()
    if first is None:
        raise ValueError(f"no lines in {path}")
    if not dialect.header:
        return [f"col_{i}" for i in range(len(first))], False
    names = unique_names([(cell or "").removeprefix("\ufeff") for cell in first])
    return names, names == list(first)


def column_names(
    spark: SparkSession,
    path: str | list[str],
    dialect: Dialect = Dialect(),
    *,
    path_glob: str | None = None,
) -> list[str]:
    """The names of ``header_names``."""
    return header_names(spark, path, dialect, path_glob=path_glob)[0]


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def clear_null_tokens(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Every text column with its null tokens made null; other columns unchanged."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        [
            null_tokens(column(n), tokens).alias(n) if n in text else column(n)
            for n in df.columns
        ]
    )


def read_text(
    spark: SparkSession,
    path: str | list[str],
    dialect: Dialect = Dialect(),
    *,
    names: list[str] | None = None,
    tokens: tuple[str, ...] = NULL_TOKENS,
    path_glob: str | None = None,
    ragged_flag: str | None = None,
    check_header: bool = False,
) -> DataFrame:
    """All columns as text, null tokens cleared.

    ``names`` replaces the header's (or generated) names and saves the look at the first line.
    Without ``names``, every file must have the header of the first one, and with
    ``check_header`` that of ``names``: a file with other names or another order fails the read,
    which names it, instead of filling the wrong columns. (Headers with empty or repeated names or spaces around them are not compared.)

    Rows with too many fields lose the extra ones, short rows end in nulls. ``ragged_flag``
    names a boolean column that marks both; it costs the parser its column pruning. Quoted cells
    with newlines stay whole. Where the dialect does not look for them, a marked row with an odd
    number of quotes fails the read: a quoted cell runs over the end of its line.
    """
    checked = check_header
    if names is None:
        names, checked = header_names(spark, path, dialect, path_glob=path_glob)
    raw = "__raw_line"
    if dialect.joins_lines:
        lines = text_lines(
            spark, path, dialect.sep, dialect.quote, encoding=dialect.encoding, path_glob=path_glob
        )
        if any_open(lines):
            records = joined_records(lines, header=dialect.header)
            cells = record_cells(records, names, dialect.options(), checked=checked, raw=raw)
            if not ragged_flag:
                return clear_null_tokens(cells.drop(raw), tokens)
            values = [null_tokens(column(n), tokens).alias(n) for n in names]
            return cells.select(*values, F.col(raw).isNotNull().alias(ragged_flag))
    schema = text_schema(names)
    reader = spark.read.options(**dialect.options()).option(
        "header", str(dialect.header).lower()
    )
    if checked:
        reader = reader.option("enforceSchema", "false")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if not ragged_flag:
        return clear_null_tokens(reader.schema(schema).csv(path), tokens)
    marked = (
        reader.option("columnNameOfCorruptRecord", raw).schema(schema.add(raw, "string")).csv(path)
    )
    cells: list[Column] = [null_tokens(column(n), tokens).alias(n) for n in names]
    ragged = F.col(raw).isNotNull()
    if dialect.quote and not dialect.multiline and not dialect.joins_lines:
        quotes = F.length(raw) - F.length(F.replace(F.col(raw), F.lit(dialect.quote), F.lit("")))
        message = F.lit("a quoted cell runs over the end of its line: set multiline=True")
        ragged = F.when(quotes % 2 == 1, F.raise_error(message).cast("boolean")).otherwise(ragged)
    return marked.select(*cells, ragged.alias(ragged_flag))


def input_bytes(
    spark: SparkSession, path: str | list[str], *, path_glob: str | None = None
) -> int:
    """Size of all input files, from their listing; no file is opened."""
    reader = spark.read.format("binaryFile")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    return reader.load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
