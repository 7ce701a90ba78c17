"""Records of delimited text whose quoted cells run over line ends, put together in parallel.

A line either leaves a quoted cell open or not, and that depends on whether one was open before
it: each line is a function of one bit. The functions of a block's lines make the block's
function; the blocks' functions, taken in order per file, tell every block how it begins. With
that, each task joins the lines of its own blocks to records, and only the pieces of a record
that crosses a block's end meet in a shuffle. Lines with balanced quotes cost one test.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD, PIECE, HEADER = 0, 1, 2

_BLOCK = pa.schema(
    [
        ("file", pa.int64()),
        ("block", pa.int64()),
        ("if_out", pa.bool_()),
        ("if_in", pa.bool_()),
        ("closed", pa.bool_()),
    ]
)
_FOUND = pa.schema(
    [
        ("kind", pa.int32()),
        ("file", pa.int64()),
        ("block", pa.int64()),
        ("opener", pa.int64()),
        ("value", pa.string()),
    ]
)


def _patterns(sep: str, quote: str) -> tuple[str, str]:
    """Regular expressions for lines that end within a quoted cell: if they begin outside one,
    and if they begin inside one.

    A quoted cell begins with a quote right after a separator or at the start; two quotes in it
    stand for one. After its closing quote anything up to the separator belongs to the cell, and
    a quote within an unquoted cell is an ordinary character. All loops are possessive, so a line
    of any length is matched without recursion.
    """
    q, s = re.escape(quote), re.escape(sep)
    inside = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    rest = f"[^{s}]*+" if len(sep) == 1 else f"(?:(?!{s}).)*+"
    cells = f"(?:(?:{q}{inside}{q}{rest}|(?!{q}){rest}){s})*+"
    opens = f"{cells}{q}{inside}\\z"
    return f"(?s)\\A{opens}", f"(?s)\\A{inside}(?:\\z|{q}{rest}{s}{opens})"


def opens_cell(line: str, sep: str, quote: str) -> bool:
    """Whether a line leaves a quoted cell open."""
    return re.search(_patterns(sep, quote)[0].replace(r"\z", r"\Z"), line) is not None


def text_lines(
    spark: SparkSession,
    path: str | list[str],
    sep: str,
    quote: str,
    *,
    encoding: str = "UTF-8",
    path_glob: str | None = None,
) -> DataFrame:
    """One row per line: value, and whether a quoted cell is open behind it if none was open
    before (``if_out``) and if one was (``if_in``). ``file``, ``block`` and ``place`` order the
    lines of each file. Lines end with a newline; a return before it stays."""
    reader = spark.read.option("lineSep", "\n")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    value = F.col("value")
    if encoding.upper().replace("-", "") != "UTF8":
        value = F.decode(value.cast("binary"), encoding)
    opens, stays = _patterns(sep, quote)
    has = value.contains(quote)
    return reader.text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.when(has, value.rlike(opens)).otherwise(False).alias("if_out"),
        F.when(has, value.rlike(stays)).otherwise(True).alias("if_in"),
        value.alias("value"),
    )


def any_open(lines: DataFrame) -> bool:
    """Whether any line of the input leaves a quoted cell open: one scan, of which only lines
    with quotes are looked at closely."""
    return bool(lines.agg(F.bool_or("if_out").alias("open")).head()["open"])


def _block_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: is a cell open behind it if none (one) was open before it, and does it close
    an open one anywhere. A task has each of its blocks whole and in order."""
    blocks: dict[tuple[int, int], list[bool]] = {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "if_out", "if_in")]
        for file, block, if_out, if_in in zip(*columns):
            held = blocks.setdefault((file, block), [False, True, False])
            held[0] = if_in if held[0] else if_out
            held[1] = if_in if held[1] else if_out
            held[2] |= not held[1]
    rows = [(*key, *held) for key, held in blocks.items()]
    columns = list(zip(*rows)) if rows else [[] for _ in _BLOCK]
    made = [pa.array(c, f.type) for c, f in zip(columns, _BLOCK)]
    yield pa.RecordBatch.from_arrays(made, schema=_BLOCK)


def block_starts(lines: DataFrame) -> DataFrame:
    """The blocks that begin within a quoted cell: file, block, and ``opener``, the block in
    which that cell's record begins.

    Lines that change nothing are left out before Python, and no text travels. The blocks' own
    functions are combined per file by running sums: the last block that ends alike whatever it
    began with, and the parity of the blocks that turn the answer since.
    """
    telling = lines.where(F.col("if_out") | ~F.col("if_in"))
    functions = telling.select("file", "block", "if_out", "if_in").mapInArrow(
        _block_functions,
        "file long, block long, if_out boolean, if_in boolean, closed boolean",
    )
    # Blocks without a telling line begin within a cell too; they need their row.
    every = lines.select("file", "block").distinct()
    blocks = every.join(functions, ["file", "block"], "left").fillna(
        {"if_out": False, "if_in": True, "closed": False}
    )
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("if_out") == F.col("if_in")
    turns = (F.col("if_out") & ~F.col("if_in")).cast("int")
    last = F.last(F.when(settled, F.struct("if_out", "turns")), ignorenulls=True).over(before)
    since = F.lag("turns", 1, 0).over(order) - F.coalesce(F.col("last.turns"), F.lit(0))
    begins = F.coalesce(F.col("last.if_out"), F.lit(False)) != (since % 2 == 1)
    opens = F.when(F.col("begins"), F.col("if_in") & F.col("closed")).otherwise(F.col("if_out"))
    opener = F.last(F.when(F.col("opens"), F.col("block")), ignorenulls=True).over(before)
    return (
        blocks.withColumn("turns", F.sum(turns).over(upto))
        .withColumn("last", last)
        .withColumn("begins", begins)
        .withColumn("opens", opens)
        .withColumn("opener", opener)
        .where("begins")
        .select("file", "block", "opener")
    )


class _Joiner:
    """Joins the lines of consecutive blocks to records."""

    def __init__(self, header: bool):
        self._header = header
        self._at: tuple[int, int] | None = None
        self._held: list[str] = []
        self._opener: int | None = None
        self._header_due = False
        self.rows: list[tuple] = []

    def _record(self) -> None:
        value = "\n".join(self._held)
        self._held = []
        if not value.strip():
            return
        kind = HEADER if self._header_due else RECORD
        self._header_due = False
        self.rows.append((kind, *self._at, None, value))

    def begin(self, file: int, block: int, opener: int | None) -> None:
        self.end()
        self._at, self._opener = (file, block), opener
        self._header_due = self._header and block == 0

    def line(self, value: str, is_open: bool) -> None:
        """A line, and whether a cell is open behind it."""
        if self._at[1] == 0 and not self._held and self._header_due:
            value = value.removeprefix("﻿")
        self._held.append(value.removesuffix("\r"))
        if is_open:
            return
        if self._opener is not None:
            self._piece(self._opener)
        else:
            self._record()

    def _piece(self, opener: int) -> None:
        self.rows.append((PIECE, *self._at, opener, "\n".join(self._held)))
        self._held, self._opener = [], None

    def end(self) -> None:
        """The end of a block: what is still open goes on in another."""
        if self._held:
            self._piece(self._at[1] if self._opener is None else self._opener)


def _joined(header: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, at, is_open = _Joiner(header), None, False

        def found() -> pa.RecordBatch:
            columns = list(zip(*joiner.rows)) if joiner.rows else [[] for _ in _FOUND]
            joiner.rows = []
            made = [pa.array(c, f.type) for c, f in zip(columns, _FOUND)]
            return pa.RecordBatch.from_arrays(made, schema=_FOUND)

        names = ("file", "block", "opener", "if_out", "if_in", "value")
        for batch in batches:
            for file, block, opener, if_out, if_in, value in zip(
                *(batch.column(c).to_pylist() for c in names)
            ):
                if at != (file, block):
                    at, is_open = (file, block), opener is not None
                    joiner.begin(file, block, opener)
                is_open = if_in if is_open else if_out
                joiner.line(value, is_open)
            yield found()
        joiner.end()
        yield found()

    return run


def joined_records(lines: DataFrame, *, header: bool) -> DataFrame:
    """One row per record: ``value`` (its lines with newlines between them, whether the file has
    returns before its newlines or not, as ``multiLine`` reads them) and ``kind``, HEADER for the first record of each file if ``header``, else RECORD. Blank records are left
    out. A cell still open at a file's end ends there.

    The text is read twice, once for the blocks and once for the records, and sorted within its
    tasks, so that a join that moved lines does no harm; it is not shuffled unless the blocks
    that begin within a cell are too many to broadcast.
    """
    starts = block_starts(lines)
    ordered = lines.join(starts, ["file", "block"], "left").sortWithinPartitions(
        "file", "block", "place"
    )
    found = ordered.mapInArrow(
        _joined(header), "kind int, file long, block long, opener long, value string"
    )
    whole = found.where(F.col("kind") != PIECE).select("kind", "value")
    pieces = found.where(F.col("kind") == PIECE)
    in_order = F.array_sort(F.collect_list(F.struct("block", "value")))
    text = F.array_join(F.transform(in_order, lambda p: p["value"]), "\n")
    crossing = pieces.groupBy("file", "opener").agg(text.alias("value"))
    crossing = crossing.select(F.lit(RECORD).alias("kind"), "value")
    return whole.unionByName(crossing)


def record_cells(
    records: DataFrame,
    names: list[str],
    options: dict[str, str],
    *,
    checked: bool,
    raw: str,
) -> DataFrame:
    """The records' cells as text under ``names``, and ``raw``, the record if it has too many or
    too few cells. With ``checked`` every header must have these names, or the read fails."""
    schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", raw string"
    given = {**options, "multiLine": "true", "lineSep": "\n", "columnNameOfCorruptRecord": "raw"}
    parsed = records.withColumn("cells", F.from_csv("value", schema, given))
    cells = [F.col(f"cells.c{i}") for i in range(len(names))]
    keep: Column = F.col("kind") == RECORD
    if checked:
        same = F.col("cells.raw").isNull()
        for cell, name in zip(cells, names):
            same &= F.lower(F.coalesce(cell, F.lit(""))) == name.lower()
        message = F.concat(F.lit("a file's header differs from the first one's: "), F.col("value"))
        wrong = (F.col("kind") == HEADER) & ~same
        keep = F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(keep)
    return parsed.where(keep).select(
        *[c.alias(n) for c, n in zip(cells, names)], F.col("cells.raw").alias(raw)
    )
