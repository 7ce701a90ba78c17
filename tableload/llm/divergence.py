"""How far the sources of a language differ in their words: exact divergences by cube cells.

Term counts are grouped once. Then each task owns cells (group block, group block, term block):
it has the shares of the terms of one block in the sources of two blocks, adds up the absolute
differences of every pair of these sources, and the partial sums are reduced along the term
blocks. A cell's size is bounded by the block sizes, so no source, however large, is one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tidied

#: Letters of the alphabet and all that is not ASCII, in UTF-8 bytes.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
SMOOTHING = 5
LEAST_DOCS = 30
TOP_TERMS = 50
GROUP_BLOCK = 64  # sources in a block
TERM_BLOCK = 1024  # terms in a block, on average
_HELD = 1 << 18  # counts held by a task before it hands them on

_COUNTS = pa.schema(
    [
        ("lang", pa.string()),
        ("source", pa.string()),
        ("term", pa.string()),
        ("n", pa.int64()),
        ("docs", pa.int64()),
    ]
)


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, term): occurrences and documents, added up within the task."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flush():
        rows: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in counts.items():
            for column, values in zip(
                rows, ([lang] * len(n), [source] * len(n), n, n.values(), map(docs.get, n))
            ):
                column.extend(values)
        counts.clear()
        types = [pa.binary() if t == pa.string() else t for t in _COUNTS.types]
        made = [pa.array(v, t).cast(f.type) for v, t, f in zip(rows, types, _COUNTS)]
        whole = pa.RecordBatch.from_arrays(made, schema=_COUNTS)
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)

    for batch in batches:
        columns = [batch.column(c).cast(pa.binary()) for c in ("lang", "source", "text")]
        for lang, source, text in zip(*columns):
            group = lang.as_py(), source.as_py()
            n, docs = counts.setdefault(group, (Counter(), Counter()))
            held -= len(n)
            found = Counter()
            whole = text.as_py().lower()  # bytes: A-Z only
            for piece in pieces(whole):
                found.update(TERM.findall(piece))
            n.update(found)
            docs.update(found.keys())
            held += len(n)
            if held > _HELD:
                yield from flush()
                held = 0
    if counts:
        yield from flush()


def pieces(text: bytes, most: int = 1 << 22) -> Iterator[bytes]:
    """The text cut where a byte stands that is part of no term, so that the list of a very long
    text's terms is never held whole."""
    start = 0
    while len(text) - start > most:
        found = _GAP.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, source, term, n, lang_n, once) of the terms that at least ``least_docs``
    documents of the language hold: occurrences in the source and in the language, and 1 in one
    of each term's rows, 0 in the others.

    Tasks add up their own documents first. One shuffle by (lang, term) then serves the sum per
    source, the document count and the language's sum.
    """
    texts = docs.select(_filled("lang"), _filled("source"), _filled("text"))
    schema = "lang string, source string, term string, n long, docs long"
    rows = texts.mapInArrow(tidied(_counted), schema)
    rows = rows.repartition("lang", "term").groupBy("lang", "source", "term")
    summed = rows.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    alike = Window.partitionBy("lang", "term")
    return (
        summed.withColumn("lang_docs", F.sum("docs").over(alike))
        .withColumn("lang_n", F.sum("n").over(alike))
        .withColumn("once", (F.col("source") == F.min("source").over(alike)).cast("long"))
        .where(F.col("lang_docs") >= least_docs)
        .select("lang", "source", "term", "n", "lang_n", "once")
    )


def _groups(docs: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """One row per (lang, source) that occurs: its number ``g`` in the language, its total, the
    language's kept terms and total, and the share of a term that it lacks."""
    sums = F.sum("n").alias("total"), F.sum("once").alias("terms")
    totals = counts.groupBy("lang", "source").agg(*sums)
    langs = totals.groupBy("lang").agg(
        F.sum("terms").alias("terms"), F.sum("total").alias("lang_total")
    )
    totals = totals.drop("terms")
    place = Window.partitionBy("lang").orderBy("source")
    return (
        docs.select(_filled("lang"), _filled("source"))
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["total", "terms", "lang_total"])
        .withColumn("g", F.row_number().over(place) - 1)
        .withColumn("blocks", F.expr(f"1 + (count(*) over (partition by lang) - 1) div {block}"))
        .withColumn("lacking", F.expr(_share_sql("0", "total")))
    )


def _share_sql(n: str, total: str) -> str:
    """The share of a term with ``n`` occurrences among ``total``: 1 + floor(SCALE *
    (n + SMOOTHING) / (total + SMOOTHING * terms)) in decimals, so that no product overflows;
    null in a language without terms."""
    return (
        f"1 + (cast({n} + {SMOOTHING} as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div "
        f"cast(nullif({total} + {SMOOTHING} * terms, 0) as decimal(20,0))"
    )


def _cells(block: Column, blocks: Column) -> Column:
    """The pairs of group blocks (low, high) that a block's sources are copied to."""
    return F.transform(
        F.sequence(F.lit(0).cast("long"), blocks - 1),
        lambda b: F.struct(F.least(b, block).alias("low"), F.greatest(b, block).alias("high")),
    )


_PARTIAL = "lang string, g long, h long, part long"
_PARTIAL_ARROW = pa.schema(
    [("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("part", pa.int64())]
)


def _cell_sums(key: tuple, cell: pa.Table) -> pa.Table:
    """One cell: for each pair of its sources, the sum over its terms of the absolute difference
    of shares, less what the pair would differ by if both lacked every term. Rows without a term
    name the cell's sources; in the first term block they also hold that constant part whole."""
    lang, low, high, tb = (k.as_py() for k in key)
    marks = cell.filter(pa.compute.is_null(cell["term"]))
    rows = cell.filter(pa.compute.is_valid(cell["term"]))
    order = np.argsort(marks["g"].to_numpy())
    groups, base = marks["g"].to_numpy()[order], marks["p"].to_numpy()[order]
    blocks = marks["block"].to_numpy()[order]
    terms = marks["terms"].to_numpy()[0] if marks.num_rows else 0
    names, column = np.unique(rows["term"].to_numpy(), return_inverse=True)
    shares = np.repeat(base[:, None], len(names), axis=1)
    shares[np.searchsorted(groups, rows["g"].to_numpy()), column] = rows["p"].to_numpy()
    above = np.flatnonzero(blocks == high)
    out: list[list[np.ndarray]] = [[], [], []]
    for i in np.flatnonzero(blocks == low):
        others = above[above > i] if low == high else above
        lacking = np.abs(base[others] - base[i])
        sums = np.abs(shares[others] - shares[i]).sum(axis=1) - lacking * len(names)
        if tb == 0:
            sums = sums + lacking * terms
        for held, values in zip(out, (np.full(len(others), groups[i]), groups[others], sums)):
            held.append(values)
    made = [np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for v in out]
    return pa.Table.from_arrays(
        [pa.array([lang] * len(made[0]), pa.string()), *map(pa.array, made)], schema=_PARTIAL_ARROW
    )


def source_divergence(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
    group_block: int = GROUP_BLOCK,
    term_block: int = TERM_BLOCK,
) -> DataFrame:
    """How the sources of each language differ: lang, source, part, item, value, rank.

    Part ``pair``: for each other source of the language the sum of |p - q| over all kept terms,
    all ranks. Part ``term``: the kept terms that the source holds with a greater share than its
    language has, by that difference, the first ``top_terms``. Ranks start at 1, by value
    descending and item ascending in UTF-8. Shares are whole numbers of billionths, smoothed
    (see ``_share_sql``); all arithmetic is exact.

    Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased; kept are
    those in at least ``least_docs`` documents of the language. Null text, lang and source are
    read as empty. Sources without terms take part, with every share that of a term they lack;
    in a language without kept terms every pair has value 0. Repeated rows count each time,
    document ids play no part, further columns are left out, an empty table gives no rows.

    A source is copied to as many cells as its language has blocks of ``group_block`` sources:
    to one for up to 64 sources. The pairs of the result grow with the square of the sources.
    """
    counts = staged(term_counts(docs, least_docs), "terms")
    groups = staged(_groups(docs, counts, group_block), "groups")
    term_blocks = F.expr(f"greatest(1L, (terms + {term_block} - 1) div {term_block})")
    groups = groups.withColumns(
        {"block": F.expr(f"g div {group_block}"), "term_blocks": term_blocks}
    )
    shares = counts.join(groups, ["lang", "source"]).withColumns(
        {"p": F.expr(_share_sql("n", "total")), "q": F.expr(_share_sql("lang_n", "lang_total"))}
    )

    cells = F.explode(_cells(F.col("block"), F.col("blocks"))).alias("cell")
    place = F.pmod(F.xxhash64("term"), F.col("term_blocks"))
    within = Window.partitionBy("lang", "tb").orderBy("term")
    held = shares.withColumn("tb", place).withColumn(
        "number", F.dense_rank().over(within).cast("long")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))
    marks = groups.select("*", every.alias("tb")).withColumns(
        {"p": F.coalesce("lacking", F.lit(0)), "number": F.lit(None).cast("long")}
    )
    columns = ["lang", "tb", "g", "block", F.col("number").alias("term"), "p", "terms", cells]
    cube = held.select(columns).unionByName(marks.select(columns))
    cube = cube.withColumns(
        {"low": F.col("cell.low"), "high": F.col("cell.high"), "g": F.col("g").cast("long")}
    ).drop("cell")
    sums = cube.groupBy("lang", "low", "high", "tb").applyInArrow(_cell_sums, _PARTIAL)
    pairs = sums.groupBy("lang", "g", "h").agg(F.sum("part").alias("value"))

    names = groups.select("lang", F.col("g").alias("number"), "source")
    both = F.explode(
        F.array(
            F.struct(F.col("g").alias("number"), F.col("h").alias("other")),
            F.struct(F.col("h").alias("number"), F.col("g").alias("other")),
        )
    )
    pairs = pairs.select("lang", "value", both.alias("pair")).select("lang", "value", "pair.*")
    pairs = (
        pairs.join(names, ["lang", "number"])
        .drop("number")
        .withColumnRenamed("other", "number")
        .join(names.withColumnRenamed("source", "item"), ["lang", "number"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    terms = shares.where("n > 0 and p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("p") - F.col("q")).alias("value"),
    )
    ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranks))
    terms = terms.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
