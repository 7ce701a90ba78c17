"""What the operators share: staged tables, word splitting, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# Words are what stands between these: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet below the shared folder and read again.

    It cuts lineage, so a lost executor costs the tasks it ran and not the whole history, and
    it gives the planner a size to choose joins by.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter kept."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def text_batches(
    batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of about ``most`` bytes of text, so that what a task derives
    from one run stays small. A single longer text is a run of its own."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def tidied(function: Callable) -> Callable:
    """A function for mapInArrow or the like that gives the memory of what it held back to the
    system when a task is done. Python processes serve one task after another and wait in
    between; what their allocators keep would add up beside the executor's heap."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own counsel


def by_rows(function: Callable, columns: list[str], schema: pa.Schema) -> Callable:
    """A function for mapInArrow: ``function`` takes a list of texts (the last of ``columns``,
    null as the empty text) and returns one list per further output column. The other columns
    pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, columns[-1]):
            texts = [t or "" for t in batch.column(columns[-1]).to_pylist()]
            kept = [batch.column(c) for c in columns[:-1]]
            made = [
                pa.array(v, schema.field(len(kept) + i).type)
                for i, v in enumerate(function(texts))
            ]
            yield pa.RecordBatch.from_arrays(kept + made, schema=schema)

    return run


def id_filter(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be among ``ids`` (one column of that name), so that a join
    with them shuffles little else. All that are among them stay, and of the others the share of
    bits set: ids are hashed to 2**24 bits, held in 2**18 words, so what is broadcast is bounded
    whatever the number of ids."""
    number = F.pmod(F.xxhash64(column), F.lit(1 << 24))
    bit = F.expr("shiftleft(1L, cast(_number % 64 as int))")
    word = F.expr("_number div 64")
    bits = (
        ids.withColumn("_number", number)
        .groupBy(word.alias("_word"))
        .agg(F.bit_or(bit).alias("_bits"))
    )
    marked = rows.withColumn("_number", number).withColumn("_word", word)
    met = marked.join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return met.drop("_word", "_bits", "_number")


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b).

    Returns one row (node, root) for each node that has a link to another node; ``root`` is the
    smallest node of its component. Alternates large-star and small-star steps (Kiveris et al.,
    2014) until the links no longer change: O(log n) rounds, each two joins on node ids with
    partial aggregation first. Every round is staged in the shared folder, in as many files as
    its rows need.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = staged(edges.distinct(), "links")
    before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).head()
    while before[0]:
        files = 1 + before[0] // 200_000
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m")
        large = staged(
            large.select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(files),
            "large-star",
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").union(low.select("a", F.col("m").alias("b")))
        edges = staged(small.distinct().coalesce(files), "small-star")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).head()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())
