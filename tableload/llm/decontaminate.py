"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted-shingle similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

WORDS = 5
SIMILARITY = 0.8
RADIUS = 17  # of 64 bits; at similarity 0.8 about 10 bits differ
BLOCKS = 6

_SPACE = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    return F.split(F.btrim(ascii_lower(text), F.lit(_SPACE)), r"[\x20\x09-\x0D]+")


def _shingles(words: str) -> Column:
    """Hashes of every run of ``WORDS`` words, in order; none in a shorter text."""
    w = F.col(words)
    last = F.size(w) - WORDS
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: str) -> Column:
    """64-bit SimHash of an array of hashes: bit b is set if more hashes have it than not."""
    return F.expr(
        "aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(cast("
        f"aggregate({shingles}, 0, (s, h) -> s + 2 * cast(shiftright(h, b) & 1 as int) - 1) > 0"
        " as bigint), b))"
    )


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block of a 64-bit fingerprint."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block(fingerprint: str, first: int, bits: int) -> Column:
    shifted = F.shiftrightunsigned(fingerprint, first)
    return shifted.bitwiseAND(F.lit((1 << bits) - 1))


def _masks(bits: int, flips: int) -> list[int]:
    return [
        sum(1 << b for b in chosen)
        for n in range(flips + 1)
        for chosen in combinations(range(bits), n)
    ]


def _overlap(a: str, b: str) -> Column:
    """Sum over distinct shingles of the lesser count."""
    return F.expr(
        f"aggregate(array_distinct(array_intersect({a}, {b})), 0, (s, h) -> s + least("
        f"size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))"
    )


def contaminated_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """Windows of documents that hold a benchmark item: doc_id, text_hash, item_id, start (word),
    similarity.

    Similarity is the weighted Jaccard similarity of the window's and the item's five-word
    shingles, each weighing as often as it occurs; words are split at ASCII white space with A-Z
    lower-cased. A window has as many words as the item, or is the whole text if that is shorter.

    1. Five-word shingles of all texts meet those of the items by hash. A pair of text and item
       that shares fewer than ``similarity`` times the item's shingles cannot reach it and is
       left out; this loses nothing. The others give the windows, aligned where shingles agree.
    2. Windows and items get 64-bit SimHashes. Each item enters its blocks with every value
       within floor(radius / blocks) flips, so each fingerprint within ``radius`` of a window
       is met in at least one block (pigeonhole); more distant ones are dropped.
    3. The exact similarity decides.

    Items of fewer than five words have no shingle and are not searched; nor do null, empty or
    shorter texts match. Repeated item rows give repeated windows.
    """
    if "text_hash" not in docs.columns:
        docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    items = staged(
        benchmark.select("item_id", _words(F.col("text")).alias("w"))
        .withColumn("item", _shingles("w"))
        .where(F.size("item") > 0)
        .select("item_id", F.size("w").alias("words"), "item"),
        "items",
    )
    known = staged(
        items.select(
            "item_id", "words", F.size("item").alias("item_size"), F.posexplode("item")
        ).withColumnsRenamed({"pos": "item_at", "col": "shingle"}),
        "item-shingles",
    )
    worded = docs.where("text is not null").withColumn("w", _words(F.col("text")))
    hits = (
        worded.select("doc_id", "text_hash", F.posexplode(_shingles("w")))
        .withColumnsRenamed({"pos": "at", "col": "shingle"})
        .join(known, "shingle")
    )
    key = ["doc_id", "text_hash"]
    wanted = (
        hits.groupBy(*key, "item_id", "words", "item_size")
        .agg(
            F.count("*").alias("shared"),
            F.collect_set(F.greatest(F.lit(0), F.col("at") - F.col("item_at"))).alias("starts"),
        )
        .where(F.col("shared") >= F.col("item_size") * similarity)
        .groupBy(*key, "words")
        .agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
        .groupBy(*key)
        .agg(F.collect_list(F.struct("words", "starts")).alias("wanted"))
    )
    wanted = staged(wanted, "windows").withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    same = worded.doc_id.eqNullSafe(wanted.d) & (worded.text_hash == wanted.h)
    windows = (
        worded.join(wanted, same)
        .dropDuplicates(key)
        .withColumn("all", _shingles("w"))
        .select(*key, "all", F.explode("wanted").alias("x"))
        .select(*key, "all", "x.words", F.explode("x.starts").alias("start"))
        .withColumn("span", F.col("words") - (WORDS - 1))
        .withColumn(
            "start",
            F.greatest(F.lit(0), F.least("start", F.size("all") - F.col("span"))),
        )
        .withColumn("window", F.expr("slice(all, start + 1, span)"))
        .select(*key, "words", "start", "window")
        .distinct()
        .withColumn("fingerprint", simhash("window"))
    )
    windows = staged(windows, "fingerprints")
    items = items.withColumn("item_fingerprint", simhash("item"))
    flips = radius // blocks
    cut = _blocks(blocks)
    listed = None
    for i, (first, bits) in enumerate(cut):
        masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(bits, flips)])
        part = items.select(
            "*", F.lit(i).alias("block"), F.explode(masks).alias("mask")
        ).withColumn("value", _block("item_fingerprint", first, bits).bitwiseXOR(F.col("mask")))
        listed = part if listed is None else listed.unionByName(part)
    listed = listed.select("words", "block", "value", "item_id", "item_fingerprint", "item")
    looked = windows.withColumn(
        "b",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("block"), _block("fingerprint", *c).alias("value"))
                    for i, c in enumerate(cut)
                ]
            )
        ),
    ).select(*key, "words", "start", "window", "fingerprint", "b.block", "b.value")
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius
    met = (
        looked.join(listed, ["words", "block", "value"])
        .where(near)
        .select(*key, "item_id", "start", "window", "item")
        .distinct()
    )
    least = _overlap("window", "item")
    scored = met.withColumn("least", least).withColumn(
        "similarity",
        F.col("least") / (F.size("window") + F.size("item") - F.col("least")),
    )
    return scored.where(F.col("similarity") >= similarity).select(
        *key, "item_id", "start", "similarity"
    )


def _found(docs: DataFrame, benchmark: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_text_hash``, and one row per contaminated (id, hash)."""
    kept = docs.withColumn("_text_hash", F.xxhash64("text"))
    narrow = kept.select("doc_id", "text", F.col("_text_hash").alias("text_hash"))
    windows = contaminated_windows(narrow, benchmark, **options)
    found = windows.groupBy(
        F.col("doc_id").alias("_found_id"), F.col("text_hash").alias("_found_hash")
    ).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max("similarity").alias("similarity"),
    )
    return kept, staged(found, "contaminated")


_SAME = "doc_id <=> _found_id and _text_hash = _found_hash"


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` with contaminated, item_ids (sorted) and similarity (the highest;
    null if clean). Rows are matched by doc_id (null equals null) and text, so repeated ids keep
    their own verdicts. Columns of docs with these names are replaced."""
    kept, found = _found(docs.drop("contaminated", "item_ids", "similarity"), benchmark, options)
    kind = dict(found.dtypes)["item_ids"]
    return (
        kept.join(found, F.expr(_SAME), "left")
        .withColumn("contaminated", F.col("_found_hash").isNotNull())
        .withColumn("item_ids", F.coalesce("item_ids", F.array().cast(kind)))
        .drop("_found_id", "_found_hash", "_text_hash")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with their columns."""
    kept, found = _found(docs, benchmark, options)
    return kept.join(found, F.expr(_SAME), "left_anti").select(docs.columns)
