"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
_RANGE_HEX = 3  # ranges of the random key: its first 12 bits


def _key(id_column: str) -> Column:
    """A hash-random key of id and text."""
    number = F.coalesce(F.col(id_column).cast("string"), F.lit("-"))
    return F.md5(F.concat_ws(":", number, F.coalesce("text", F.lit(""))))


def sized(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, source, size in words (null text: 0) and a hash-random key of id and text.

    Rows equal in id and text share a key; they are interchangeable.
    """
    return docs.select(
        F.col(id_column).alias("doc_id"),
        "source",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
        _key(id_column).alias("key"),
    ).select("doc_id", "source", F.coalesce("words", F.lit(0)).alias("size"), "key")


def targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """Per source (source, source_size): its target.

    Sources in code-point order, null last, take the weights in turn and share ``share_percent``
    of all sizes. No target exceeds ``most_epochs`` times its source; the excess goes to the
    others by weight until none is above. That fixed point is lambda * weight, capped: sources
    are sorted by cap per weight, and lambda is what the budget leaves after the first k caps,
    over the weights that remain, for the first k at which the next source is not above its cap.
    One row per source, so the windows over all sources stay small.
    """
    if share_percent > 100 * most_epochs:
        raise ValueError("the share exceeds what the most epochs can give")
    place = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(place) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * most_epochs
    )
    steep = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = steep.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "caps_before": F.coalesce(F.sum("cap").over(earlier), F.lit(0)),
            "weights_before": F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
            "all": F.sum("source_size").over(everything),
            "weights": F.sum("weight").over(everything),
        }
    )
    budget = F.col("all") * share_percent - F.col("caps_before") * 100
    level = budget.cast("double") / ((F.col("weights") - F.col("weights_before")) * 100)
    ranked = ranked.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    ranked = ranked.withColumn(
        "line", F.min(F.when(fits, F.struct("weights_before", "level"))).over(everything)
    )
    above = F.col("line").isNull() | (F.col("weights_before") < F.col("line.weights_before"))
    target = F.when(above, F.col("cap").cast("double")).otherwise(
        F.least(F.col("line.level") * F.col("weight"), F.col("cap").cast("double"))
    )
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_epochs: int = MOST_EPOCHS,
    id_column: str = "doc_id",
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, key, size, source_size, target and ``taken``, the
    words the mix takes, repeats counted.

    A source is read whole as often as its target allows; then, in the order of the random key,
    documents are taken until the budget is used up, and the last one gives only the words that
    remain, so a source's taken words are its target rounded down. Rerunning agrees, since the
    key depends on id and text only. Null texts and empty tables take nothing; a null source is
    a source; rows tied in every respect are interchangeable.

    Prefix sums are distributed: the key's first bits cut each source into 4096 ranges; range
    sums (one small row each) give every range the words before it, and only the one range a
    cut falls into is sorted. A range holds 1/4096 of its source, however hot the source.
    """
    rows, cut = _cut(docs, weights, share_percent, most_epochs, id_column)
    judged = rows.join(cut, rows.source.eqNullSafe(cut.cut_source))
    base = F.col("size") * F.col("epochs")
    out = ["doc_id", "source", "key", "size", "source_size", "target"]
    plain = judged.where(F.col("part") != F.col("cut.part")).select(
        *out,
        (base + F.when(F.col("part") < F.col("cut.part"), F.col("size")).otherwise(0)).alias(
            "taken"
        ),
    )
    return plain.unionByName(_edge(judged).select(*out, (base + F.col("extra")).alias("taken")))


def _cut(
    docs: DataFrame,
    weights: Sequence[int],
    share_percent: int,
    most_epochs: int,
    id_column: str,
) -> tuple[DataFrame, DataFrame]:
    """The sized rows with the range (``part``) of their key, and one row per source: its whole
    ``epochs``, the words ``rest`` left after them, and ``cut``, the range in which these end with
    the words before it."""
    rows = staged(sized(docs, id_column), "sized").withColumn(
        "part", F.substring("key", 1, _RANGE_HEX)
    )
    parts = staged(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts")
    per_source = targets(
        parts.groupBy("source").agg(F.sum("part_size").alias("source_size")),
        weights,
        share_percent,
        most_epochs,
    )
    per_source = (
        per_source.withColumn("whole", F.floor("target").cast("long"))
        .withColumn("epochs", F.expr("whole div greatest(source_size, 1)"))
        .withColumn("rest", F.expr("whole - epochs * source_size"))
    )
    before = Window.partitionBy("source").orderBy("part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    bounds = parts.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    cut = (
        per_source.join(bounds, per_source.source.eqNullSafe(bounds.source))
        .where("before <= rest")
        .groupBy(per_source.source.alias("cut_source"), "source_size", "target", "epochs", "rest")
        .agg(F.max(F.struct("part", "before")).alias("cut"))
    )
    return rows, staged(cut, "cut")


def _edge(judged: DataFrame) -> DataFrame:
    """The rows of the ranges in which a source's budget ends, with the words (``extra``) that
    what is left gives to each in the order of the key."""
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    order = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = judged.where(F.col("part") == F.col("cut.part"))
    sofar = F.col("cut.before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("sofar")))
    return inside.withColumn("sofar", sofar).withColumn("extra", extra)


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns.

    Texts stay whole: a document that a budget cuts through is taken if the cut leaves half of
    it or more, so a source's words are its target give or take half a document, however often
    a row is repeated. Documents without words weigh nothing and stay once. An empty table gives
    no rows.

    No text is shuffled but in the one range of 4096 per source that a budget ends in: elsewhere
    the key alone tells how often a row is taken. There the copies of equal rows are numbered,
    and each number has its own answer.
    """
    rows, cut = _cut(docs, weights, share_percent, most_epochs, "doc_id")
    judged = rows.join(cut, rows.source.eqNullSafe(cut.cut_source))
    copies = Window.partitionBy("source", "key")
    numbered = copies.orderBy(F.col("extra").desc())
    answers = (
        _edge(judged)
        .withColumn("_copy", F.row_number().over(numbered))
        .select(
            F.col("source").alias("_source"),
            F.col("key").alias("_key"),
            "_copy",
            (F.col("extra") * 2 >= F.col("size")).cast("int").alias("_last"),
        )
    )
    key, words = _key("doc_id"), F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = [F.col(f"_d.`{c.replace('`', '``')}`").alias(c) for c in docs.columns]
    whole = docs.select(
        F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("_d"),
        F.col("source").alias("_s"),
        key.alias("_k"),
        F.substring(key, 1, _RANGE_HEX).alias("_part"),
        words.alias("_words"),
    ).join(
        cut.select("cut_source", "epochs", F.col("cut.part").alias("_end")),
        F.col("_s").eqNullSafe(F.col("cut_source")),
    )

    def taken(rows: DataFrame, last) -> DataFrame:
        times = F.when(~F.col("_words"), 1).otherwise((F.col("epochs") + last).cast("int"))
        rows = rows.withColumn("_times", times).where("_times > 0")
        return rows.select("_d", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(kept)

    plain = whole.where(F.col("_part") != F.col("_end"))
    inside = whole.where(F.col("_part") == F.col("_end")).withColumn(
        "_n", F.row_number().over(Window.partitionBy("_s", "_k").orderBy("_k"))
    )
    edge = inside.join(
        answers,
        F.col("_s").eqNullSafe(F.col("_source"))
        & (F.col("_k") == F.col("_key"))
        & (F.col("_n") == F.col("_copy")),
    )
    before = (F.col("_part") < F.col("_end")).cast("int")
    return taken(plain, before).unionByName(taken(edge, F.col("_last")))
