"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables,
exact cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged

COSINE = 0.98
SAMPLE = 20_000  # bound of the vectors that the rotation is learnt from
TABLES = 4
MOST_BITS = 64
ROUNDS = 50
BLOCK = 1024  # vectors of a bucket compared at once
_EXACT = ("array<float>", "array<double>")  # what goes into the cosine as it is


def learn_rotation(sample: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation (Gong and Lazebnik, 2011): principal axes of
    the centred unit vectors, turned so that their signs lose as little as possible. As many bits
    as axes, 64 at most."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(MOST_BITS, sample.shape[1])]
    projected = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(axes.shape[1],) * 2))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(projected @ turn).T @ projected)
        turn = (left @ right).T
    return mean, axes @ turn


def codes(units: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes: the signs of the turned axes."""
    bits = (units - mean) @ projection > 0
    weights = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)
    return (bits * weights).sum(1, dtype=np.uint64)


def _units(column: pa.ListArray, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # By a power of two, which is exact, so that no square overflows or vanishes.
    _, power = np.frexp(np.abs(values).max(1, keepdims=True))
    values = np.ldexp(values, np.where(np.abs(power) > 400, -power, 0))
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _field(code: str, table: int, bits: int) -> str:
    width = bits // TABLES
    last = bits - (TABLES - 1) * width if table == TABLES - 1 else width
    return f"(shiftrightunsigned({code}, {table * width}) & {(1 << last) - 1}L)"


def _compare(batches: Iterator[pa.RecordBatch], dim: int, bits: int, cosine: float):
    """Counts, for each member of a bucket, the copies it links with, and names the least class
    it is linked to by links found there. A pair that an earlier table brings together too is
    counted there."""
    width = bits // TABLES
    names = ["label", "t", "home", "i", "j"]
    schema = pa.schema([("cid", pa.int64()), ("add", pa.int64()), ("root", pa.int64())])
    key, held = None, []

    def judged(table: int, parts: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(parts)
        units = _units(whole["embedding"].combine_chunks(), dim)
        guest = whole["guest"].to_numpy()
        block = whole["block"].to_numpy()
        code = whole["code"].to_numpy().view(np.uint64)
        cid, copies = whole["cid"].to_numpy(), whole["copies"].to_numpy()
        near = units @ units.T >= cosine
        near &= ~(guest[:, None] & guest[None, :])
        if key[3] != key[4]:
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        a, b = np.nonzero(near)
        if not len(a):
            return
        other = code[a] ^ code[b]
        first = np.ones(len(a), dtype=bool)
        for earlier in range(table):
            part = (other >> np.uint64(earlier * width)) & np.uint64((1 << width) - 1)
            first &= (part & (part - (part > 0))) != 0
        add = np.bincount(a[first], weights=copies[b[first]], minlength=len(cid))
        root = cid.copy()
        while True:
            least = np.minimum.reduceat(root[b], np.flatnonzero(np.r_[True, a[1:] != a[:-1]]))
            members = np.unique(a)
            new = root.copy()
            new[members] = np.minimum(root[members], least)
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays(
            [pa.array(cid[members]), pa.array(add[members].astype(np.int64)), pa.array(root[members])],
            schema=schema,
        )

    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
        start = 0
        for row in range(1, len(keys) + 1):
            if row < len(keys) and keys[row] == keys[start]:
                continue
            if keys[start] != key and held:
                yield from judged(key[1], held)
                held = []
            key = keys[start]
            held.append(batch.slice(start, row - start))
            start = row
    if held:
        yield from judged(key[1], held)


def link_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id,
    kept.

    Vectors of equal, non-null labels link when their cosine in double precision is at least
    ``cosine``. ``n_links`` counts the other rows linked directly, ``component_id`` is the least
    vec_id that links reach, ``kept`` whether it is the row's own. Vectors that are null, empty or
    zero, that hold null or non-finite components or have a null label link with nothing; those of
    different lengths do not link. Components keep the type they come in. Repeated rows and ids count as vectors of their own; null ids are passed
    over when the least is sought.

    Each length that two vectors or more have is a search of its own, with its own rotation.
    Equal vectors of a label become one class first. A rotation is learnt from a sample of at
    most ``sample`` vectors of least hash. Codes of 64 bits are cut into four tables; two codes
    meet if in some table they differ by one bit at most, so all within Hamming distance 7 do.
    In each bucket ("home") its own members meet each other and guests from buckets with one
    more bit set; full vectors then decide. Every pair is judged once, buckets beyond 1024
    members in blocks; what leaves a task is one row per member, not per pair.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        F.col("embedding").cast(kind if kind in _EXACT else "array<double>").alias("embedding"),
    )
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(
        F.col("label").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("n", F.when(usable, F.size("embedding")).otherwise(0))
    counted = rows.where("n > 0").groupBy("n").agg(F.count("*").alias("rows")).where("rows > 1")
    lengths = sorted(r.n for r in counted.select("n").collect())
    alone = rows.where(~F.col("n").isin(lengths)).select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.col("vec_id").isNotNull().alias("kept"),
    )
    linked = [_linked(rows.where(F.col("n") == n).drop("n"), n, cosine, sample) for n in lengths]
    return reduce(DataFrame.unionByName, linked, alone)


def _linked(rows: DataFrame, dim: int, cosine: float, sample: int) -> DataFrame:
    """``link_vectors`` for usable vectors of one length."""
    spark = rows.sparkSession
    classes = (
        rows.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = staged(classes, "vector-classes")  # the numbers hold from here
    some = classes.orderBy(F.xxhash64("embedding"), "cid").limit(sample).select("embedding")
    taken = some.toArrow()["embedding"].combine_chunks()
    model = learn_rotation(_units(taken, dim))
    bits = model[1].shape[1]
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = codes(_units(batch.column("embedding"), dim), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(code.view(np.int64))], [*batch.schema.names, "code"]
            )

    kinds = dict(classes.dtypes)
    coded = staged(
        classes.select("cid", "label", "copies", "embedding").mapInArrow(
            encode,
            f"cid long, label {kinds['label']}, copies long, embedding {kinds['embedding']}, "
            "code long",
        ),
        "codes",
    )
    fields = F.array(*[F.expr(_field("code", t, bits)) for t in range(TABLES)])
    entries = coded.select("cid", "label", F.posexplode(fields).alias("t", "value"))
    homes = entries.groupBy("label", "t", F.col("value").alias("home")).agg(
        F.count("*").alias("own")
    )
    last = bits - (TABLES - 1) * (bits // TABLES)
    ones = F.filter(
        F.array(*[F.lit(1 << b).cast("long") for b in range(last)]),
        lambda m: F.col("value").bitwiseAND(m) != 0,
    )
    guests = (
        entries.select("cid", "label", "t", "value", F.explode(ones).alias("bit"))
        .select("cid", "label", "t", F.col("value").bitwiseXOR(F.col("bit")).alias("home"))
        .join(homes.drop("own"), ["label", "t", "home"], "left_semi")
    )
    own = entries.withColumnRenamed("value", "home").withColumn("guest", F.lit(False))
    members = staged(own.unionByName(guests.withColumn("guest", F.lit(True))), "members")
    sizes = members.groupBy("label", "t", "home").agg(F.count("*").alias("all"))
    blocks = F.ceil(F.col("all") / BLOCK).cast("int")
    shared_homes = sizes.where("all > 1").withColumn("blocks", blocks).drop("all")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        members.join(shared_homes, ["label", "t", "home"])
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("other", other)
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("blocks", "other")
        .join(coded.drop("label"), "cid")
    )
    key = ["label", "t", "home", "i", "j"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    found = dealt.select(*key, "guest", "block", "cid", "copies", "code", "embedding").mapInArrow(
        lambda batches: _compare(batches, dim, bits, cosine), "cid long, add long, root long"
    )
    found = staged(found, "linked")
    counts = found.groupBy("cid").agg(F.sum("add").alias("more"))
    joined = staged(
        components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "components"
    )
    reached = classes.select("cid", "rep").join(joined, F.expr("cid = node"), "left")
    reached = reached.select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    least = reached.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = (
        reached.join(least, "root")
        .join(counts, "cid", "left")
        .select("cid", "component_id", F.coalesce("more", F.lit(0)).alias("more"))
    )
    return rows.join(classes.join(named, "cid"), ["label", "embedding"]).select(
        "vec_id",
        (F.col("copies") - 1 + F.col("more")).alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
