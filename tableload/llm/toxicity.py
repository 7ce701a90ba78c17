"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_batches

BITS = 20
TRAINING_DOCS = 16_000  # bound of the labelled rows that are learnt from, per label
SHARDS = 4
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 1.0
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|_~`/-"
_MOST_WORDS = 1 << 18
_STEM = 6


class Features:
    """Distinct hashed features of a text: words, their stems (six bytes), pairs of neighbours,
    and pairs with one word between (skip-grams). A-Z are lower-cased, ASCII punctuation around
    words is dropped."""

    def __init__(self, bits: int = BITS):
        self._shift = np.uint64(64 - bits)
        self._words: dict[bytes, int] = {}
        self._stems: dict[bytes, int] = {}

    def _learn(self, words: list[bytes]) -> None:
        missing = set(words).difference(self._words)
        if len(self._words) + len(missing) > _MOST_WORDS:
            self._words.clear()
            self._stems.clear()
            missing = set(words)
        for w in missing:
            bare = w.strip(_EDGE)
            self._words[w] = xxhash.xxh3_64_intdigest(bare)
            self._stems[w] = xxhash.xxh3_64_intdigest(bare[:_STEM], seed=1)

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        self._learn(words)
        h, stems = (
            np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
            for known in (self._words, self._stems)
        )
        pair, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        near = (h[:-1] * pair) ^ (h[1:] >> np.uint64(7))
        far = (h[:-2] * skip) ^ (h[2:] >> np.uint64(9))
        mixed = np.concatenate([h, stems, near, far]) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique((mixed >> self._shift).astype(np.uint32))


@dataclass(frozen=True)
class ToxicityModel:
    """The non-zero weights: feature numbers and values; and the bias."""

    index: np.ndarray
    value: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        weights = np.zeros(1 << self.bits, dtype=np.float32)
        weights[self.index] = self.value
        return weights


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013): per-coordinate rates, L1 sparsity."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    @staticmethod
    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / rate)

    def learn(self, features: np.ndarray, label: int, weight: float) -> None:
        z, n = self.z[features], self.n[features]
        w = self.weights(z, n)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = (p - label) * weight
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[features] = z + g - sigma * w
        self.n[features] = n + g * g


def _packed(state: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The state without loss, small: coordinates never met are left out, and those that only
    one text holds repeat their values."""
    met = (state[0] != 0) | (state[1] != 0)
    parts = [np.packbits(met), *(x[met] for x in state)]
    return zstandard.compress(b"".join(x.tobytes() for x in parts))


def _unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    bits = (size + 7) // 8
    met = np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=size).astype(bool)
    out = np.zeros((2, size))
    out[:, met] = np.frombuffer(raw, np.float64, offset=bits).reshape(2, -1)
    return out[0], out[1]


def fit_toxicity(
    docs: DataFrame,
    labelled: DataFrame,
    training_docs: int = TRAINING_DOCS,
    shards: int = SHARDS,
    epochs: int = EPOCHS,
    bits: int = BITS,
) -> ToxicityModel:
    """A model from ``labelled`` (doc_id, label 0 or 1) and the texts of ``docs``.

    The sample has a bound: of each label the ``training_docs`` ids of least hash. Their features
    are extracted in one pass and staged by shard; tasks then learn side by side, and after
    each epoch their states are averaged coordinate by coordinate in Spark. What reaches the
    driver is bounded by 2**bits coordinates. Rows with null ids or other labels are left out;
    ids labelled both ways count as toxic; without labels the score is one half.
    """
    spark = docs.sparkSession
    labels = (
        labelled.where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    some = [
        labels.where(F.col("label") == x)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(training_docs)
        for x in (0, 1)
    ]
    # At most 2 * training_docs ids, a parameter: the broadcast is bounded.
    chosen = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in text_batches(batches, "text"):
            found = [features.of(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())],
                ["doc_id", "label", "features"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = texts.select("doc_id", "label", "text").mapInArrow(
        extract, f"doc_id {kind}, label int, features binary"
    )
    shard = F.pmod(F.xxhash64("doc_id", "features"), F.lit(shards)).cast("int")
    dealt = rows.withColumn("shard", shard).repartition(shards, "shard")
    order = F.xxhash64("doc_id", "features")
    rows = staged(dealt.sortWithinPartitions("shard", order), "toxicity-features")
    size = 1 << bits
    state = (np.zeros(size + 1), np.zeros(size + 1))
    for _ in range(epochs):
        # Each process that runs tasks keeps a copy on its disk.
        shared = spark.sparkContext.broadcast(_packed(state))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared):
            learners: dict[int, Ftrl] = {}
            begun = _unpacked(shared.value, size + 1)
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("shard", "label", "features")]
                for own, label, found in zip(*columns):
                    if own not in learners:
                        learners[own] = Ftrl(*(x.copy() for x in begun))
                    numbers = np.frombuffer(found, dtype=np.uint32)
                    learners[own].learn(np.append(numbers, size), label, 1.0)
            for learner in learners.values():
                used = np.flatnonzero(learner.n).astype(np.int32)
                for at in range(0, len(used), 1 << 16):
                    part = used[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), pa.array(learner.z[part]), pa.array(learner.n[part])],
                        ["i", "z", "n"],
                    )

        learnt = rows.mapInArrow(learn, "i int, z double, n double")
        # A shard that never met a coordinate still holds the state it began with.
        met = learnt.groupBy("i").agg(
            F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("c")
        )
        table = met.toArrow()
        shared.destroy()
        i = table["i"].to_numpy()
        c = table["c"].to_numpy()
        z, n = (x.copy() for x in state)
        taught = max(1, int(c.max())) if len(c) else 1
        for own, name in ((z, "z"), (n, "n")):
            own[i] = (table[name].to_numpy() + (taught - c) * own[i]) / taught
        state = (z, n)
    weights = Ftrl.weights(*state)
    index = np.flatnonzero(weights[:size]).astype(np.int64)
    return ToxicityModel(index, weights[index].astype(np.float32), float(weights[size]), bits)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted (score of one half or more) of every row.

    Features count once per text, however often they occur. Null and empty texts have none, and
    get the score of the bias. One pass, no shuffle; the weights that are not zero are broadcast,
    of which there are at most 2**bits."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.index, model.value, model.bias, model.bits)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*shared.value)
        features, weights = Features(own.bits), own.dense()
        for batch in text_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            z = [float(weights[features.of(t or "")].sum()) + own.bias for t in texts]
            scores = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
