"""Text quality by compression with dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches, tidied

#: Bounds of the sample that the classifier is fitted on, per label.
DICTIONARY_DOCS = 1500
CALIBRATION_DOCS = 1500
PIECES = 4  # pieces of a document that may enter a dictionary, spread over the whole text
PIECE = 2048
DICTIONARY_BYTES = 112_640
BLOCK = 4096  # bytes compressed at once
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of good and bad text, and the calibration of what they tell."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(features)), features]) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Sizes:
    """Compressed sizes of a text with either dictionary and with none."""

    def __init__(self, good: bytes, bad: bytes):
        self._with = []
        for content in (good, bad):
            trained = zstandard.ZstdCompressionDict(content)
            trained.precompute_compress(level=LEVEL)
            self._with.append(self._compressor(dict_data=trained))
        self._with.append(self._compressor(level=LEVEL))

    @staticmethod
    def _compressor(**options) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(
            write_content_size=False, write_checksum=False, write_dict_id=False, **options
        )

    def features(self, text: str) -> tuple[float, float]:
        """(difference, plain): how much smaller the good dictionary makes the text than the bad
        one, over their sum; and the plain compressed share of its bytes. Blocks of the whole
        text are compressed alone, so that a long text still meets the dictionaries."""
        data = text.encode()
        good = bad = plain = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            good += len(self._with[0].compress(block))
            bad += len(self._with[1].compress(block))
            plain += len(self._with[2].compress(block))
        if not data:
            return 0.0, 1.0
        return (bad - good) / (bad + good), min(1.0, plain / len(data))


def _bounded(labelled: DataFrame, label: int, n: int) -> DataFrame:
    """The n labelled ids of least hash: the same whenever and however often it is computed."""
    rows = labelled.where(F.col("label") == label)
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def fit_quality(
    docs: DataFrame,
    labelled: DataFrame,
    dictionary_docs: int = DICTIONARY_DOCS,
    calibration_docs: int = CALIBRATION_DOCS,
) -> QualityModel:
    """A model from ``labelled`` (doc_id, label 0 or 1) and the texts of ``docs``.

    The sample has a bound: of each label the ``dictionary_docs + calibration_docs`` ids of least
    hash. The former give up to four pieces of 2 kB each, spread over the text, to the dictionary
    of their label; on the latter, held out from the dictionaries, a logistic regression of
    label on (difference, plain share) is fitted, weighted back to the labels' shares. Rows with
    null ids or other labels are left out; ids labelled both ways count as bad. A label without
    documents has an empty dictionary, and the score then is the share of good labels.
    """
    labels = (
        labelled.where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
    )
    totals = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    n = dictionary_docs + calibration_docs
    chosen = _bounded(labels, 0, n).unionByName(_bounded(labels, 1, n))
    place = F.xxhash64(F.lit("part"), F.col("doc_id"))
    chosen = chosen.withColumn("part", F.pmod(place, F.lit(n)) < dictionary_docs)
    # At most 2n ids: n is a parameter, so the broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = rows.where("text is not null and text <> ''")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            out = {"label": [], "piece": []}
            for label, text in zip(*(batch.column(c).to_pylist() for c in ("label", "text"))):
                data = text.encode()
                starts = np.linspace(0, max(0, len(data) - PIECE), PIECES).astype(int)
                for start in sorted(set(starts.tolist())):
                    out["label"].append(label)
                    out["piece"].append(data[start : start + PIECE])
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("label", pa.int32()), ("piece", pa.binary())])
            )

    # Bounded: 2 * dictionary_docs documents of at most PIECES * PIECE bytes (copies aside).
    first = texts.where("part").dropDuplicates(["doc_id"])
    sample = first.mapInArrow(tidied(pieces), "label int, piece binary").toArrow().to_pydict()
    trained = {}
    for label in (0, 1):
        own = sorted(p for x, p in zip(sample["label"], sample["piece"]) if x == label)
        trained[label] = _dictionary(own)
    shares = (1 + totals.get(1, 0)) / (2 + totals.get(0, 0) + totals.get(1, 0))
    if not trained[0] or not trained[1]:
        return QualityModel(trained[1], trained[0], (float(np.log(shares / (1 - shares))), 0.0, 0.0))
    model = QualityModel(trained[1], trained[0], (0.0, 0.0, 0.0))
    held = texts.where("not part").dropDuplicates(["doc_id"])
    measured = _measure(held, model, "label").toArrow().to_pydict()
    order = np.lexsort([measured["plain"], measured["difference"]])
    x = np.column_stack([measured["difference"], measured["plain"]])[order].reshape(-1, 2)
    y = np.array(measured["label"], dtype=float)[order]
    return QualityModel(trained[1], trained[0], _logistic(x, y, shares))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the raw pieces where there are too few to train on."""
    if not pieces:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3) -> tuple:
    """Weighted logistic regression by Newton's steps on standardised columns."""
    if not len(y) or y.min() == y.max():
        return (float(np.log(share / (1 - share))), *[0.0] * x.shape[1])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        slope = a.T @ (w * (y - p)) - ridge * len(y) * np.r_[0, b[1:]]
        curve = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * len(y) * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    weights = b[1:] / spread
    return (float(b[0] - weights @ mean), *map(float, weights))


def _measure(rows: DataFrame, model: QualityModel, *columns: str) -> DataFrame:
    """The columns, then difference, plain and score of each text."""
    shared = rows.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))
    chosen = rows.select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        sizes = _Sizes(own.good, own.bad)
        for batch in text_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = np.array([sizes.features(t or "") for t in texts]).reshape(-1, 2)
            made = [found[:, 0], found[:, 1], own.scores(found)]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(v) for v in made], [*columns, "difference", "plain", "score"]
            )

    kinds = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes if n != "text")
    return chosen.mapInArrow(tidied(run), f"{kinds}, difference double, plain double, score double")


def score_quality(docs: DataFrame, model: QualityModel, *columns: str) -> DataFrame:
    """The columns (by default doc_id) of every row with difference, plain, score and predicted.

    Null and empty texts measure 0 and 1 and get the score of that. One pass, no shuffle."""
    scored = _measure(docs, model, *(columns or ("doc_id",)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` whose score is one half or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        sizes = _Sizes(own.good, own.bad)
        for batch in text_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = np.array([sizes.features(t or "") for t in texts]).reshape(-1, 2)
            yield batch.filter(pa.array(own.scores(found) >= 0.5))

    return docs.mapInArrow(tidied(run), docs.schema)


def learnable(doc_id: Column, parts: int, held: int) -> Column:
    """Whether a label may be learnt from: crc32 of the id as text is not ``held`` mod parts."""
    return F.crc32(doc_id.cast("string")) % parts != held
