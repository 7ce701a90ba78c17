"""Token ids of whole texts, packed into rows of fixed length by best-fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, tidied
from .pretokens import PATTERN, chunks

SEQUENCE = 2048
BLOCK_TOKENS = 1 << 22  # tokens packed together; a task holds one such block
IDS = "<u2"  # little-endian, for vocabularies of up to 65,536 ids
WIDE_IDS = "<u4"

SCHEMA = (
    "shard int, row long, n_tokens int, input_ids binary, position_ids binary, "
    "cu_seqlens array<int>, doc_ids array<bigint>, doc_starts array<int>"
)


# The characters with the White_Space property. Runs of them this long are encoded
# apart from the encoder's splitter, whose look-ahead keeps a state for each character.
_SPACES = regex.compile(
    r"[\x09-\x0D \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]{4096,}"
)


def token_ids(encoding: tiktoken.Encoding, text: str) -> Iterator[list[int]]:
    """The ids of a text, piece by piece, so that a long text is never held as one list.

    A run of white space is one pre-token, but for its last character if something follows it:
    that one begins the next pre-token. Nothing before a run depends on the run's length.
    """
    start = 0
    for run in _SPACES.finditer(text):
        yield from map(encoding.encode_ordinary, chunks(text[start : run.start()]))
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield encoding._encode_single_piece(text[run.start() : start])
    yield from map(encoding.encode_ordinary, chunks(text[start:]))


class CapacityTree:
    """Free room of open rows: a segment tree over room sizes that counts rows of each size.

    ``fit(need)`` finds the smallest room of at least ``need`` in O(log size)."""

    def __init__(self, most: int):
        self._leaves = 1 << most.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self._leaves
        while node:
            self._count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self._rows[room].append(row)
        self._change(room, 1)

    def fit(self, need: int) -> tuple[int, int] | None:
        """Takes out and returns (room, row), or None if no row has the room."""
        node, count = need + self._leaves, self._count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self._leaves
        self._change(room, -1)
        return room, self._rows[room].pop()


def pack(lengths: Iterable[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: for each row, the positions of the lengths placed in it. Longest
    first, equal ones in their order; each goes where it leaves the least room."""
    lengths = list(lengths)
    tree, rows = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.fit(lengths[i])
        if found is None:
            found = size, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], row)
    return rows


def _packed(block: list[tuple], size: int, pad: int, ids: str) -> dict[str, list]:
    """The rows of one block of (doc_id, first position in the document, token ids)."""
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    steps = np.arange(size)
    for row in pack((len(b[2]) for b in block), size):
        parts = [block[i] for i in row]
        ends = np.cumsum([0] + [len(p[2]) for p in parts])
        matrix = np.full(size, pad, dtype=ids)
        matrix[: ends[-1]] = np.concatenate([p[2] for p in parts])
        positions = steps.copy()
        for start, end in zip(ends, ends[1:]):
            positions[start:end] -= start
        positions[ends[-1] :] -= ends[-1]
        out["n_tokens"].append(int(ends[-1]))
        out["input_ids"].append(matrix.tobytes())
        out["position_ids"].append(positions.astype(IDS if size <= 1 << 16 else WIDE_IDS).tobytes())
        out["cu_seqlens"].append(ends.tolist())
        out["doc_ids"].append([p[0] for p in parts])
        out["doc_starts"].append([p[1] for p in parts])
    return out


def fill_rate(rows: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """One row on packed rows: how many, the tokens of documents in them, and their share of the
    room (null without rows). Every partition of the input leaves at least its last row partly
    empty, so many small partitions fill worse than few large ones."""
    counted = rows.agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    return counted.withColumn("filled", F.col("tokens") / (F.col("rows") * size))


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    size: int = SEQUENCE,
    end_of_text: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Rows of ``size`` token ids that together hold every document once.

    ``input_ids`` is a row of the id matrix (little-endian uint16, or uint32 for vocabularies
    beyond 65,536), filled up with ``end_of_text``; ``cu_seqlens`` are the cumulative segment
    lengths, ``position_ids`` (uint16, or uint32 if ``size`` is beyond 65,536) restart at each
    segment and in the filling; ``doc_ids`` and ``doc_starts`` name each segment's document and
    its first token there. ``shard`` and ``row`` number the rows.

    Every document's ids end with ``end_of_text`` (by default the id after the last rank); null
    and empty texts are that id alone. Documents longer than ``size`` are cut into segments that
    join up again without loss. Special strings in texts are ordinary text. Repeated and null
    ids stay as they are. An empty table gives no rows.

    Each task packs blocks of about ``block_tokens`` of its own documents, so there is no
    shuffle and a task's memory has a bound, whatever the length of a document: a document that
    does not fit into a block goes on in the next. A task that runs again packs the same.
    """
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    end = max(ranks.values()) + 1 if end_of_text is None else end_of_text
    ids = IDS if max(end, *ranks.values()) < 1 << 16 else WIDE_IDS
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoding = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={}
        )
        for batch in text_batches(batches, "text"):
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                parts = [np.array(p, dtype=ids) for p in token_ids(encoding, text or "")]
                tokens = np.concatenate([*parts, np.array([end], dtype=ids)])
                for start in range(0, len(tokens), size):
                    yield doc_id, start, tokens[start : start + size]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done = TaskContext.get().partitionId(), 0
        block, held = [], 0

        def flush():
            nonlocal done
            made = _packed(block, size, end, ids)
            n = len(made["n_tokens"])
            made["shard"] = [shard] * n
            made["row"] = list(range(done, done + n))
            done += n
            block.clear()
            for at in range(0, n, 512):
                part = {c: v[at : at + 512] for c, v in made.items()}
                yield pa.RecordBatch.from_pydict(part, schema=arrow)

        for segment in segments(batches):
            block.append(segment)
            held += len(segment[2])
            if held >= block_tokens:
                yield from flush()
                held = 0
        if block:
            yield from flush()

    arrow = pa.schema(
        [
            ("shard", pa.int32()),
            ("row", pa.int64()),
            ("n_tokens", pa.int32()),
            ("input_ids", pa.binary()),
            ("position_ids", pa.binary()),
            ("cu_seqlens", pa.list_(pa.int32())),
            ("doc_ids", pa.list_(pa.int64())),
            ("doc_starts", pa.list_(pa.int32())),
        ]
    )
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(tidied(rows), SCHEMA)
