"""Token counts of whole texts, with a shortcut for pre-tokens that are one token."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_rows
from .pretokens import Pretokens, read_tokenizer, single_tokens

LIMIT = 512


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Counts are those of the library for a byte-level BPE file: no added special tokens, special
    strings in texts as its default has them, no truncation. A null text counts as empty: 0
    bytes, 0 tokens. Repeated rows are counted each.

    The driver proves once which vocabulary strings encode alone as one token and broadcasts
    them (bounded by the vocabulary). Each pre-token of a text that is among them counts one;
    only the others are merged, and remembered per task up to a bound. One pass, no shuffle;
    long texts are split in chunks at places no pre-token spans.
    """
    source = read_tokenizer(tokenizer_path)
    tokenizer = Tokenizer.from_str(source)
    context = docs.sparkSession.sparkContext
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_tokens")])
    shared = context.broadcast((source, dict.fromkeys(single_tokens(tokenizer), 1)))

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        json, known = shared.value
        counter = Pretokens(Tokenizer.from_str(json), len, known)

        def tokens(texts):
            return ([sum(map(sum, counter.values(t))) for t in texts],)

        return by_rows(tokens, ["doc_id", "n_bytes", "text"], schema)(batches)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
