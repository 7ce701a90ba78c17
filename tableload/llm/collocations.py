"""Phrases whose words stand together more than their parts would: Toivonen's mining, exact counts.

A sample of the documents proposes words and two-word phrases. One pass over all documents then
counts the proposals and their negative border, the phrases that were not proposed though their
parts were: every single word, every pair of proposed words, every three words whose two pairs
were proposed. If a border phrase turns out frequent, phrases that contain it may be frequent and
were not counted; it joins the proposals, and another pass counts what the border gained, until
no border phrase fails. Each phrase is counted in one pass only, and the sample decides how much
the passes count, never the result.

What was proposed is told by bits of a fixed number that travel to all tasks. A phrase whose bits
are set by others is only counted without need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tidied

LEAST = 10  # occurrences of a candidate
TOP = 2000  # candidates of a language
SHARE_PERCENT = 50  # a candidate in so much of whose occurrences a longer one stands is dropped
NO_LANG = "und"
SAMPLE_EVERY = 8  # documents for each one of the sample
SAMPLE_COUNT = 2  # occurrences in the sample that make a proposal
FILTER_BITS = 26  # two to this power is the number of bits that tell the proposals
_RUN = 1 << 20  # bytes of text counted at once
_HELD = 1 << 21  # occurrences that a task counts at once
_ID_BITS = 21  # word numbers of a run, so that three fit into 63 bits
_BREAK = b"."
#: What ends a piece becomes one sign, and tabs become spaces.
_SIGNS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", _BREAK * 10 + b" ")

#: Language and phrase in one string, divided by a line end, which no phrase holds: small rows.
_COUNTS = pa.schema([("key", pa.string()), ("f", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first) + second * np.uint64(0x9E3779B97F4A7C15)


class Proposals:
    """Which words and pairs were proposed: two bits for each, of 2**``power``.

    ``has`` is true of all that were added, and of others by chance."""

    def __init__(self, power: int, words: np.ndarray | None = None):
        self.power = power
        self.words = np.zeros(1 << (power - 6), np.uint64) if words is None else words

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, keep = _mixed(hashes), np.uint64(64 - self.power)
        return x >> keep, (x * np.uint64(0xD6E8FEB86659FD93)) >> keep

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            word = self.words[(at >> np.uint64(6)).astype(np.int64)]
            found &= (word >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def with_bits(self, rows: pa.Table) -> Proposals:
        """These and the bits of ``rows`` (place of a 64-bit word, its bits)."""
        words = self.words.copy()
        words[rows["word"].to_numpy()] |= rows["bits"].to_numpy().view(np.uint64)
        return Proposals(self.power, words)


def _runs(text: bytes, most: int = _RUN) -> Iterator[bytes]:
    """The text cut before spaces and signs into runs of about ``most`` bytes."""
    start = 0
    while len(text) - start > most:
        found = _EDGE.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


_EDGE = re.compile(rb"[ .]")


def _both(at: np.ndarray, n: int) -> np.ndarray:
    """Of n places, where one of ``at`` is and the next one too."""
    known = np.zeros(n, bool)
    known[at] = True
    return known[:-1] & known[1:]


class _Counter:
    """Counts of the phrases of one language within a task."""

    def __init__(self, lang: str, longest: int, now: Proposals | None, before: Proposals | None):
        self._lang, self._longest = lang, longest
        self._now, self._before = now, before
        self._clear()

    def _tell(self, new: list[bytes]) -> None:
        """Notes the hashes of new words, and whether they were proposed."""
        hashes = _word_hashes(self._lang, new)
        self._hashes = np.concatenate([self._hashes, hashes])
        for told, proposals in ((self._told, self._now), (self._told_before, self._before)):
            if proposals is not None:
                told.append(np.concatenate([*told, proposals.has(hashes)]))
                del told[:-1]

    def _clear(self) -> None:
        self._ids: dict[bytes, int] = {_BREAK: 0}
        self._words: list[bytes] = [_BREAK]
        self._hashes = np.zeros(1, np.uint64)
        self._told, self._told_before = [np.zeros(1, bool)], [np.zeros(1, bool)]
        self._held: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
        self.n = self.size = 0

    def _number(self, tokens: list[bytes]) -> np.ndarray:
        ids, words = self._ids, self._words
        for word in set(tokens).difference(ids):
            ids[word] = len(words)
            words.append(word)
        if self._now is not None and len(words) > len(self._hashes):
            self._tell(words[len(self._hashes) :])
        return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))

    def _keep(self, size: int, keys: np.ndarray) -> None:
        self._held[size].append(keys)
        self.size += len(keys)

    def add(self, text: bytes) -> None:
        """Counts a text (lower case, pieces ended by the sign), run by run."""
        last: list[bytes] = [_BREAK, _BREAK]
        for run in _runs(text):
            if len(self._words) > 1 << (_ID_BITS - 1):
                yield from self.flush()
            tokens = last + run.replace(_BREAK, b" . ").split()
            ids = self._number(tokens)
            last = tokens[-2:]
            w = ids[2:]
            if self._before is None:
                self.n += int(np.count_nonzero(w))
                self._keep(1, w[w > 0])
            if self._longest > 1:
                self._pairs(ids)
            if self.size > _HELD:
                yield from self.flush()

    def _pairs(self, ids: np.ndarray) -> None:
        """The pairs and threes that end in this run. A pair is due if both of its words were
        proposed, three words if both of their pairs were, unless they were due before."""
        a, b = ids[:-1], ids[1:]
        if self._now is None:
            own = np.flatnonzero((a > 0) & (b > 0))
            own = own[own > 0]
            self._keep(2, a[own] << _ID_BITS | b[own])
            return
        told = self._told[0][ids]
        pairs = told[:-1] & told[1:]
        due = pairs.copy()
        due[0] = False  # it ended in the run before
        if self._before is not None:
            told = self._told_before[0][ids]
            former = told[:-1] & told[1:]
            due &= ~former
        at = np.flatnonzero(due)
        self._keep(2, a[at] << _ID_BITS | b[at])
        if self._longest < 3:
            return
        # The words of a proposed pair were proposed too, so no other pair needs a look. A pair
        # that has its bits by chance counts only from when its words were proposed: now as before.
        at = np.flatnonzero(pairs)
        hashes = _pair_hashes(self._hashes[a[at]], self._hashes[b[at]])
        held = self._now.has(hashes)
        at, hashes = at[held], hashes[held]
        due = _both(at, len(a))
        if self._before is not None:
            due &= ~_both(at[former[at] & self._before.has(hashes)], len(a))
        at = np.flatnonzero(due)
        self._keep(3, (ids[at] << _ID_BITS | ids[at + 1]) << _ID_BITS | ids[at + 2])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Hands the counts on and forgets them. The count of all words has the empty phrase."""
        words = pa.array(self._words, pa.binary())
        lang = pa.scalar(self._lang.encode() + b"\n", pa.binary())
        space, mask = pa.scalar(b" ", pa.binary()), (1 << _ID_BITS) - 1
        if self.n:
            yield _batch(pa.array([lang.as_py()], pa.binary()), np.array([self.n]))
        for size, parts in self._held.items():
            if not parts:
                continue
            keys, f = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            for start in range(0, len(keys), 1 << 16):
                part = keys[start : start + (1 << 16)]
                columns = [
                    words.take(pa.array((part >> (_ID_BITS * i)) & mask))
                    for i in reversed(range(size))
                ]
                phrase = columns[0]
                if size > 1:
                    phrase = pc.binary_join_element_wise(*columns, space)
                key = pc.binary_join_element_wise(lang, phrase, pa.scalar(b"", pa.binary()))
                yield _batch(key, f[start : start + (1 << 16)])
        self._clear()


def _batch(key: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    columns = [key.cast(pa.string()), pa.array(f.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def _counts(texts: DataFrame, least: int, longest: int, now=None, before=None) -> DataFrame:
    """Rows (lang, size, phrase, f) of one pass over ``texts`` (lang, text): each phrase's
    occurrences, added up, if at least ``least``. Without proposals all phrases up to
    ``longest`` words count; with them the pairs and threes that are due, and single words unless
    ``before`` is given. Size 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        proposed, former = (x.value if x is not None else None for x in (now, before))
        for batch in batches:
            grouped: dict[str, list[bytes]] = {}
            rows = zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()))
            for lang, text in rows:
                grouped.setdefault(lang, []).append(text.as_py())
            for lang, found in grouped.items():
                if lang not in counters:
                    counters[lang] = _Counter(lang, longest, proposed, former)
                whole = _BREAK.join(found).lower().translate(_SIGNS)
                yield from counters[lang].add(whole)
            while sum(c.size for c in counters.values()) > _HELD:
                yield from max(counters.values(), key=lambda c: c.size).flush()
        for counter in counters.values():
            yield from counter.flush()

    # Tasks have added up what repeats; adding up again before the shuffle would find little.
    rows = texts.mapInArrow(tidied(run), "key string, f long").repartition("key").groupBy("key")
    phrase = F.substring_index("key", "\n", -1)
    spaces = F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit("")))
    return rows.agg(F.sum("f").alias("f")).where(F.col("f") >= least).select(
        F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"),
        F.when(phrase == "", 0).otherwise(spaces + 1).alias("size"),
        phrase.alias("phrase"),
        "f",
    )


def _new_bits(phrases: DataFrame, power: int, known=None) -> pa.Table:
    """The bits of ``phrases`` (lang, phrase of one or two words) that ``known`` has not, one row
    per 64-bit word with a bit: bounded by 2**(power - 6) rows, whatever the number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = known.value if known is not None else None
        empty = Proposals(power, np.zeros(1, np.uint64))
        for batch in batches:
            hashes = []
            for lang, phrase in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase"))):
                made = _word_hashes(lang, phrase.encode().split(b" "))
                hashes.append(made if len(made) == 1 else _pair_hashes(made[:1], made[1:]))
            new = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            if had is not None:
                new = new[~had.has(new)]
            places = np.concatenate(empty.places(new))
            bits = (np.uint64(1) << (places & np.uint64(63))).view(np.int64)
            columns = [pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(tidied(run), "word long, bits long")
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()


def phrase_counts(
    docs: DataFrame,
    least: int = LEAST,
    sample_every: int = SAMPLE_EVERY,
    sample_count: int = SAMPLE_COUNT,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Rows (lang, size, phrase, f): every phrase of one to three words that occurs at least
    ``least`` times in its language, with its occurrences, and with size 0 the count of all words.

    The sample is one in ``sample_every`` documents by a hash of the id, so a rerun takes the
    same; ``sample_count`` occurrences in it propose a phrase. Both change only how much the
    passes count. Exact even if the sample is empty: then the passes go word by word. At most
    four passes, since each one that fails does so with longer phrases.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(sample_every)) == 0
    sample = texts.where(chosen)
    proposed = _counts(sample, sample_count, 2).where("size > 0")
    now, before = Proposals(filter_bits).with_bits(_new_bits(proposed, filter_bits)), None
    passes = []
    while True:
        shared = [spark.sparkContext.broadcast(p) if p else None for p in (now, before)]
        passes.append(staged(_counts(texts, least, 3, *shared), "phrases"))
        # The border fails where a frequent word or pair was not proposed.
        parts = passes[-1].where("size in (1, 2)")
        failed = _new_bits(parts, filter_bits, shared[0])
        for old in filter(None, shared):
            old.unpersist()
        if not failed.num_rows:
            return reduce(DataFrame.unionByName, passes)
        now, before = now.with_bits(failed), now


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    share_percent: int = SHARE_PERCENT,
    **sampling,
) -> DataFrame:
    """The phrases of two and three words of each language by how much more often they occur than
    their parts would lead one to expect: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count (at least ``least``), ``n`` the language's count of words. Cut
    after its first word or its second, ``l`` and ``r`` are the counts of the two parts and the
    score is floor(1000000 * a * a / (l * r)); of three words the cut with the lower score
    counts, the earlier if equal. A phrase of two words is dropped if one of three that contains
    it occurs in ``share_percent`` of its occurrences or more. Returned are each language's first
    ``top`` by score, then count, both descending, then phrase by its UTF-8 bytes. All counts are
    over all documents, products are taken in decimals.

    Words stand between spaces and tabs; full stops, commas, semicolons, colons, exclamation and
    question marks and line ends end a piece, and phrases never go beyond one. A-Z are
    lower-cased. Null texts are empty; null languages are ``und``. Repeated rows count each
    time; further columns are left out; an empty table gives no rows. Options of
    ``phrase_counts`` can follow.
    """
    counts = phrase_counts(docs, least, **sampling)
    parts = counts.where("size in (1, 2)").select("lang", "phrase", "f")

    def cut(phrases: DataFrame, first: str, rest: str) -> DataFrame:
        """The phrases with the counts of their parts, all of which are frequent too."""
        left = parts.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
        right = parts.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
        rows = phrases.withColumns({"_first": F.expr(first), "_rest": F.expr(rest)})
        rows = rows.join(left, ["lang", "_first"]).join(right, ["lang", "_rest"])
        score = (
            "cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
            " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
        )
        return rows.select("lang", "phrase", "a", "l", "r", F.expr(score).alias("score"))

    phrases = counts.withColumnRenamed("f", "a")
    pairs, threes = (phrases.where(F.col("size") == s) for s in (2, 3))
    first, last = "substring_index(phrase, ' ', 1)", "substring_index(phrase, ' ', -1)"
    inside = F.explode(
        F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))
    )
    longer = threes.select("lang", inside.alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = pairs.join(longer, ["lang", "phrase"], "left").where(
        f"longer is null or 100 * longer < {share_percent} * a"
    )
    # One row per phrase of three words with both cuts, so that no join brings them together.
    early = cut(threes, first, "substring_index(phrase, ' ', -2)")
    late = cut(threes, "substring_index(phrase, ' ', 2)", last)
    cuts = early.withColumn("k", F.lit(1)).unionByName(late.withColumn("k", F.lit(2)))
    lowest = F.min(F.struct("score", "k", "l", "r"))
    threes = cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("cut"))
    threes = threes.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    found = staged(cut(pairs, first, last).unionByName(threes), "collocations")

    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
