"""Near-duplicate texts by Jaccard similarity of word shingles: prefixes of rare shingles first,
single shingles indexed where they are rare, pairs of shingles where they are frequent."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, id_filter, staged, text_batches, tidied

WORDS = 5
PERCENT = 80
DF_BITS = 18  # buckets that count how often shingles occur
FREQUENT = 64  # occurrences above a bucket's expected load that make its shingles frequent
GROUP = 16  # size band / GROUP classes of frequent shingles
MET_KEPT = 64  # shingles met elsewhere that a wide set carries along for the bound
VERIFY_ROWS = 1024  # partners verified beside one copy of a hub's shingles
BLOCK_SETS = 512  # sets of a component compared at once with as many others
BLOCK_SHINGLES = 1 << 18  # shingles that such a block holds on average at most
_COLUMNS = 4096

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORDS_KEPT = 1 << 18


def allowed_misses(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked set may lack: n - ceil(percent * n / 100)."""
    return n - (percent * n + 99) // 100


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingles:
    """64-bit hashes of the runs of ``words`` words of texts; a shorter text is one shingle as a
    whole, a text without words has none. Words stand between ASCII white space; A-Z are
    lower-cased."""

    def __init__(self, words: int):
        self._size = words
        self._known = _WordHashes()

    @staticmethod
    def _fold(h: np.ndarray, size: int) -> np.ndarray:
        count = len(h) - size + 1
        mixed = np.full(count, size, dtype=np.uint64)
        for j in range(size):
            mixed = _mix(mixed * _A + h[j : j + count])
        return mixed

    def runs(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the hashes of its shingles in order, repeats included."""
        if len(self._known) > _WORDS_KEPT:
            self._known.clear()
        split = [t.encode().lower().split() for t in texts]
        lengths = [len(w) for w in split]
        words = chain.from_iterable(split)
        get = map(self._known.__getitem__, words)
        h = np.fromiter(get, dtype=np.uint64, count=sum(lengths))
        size, at, out = self._size, 0, []
        mixed = self._fold(h, size) if len(h) >= size else h[:0]
        for n in lengths:
            if n >= size:
                out.append(mixed[at : at + n - size + 1])
            else:
                out.append(self._fold(h[at : at + n], n) if n else h[:0])
            at += n
        return out

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its distinct shingles, sorted."""
        out = []
        for found in self.runs(texts):
            found = np.sort(found)
            out.append(found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found)
        return out


def digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Signatures:
    """What a set is indexed by, such that linked sets share a signature.

    Shingles are ordered by ``counts`` of their bucket, rare first, then by hash. A linked set
    lacks at most ``e`` of a set's n shingles. Of two linked sets, take the prefix that ends
    first in this order: all its shingles that the other set holds are in the other's prefix.

    - If the first e + 1 shingles are rare, each is a signature; one at least is shared.
    - Otherwise the prefix goes on into the frequent shingles, which hashing deals to classes. A
      pair may share one shingle of a class without sharing two, so the prefix is extended until
      rare shingles, and frequent ones beyond the first of their class, make e + 1. Signatures
      are the rare shingles and all pairs within a class. If linked sets shared none of these,
      more than e shingles of the prefix would be missing.

    The number of classes follows the set's size band (a power of two), so the pairs stay linear
    in n. Sets that may meet one of the next band are indexed under both.
    """

    def __init__(self, counts: np.ndarray, percent: int, frequent: int = FREQUENT):
        self._counts, self._percent = counts, percent
        self._shift = np.uint64(64 - (len(counts) - 1).bit_length())
        load = counts.sum() / len(counts)
        self._most = load + 6 * load**0.5 + frequent

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures of rare shingles, signatures of pairs of frequent ones)."""
        n, none = len(shingles), np.empty(0, dtype=np.uint64)
        misses, largest = allowed_misses(n, self._percent), 100 * n // self._percent
        if not misses and largest == n:
            return none, none  # only an equal set can link with it
        counts = self._counts[shingles >> self._shift]
        order = np.lexsort((shingles, counts))
        ranked = shingles[order]
        rare = int((counts <= self._most).sum())
        if rare > misses:
            return _mix(ranked[: misses + 1] ^ _A), none
        least = (self._percent * n + 99) // 100
        pairs = [
            self._pairs(ranked[rare:], misses + 1 - rare, band)
            for band in range(least.bit_length() - 1, largest.bit_length())
        ]
        return _mix(ranked[:rare] ^ _A), np.concatenate([none, *pairs])

    @staticmethod
    def _pairs(frequent: np.ndarray, needed: int, band: int) -> np.ndarray:
        classes = max(1, (1 << band) // GROUP)
        own = (_mix(frequent ^ _B) % np.uint64(classes)).astype(np.int64)
        first = np.zeros(len(own), dtype=bool)
        first[np.unique(own, return_index=True)[1]] = True
        beyond = np.cumsum(~first)
        end = int(np.searchsorted(beyond, needed)) + 1
        by_class = np.argsort(own[:end], kind="stable")
        chosen, own = frequent[:end][by_class], own[:end][by_class]
        out = []
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
        for a, b in zip(starts, starts[1:]):
            i, j = np.triu_indices(b - a, 1)
            # Within a class the order is the same in both sets: count, then hash.
            out.append(_mix(chosen[a:b][i] * _A + chosen[a:b][j]) ^ np.uint64(band + 1))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _joined(arrays: list[np.ndarray], most: int = 1 << 17) -> Iterator[np.ndarray]:
    """The arrays, put together in runs of about ``most`` elements."""
    held, n = [], 0
    for x in arrays:
        held.append(x)
        n += len(x)
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def shingle_counts(docs: DataFrame, words: int, bits: int = DF_BITS) -> np.ndarray:
    """How often shingles of each hash bucket occur, over all texts. Tasks count in an array; the
    driver receives at most 2**bits sums."""
    size, shift = 1 << bits, np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingles(words), np.zeros(size, dtype=np.int64)
        for batch in text_batches(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for found in _joined(shingles.runs(texts)):
                total += np.bincount((found >> shift).astype(np.int64), minlength=size)
        used = np.flatnonzero(total)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(total[part])], ["i", "c"]
            )

    sums = docs.select("text").mapInArrow(tidied(count), "i int, c long").groupBy("i").agg(F.sum("c"))
    table, counts = sums.toArrow(), np.zeros(size, dtype=np.int64)
    counts[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return counts


_INDEXED = (
    "doc_id long, key long, digest long, n int, sig long, rare boolean, wide boolean, rares int"
)


def _indexed(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """Two kinds of rows: one per document (sig null) with its id, key, digest of its set and
    size n; and one per signature of each set. ``wide`` sets reach into frequent shingles; they
    are indexed by all their ``rares`` rare ones."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signatures = Shingles(words), Signatures(shared.value, percent)
        done: set[int] = set()  # sets indexed lately by this task: copies add no rows
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
        kinds.append(pa.int32())
        schema = pa.schema(list(zip([c.split()[0] for c in _INDEXED.split(", ")], kinds)))
        for batch in text_batches(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            digests, sizes, out = [], [], []
            for own in shingles.sets(texts):
                number = digest(own) if len(own) else None
                digests.append(number)
                sizes.append(len(own))
                if number is None or number in done:
                    continue
                if len(done) >= 1 << 17:
                    done.clear()
                done.add(number)
                rare, pairs = signatures.of(own)
                out.append((number, len(own), rare, pairs))
            rows = len(texts)
            none = pa.nulls(rows, pa.int64())
            no = pa.nulls(rows, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(digests, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    none,
                    no,
                    no,
                    pa.nulls(rows, pa.int32()),
                ],
                schema=schema,
            )
            if not out:
                continue
            lengths = [len(r) + len(p) for _, _, r, p in out]
            total = sum(lengths)
            sigs = np.concatenate([x for _, _, r, p in out for x in (r, p)])
            rare = np.concatenate(
                [x for _, _, r, p in out for x in (np.ones(len(r), bool), np.zeros(len(p), bool))]
            )
            wide = np.repeat([len(p) > 0 for _, _, _, p in out], lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(total, pa.int64()),
                    pa.nulls(total, pa.int64()),
                    pa.array(np.repeat([d for d, _, _, _ in out], lengths), pa.int64()),
                    pa.array(np.repeat([n for _, n, _, _ in out], lengths), pa.int32()),
                    pa.array(_signed(sigs)),
                    pa.array(rare),
                    pa.array(wide),
                    pa.array(np.repeat([len(r) for _, _, r, _ in out], lengths), pa.int32()),
                ],
                schema=schema,
            )

    return docs.mapInArrow(tidied(index), _INDEXED)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sets may link, by sizes, and between wide sets by rare shingles.

    All ``rares`` rare shingles of a wide set are signatures, and ``mets`` of them other sets
    have too, listed in ``met`` unless they are many. Of two wide sets each lacks the other's
    rare shingles that are not in both lists; what is left must suffice."""

    def suffices(shared: str) -> str:
        most = (
            f"least({a}.n - {a}.rares + least({a}.mets, {shared}), "
            f"{b}.n - {b}.rares + least({b}.mets, {shared}))"
        )
        return f"{100 + percent} * {most} >= {percent} * ({a}.n + {b}.n)"

    few = f"least({a}.mets, {b}.mets)"
    both = f"coalesce(nullif(size(array_intersect({a}.met, {b}.met)), -1), {few})"
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and "
        f"(not ({a}.wide and {b}.wide) or ({suffices(few)} and {suffices(both)}))"
    )


def _enough_shared(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share as many signatures as linked sets must.

    Linked sets share at least o = ceil(percent * (n_a + n_b) / (100 + percent)) shingles, so a
    set lacks in the other at most n - o. If its prefix of e + 1 rare shingles ends first, all it
    shares of them are signatures of both: e + 1 - (n - o) at least, and of the two bounds the
    lesser holds. Wide sets have other prefixes and pass."""
    o = f"ceil({percent} * (na + nb) / {100 + percent}D - 1e-9)"

    def need(n: str) -> str:
        return f"(floor({100 - percent} * {n} / 100D + 1e-9) + 1 - ({n} - {o}))"

    lists = members.where("not wide").groupBy("digest").agg(F.collect_list("sig").alias("sigs"))
    own = lists.select(F.col("digest").alias("a"), F.col("sigs").alias("own"))
    other = lists.select(F.col("digest").alias("b"), F.col("sigs").alias("other"))
    both = "size(array_intersect(own, other))"
    enough = (
        pairs.where("not wide")
        .join(own, "a")
        .join(other, "b")
        .where(f"{both} >= least({need('na')}, {need('nb')})")
    )
    return enough.select("a", "b").union(pairs.where("wide").select("a", "b"))


def _pair_columns(a: str, b: str) -> list[Column]:
    return [
        F.col(f"{a}.digest").alias("a"),
        F.col(f"{b}.digest").alias("b"),
        F.col(f"{a}.n").alias("na"),
        F.col(f"{b}.n").alias("nb"),
        F.expr(f"{a}.wide or {b}.wide").alias("wide"),
    ]


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int):
    """The pairs (a, b) of digests whose sets link, by exact count of shared shingles.

    Sets are computed again, only for documents that are in a pair, and go straight to where
    they are compared: a hub's set ``a`` once for every ``VERIFY_ROWS`` partners, which stream
    past it."""
    salts = F.ceil(F.count("*") / VERIFY_ROWS).cast("int")
    counted = pairs.groupBy("a").agg(salts.alias("salts"))
    hubs = counted.select(
        F.col("a").alias("digest"),
        "a",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(True).alias("hub"),
    )
    partners = pairs.join(counted, "a").select(
        F.col("b").alias("digest"),
        "a",
        F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"),
        F.lit(False).alias("hub"),
    )
    wanted = hubs.unionByName(partners).join(reps, "digest").select(
        "digest", F.col("rep_key").alias("d"), "a", "salt", "hub"
    )
    wanted = staged(wanted, "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in text_batches(batches, "text"):
            found = shingles.sets([t or "" for t in batch.column("text").to_pylist()])
            wanted = batch.column("digest").to_pylist()
            # A key is a hash; only the set that was indexed counts.
            kept = [len(x) > 0 and digest(x) == w for x, w in zip(found, wanted)]
            items = pa.array([x.tobytes() for x in found], pa.binary())
            columns = [batch.column(c) for c in ("a", "salt", "hub", "digest")]
            yield pa.RecordBatch.from_arrays(
                [*columns, items], ["a", "salt", "hub", "b", "items"]
            ).filter(pa.array(kept, pa.bool_()))

    # By the key of id and text: rows with a null or repeated id are not fetched for each other.
    keys = wanted.select(F.col("d").alias("key")).distinct()
    texts = id_filter(docs.select("key", "text"), keys, "key")
    texts = texts.join(wanted, F.expr("key = d"))
    dealt = texts.select("a", "salt", "hub", "digest", "text").mapInArrow(
        sets, "a long, salt int, hub boolean, b long, items binary"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for a, hub, b, items in zip(
                *(batch.column(c).to_pylist() for c in ("a", "hub", "b", "items"))
            ):
                found = np.frombuffer(items, dtype=np.uint64)
                if hub:
                    own = found
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(found) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    dealt = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("hub"))
    return staged(dealt.mapInArrow(tidied(verify), "a long, b long").distinct(), "links")


def linked_pairs(sets: list[np.ndarray], split: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the sets that link: of the first ``split`` with the others, or, when
    there are no others, among themselves with i < j. Shared shingles are counted as products
    of 0/1 matrices of a bounded number of columns; counts stay exact in float32."""
    sizes = np.array([len(x) for x in sets])
    alone = split == len(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = times > 1  # shingles of one set alone are shared by none
    kept = met[number]
    owner, number = owner[kept], (np.cumsum(met) - 1)[number[kept]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    right = slice(0, split) if alone else slice(split, len(sets))
    both = np.zeros((split, len(sizes[right])), dtype=np.float32)
    for low in range(0, int(met.sum()), _COLUMNS):
        a, b = np.searchsorted(number, [low, low + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        held[owner[a:b], number[a:b] - low] = 1
        both += held[:split] @ held[right].T
    both = both.astype(np.int64)
    near = 100 * both >= percent * (sizes[:split, None] + sizes[right][None, :] - both)
    i, j = np.nonzero(np.triu(near, 1) if alone else near)
    return i, j if alone else j + split


def _links_within(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """All links (a, b), a < b, between the sets of each component, with the copies of either
    (ca, cb): every pair is compared.

    ``members`` has one row per set: root, digest, rep_key (key of one document that has it),
    copies and blocks. Sets are computed once; each is then copied to the ``blocks`` pairs of blocks that
    it is in, and each pair of sets meets in exactly one of them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in text_batches(batches, "text"):
            found = shingles.sets([t or "" for t in batch.column("text").to_pylist()])
            items = pa.array([x.tobytes() for x in found], pa.binary())
            names = ["root", "blocks", "digest", "copies"]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, items], [*names, "items"])

    wanted = members.withColumnRenamed("rep_key", "key")
    texts = id_filter(docs.select("key", "text"), wanted.select("key"), "key")
    texts = texts.join(wanted, "key").select("root", "blocks", "digest", "copies", "text")
    kinds = "root long, blocks int, digest long, copies long, items binary"
    made = texts.mapInArrow(tidied(sets), kinds)
    made = made.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = made.withColumn("other", other).select(
        "root",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "digest",
        "copies",
        "items",
    )

    def judged(key: list, held: dict[int, tuple[int, int, bytes]]):
        # Left block first: where there are two, the pairs within either are met elsewhere.
        names = sorted(held, key=lambda d: (held[d][0], d))
        split = sum(held[d][0] == key[1] for d in names)
        if len(names) < 2 or key[1] != key[2] and split in (0, len(names)):
            return
        i, j = linked_pairs(
            [np.frombuffer(held[d][2], dtype=np.uint64) for d in names], split, percent
        )
        copies = np.array([held[d][1] for d in names], dtype=np.int64)
        names = np.array(names, dtype=np.int64)
        i, j = np.where(names[i] < names[j], (i, j), (j, i))
        columns = [names[i], names[j], copies[i], copies[j]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "ca", "cb"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            for *own, block, name, copies, items in zip(*columns):
                if own != key:
                    if held:
                        yield from judged(key, held)
                    key, held = own, {}
                held[name] = block, copies, items
        if held:
            yield from judged(key, held)

    key = ["root", "i", "j"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(tidied(compare), "a long, b long, ca long, cb long")


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
) -> tuple[DataFrame, DataFrame]:
    """Classes of near-duplicate texts, and all their links.

    Two texts link when 100 * shared shingles >= percent * shingles of either. Returns

    - the rows of ``near_classes`` with n_links, the number of other rows that the row links
      with, rows of an equal set included; none for a text without words;
    - all links, pairs (a, b) of digests with a < b. Texts with equal sets have one digest and
      are not expanded into pairs.

    Sets link only within a component. One of two sets has the link that joined them; in larger
    ones every pair of sets is compared, in blocks (see ``_links_within``).
    """
    keyed = _keyed(docs)
    found, _, reps = near_classes(docs, words, percent)
    sized = (
        found.where("component is not null")
        .groupBy("component", "digest")
        .agg(F.first("n_shingles").alias("n"))
        .groupBy("component")
        .agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
        .where("sets > 1")
    )
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("all") / BLOCK_SHINGLES))
    placed = found.select("digest", F.col("component").alias("root")).distinct()
    placed = placed.join(
        sized.select(F.col("component").alias("root"), "sets", blocks.cast("int").alias("blocks")),
        "root",
    )
    placed = placed.join(reps, "digest")
    placed = placed.select("root", "digest", "rep_key", "copies", "sets", "blocks")
    placed = staged(placed, "placed")
    # Two sets of one component, and no third, have the link that joined them.
    two = F.array_sort(F.collect_list(F.struct("digest", "copies")))
    pairs = placed.where("sets = 2").groupBy("root").agg(two.alias("x"))
    pairs = pairs.selectExpr(
        "x[0].digest as a", "x[1].digest as b", "x[0].copies as ca", "x[1].copies as cb"
    )
    more = _links_within(keyed, placed.where("sets > 2").drop("sets"), words, percent)
    links = staged(pairs.union(more), "all-links")
    ends = links.selectExpr("a as digest", "cb as c").union(links.selectExpr("b", "ca"))
    others = ends.groupBy("digest").agg(F.sum("c").alias("others"))
    counts = reps.join(others, "digest", "left").select(
        "digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    found = found.join(counts, "digest", "left")
    return found.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")), links.select("a", "b")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("key"),
        "text",
    )


def near_classes(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of near-duplicate texts, without the links that change no class. Returns

    - one row per row of ``docs``: doc_id, key (xxhash64 of id and text), n_shingles, digest of
      its shingle set (null without words), and component_id, the smallest doc_id that links
      reach, null ids apart; a text without words links with nothing and is its own component;
      ``component``, the same class as a digest (null without words);
    - links found on the way, pairs (a, b) of digests: enough to connect every component;
    - one row per digest: rep (its least doc_id), rep_key (the key of one of its rows), copies.

    Signatures (see ``Signatures``) make every pair of linked sets meet. Of the sets that share
    one, the most central (fewest rare shingles of its own, then least digest) is first compared
    with all others; the links found join sets into components. Only pairs that still lie in
    different components are then compared, all of them: a pair within a component adds nothing.
    Prefix, order and verification cover all texts; nothing is capped or sampled.
    """
    keyed = _keyed(docs)
    counts = shingle_counts(keyed, words)
    indexed = staged(_indexed(keyed, counts, words, percent), "indexed")
    rows = indexed.where("sig is null").select("doc_id", "key", "digest", "n")
    reps = staged(
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.min("key").alias("rep_key"),
            F.count("*").alias("copies"),
        ),
        "reps",
    )
    sigs = indexed.where("sig is not null").select("sig", "digest", "n", "rare", "wide", "rares")
    # Signatures of one set alone go first; all are moved once, for the two ends and the rows.
    alike = Window.partitionBy("sig")
    ends = {"low": F.min("digest").over(alike), "high": F.max("digest").over(alike)}
    members = sigs.withColumns(ends).where("low <> high").drop("low", "high")
    members = staged(members.distinct(), "met")
    met = (
        members.where("wide and rare")
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list("sig")).alias("met"))
    )
    mets = F.when(F.col("met").isNull(), 0).otherwise(F.size("met"))
    members = members.join(met, "digest", "left").select(
        "sig",
        "digest",
        "n",
        "wide",
        "rares",
        mets.alias("mets"),
        F.when(mets <= MET_KEPT, F.coalesce("met", F.array().cast("array<bigint>"))).alias("met"),
    )
    members = staged(members, "members")
    # The most central set: the fewest rare shingles that no other set has.
    lonely = F.when(F.col("wide"), F.col("rares") - F.col("mets")).otherwise(0)
    central = F.struct(lonely.alias("lonely"), "digest")
    hubs = members.groupBy("sig").agg(F.min(central).alias("h")).select("sig", "h.digest")
    hubs = members.join(hubs, ["sig", "digest"])
    star = (
        members.alias("m")
        .join(hubs.alias("h"), "sig")
        .where("m.digest <> h.digest")
        .where(_may_link("m", "h", percent))
        .select(*_pair_columns("h", "m"))
        .distinct()
    )
    star = staged(star, "star")
    near = staged(_enough_shared(star, members, percent), "pairs")
    links = _verified(near, keyed, reps, words, percent)
    joined = staged(components(links), "components")
    placed = members.join(joined.withColumnRenamed("node", "digest"), "digest", "left")
    placed = placed.withColumn("root", F.coalesce("root", "digest"))
    open_sigs = (
        placed.groupBy("sig")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low <> high")
        .select("sig")
    )
    placed = staged(placed.join(open_sigs, "sig", "left_semi"), "open")
    rest = (
        placed.alias("x")
        .join(placed.alias("y"), "sig")
        .where("x.digest < y.digest and x.root <> y.root")
        .where(_may_link("x", "y", percent))
        .select(*_pair_columns("x", "y"))
        .distinct()
    )
    either = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = staged(rest.join(either, ["a", "b"], "left_anti"), "rest")
    near = staged(_enough_shared(rest, placed, percent), "pairs")
    more = _verified(near, keyed, reps, words, percent)
    links = links.union(more)
    forest = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = staged(components(forest.union(more)), "components")
    named = final.join(reps, final.node == reps.digest)
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = staged(
        final.join(smallest, "root").select(
            F.col("node").alias("digest"), F.col("root").alias("component"), "component_id"
        ),
        "classes",
    )
    worded = (
        rows.where("digest is not null")
        .join(reps, "digest")
        .join(classes, "digest", "left")
        .select(
            "doc_id",
            "key",
            F.col("n").alias("n_shingles"),
            "digest",
            # The class holds this text, so without links it is that of its equal sets.
            F.when(F.col("component").isNull(), F.col("rep"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
            F.coalesce("component", "digest").alias("component"),
        )
    )
    none = F.lit(None).cast("long")
    empty = rows.where("digest is null").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        none.alias("digest"),
        F.col("doc_id").alias("component_id"),
        none.alias("component"),
    )
    return worded.unionByName(empty), links, reps


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, one of each class of near duplicates: the smallest doc_id, nulls
    last. Texts without words stay, but rows equal in id and text count as one document."""
    found, _, _ = near_classes(docs, words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("x")
    kept = found.where("component is not null").groupBy("component").agg(first)
    keys = kept.select("x.key").union(found.where("component is null").select("key").distinct())
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    return (
        keyed.join(keys.withColumnRenamed("key", "_key"), "_key")
        .dropDuplicates(["_key"])
        .select(docs.columns)
    )
