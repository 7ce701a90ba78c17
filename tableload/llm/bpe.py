"""BPE encoding and decoding: a segment tree over the ranks of a word's adjacent pairs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import by_rows, tidied
from .pretokens import read_tokenizer

# Fixed value: the pattern of the tokenizer file, whose matches are the words to merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: Characters of one class in every Unicode version in use, which composition leaves alone and
#: whose lower case needs no context. Text with others is normalised and split by the library.
SETTLED = regex.compile(r"[\x00-\x1b\x20-ɏ‐-‧]*")

LONGEST_KEPT = 64  # characters of a string whose ids are remembered
MOST_KEPT = 1 << 18  # remembered strings per task
CHUNK = 1 << 18  # characters of a piece of a long text
TOGETHER = 1 << 20  # characters whose strings are merged together
_WIDEST = 64  # bytes of words merged together; longer ones are merged one by one
_ROWS = 1 << 12  # words whose trees lie side by side
_SPACE = regex.compile(r"[\t\n\r ]")
_NONE = 1 << 62
_PLACE = (1 << 32) - 1


class PairTree:
    """Segment tree over the adjacent pairs of a row of symbols.

    A leaf holds its pair's rank and place as one number, an inner node the least of its two
    children, so the root is the leftmost pair of the lowest rank.
    """

    def __init__(self, keys: list[int]):
        self._leaves = 1 << max(len(keys) - 1, 0).bit_length()
        empty = [_NONE] * (self._leaves - len(keys))
        self._nodes = [_NONE] * self._leaves + keys + empty
        for at in range(self._leaves - 1, 0, -1):
            self._nodes[at] = min(self._nodes[2 * at], self._nodes[2 * at + 1])

    def least(self) -> int:
        return self._nodes[1]

    def put(self, place: int, key: int) -> None:
        """Changes one leaf and the nodes above it, up to the first that stays the same."""
        nodes, at = self._nodes, place + self._leaves
        nodes[at] = key
        while at > 1:
            other = nodes[at ^ 1]
            least = key if key < other else other
            at >>= 1
            if nodes[at] == least:
                return
            nodes[at] = key = least


def merged(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The symbols after all merges: while some pair has a rank, the leftmost pair of the lowest
    rank becomes ``made[rank]``. O(log n) for each merge."""
    n = len(symbols)
    if n < 2:
        return symbols

    def key(left: int, right: int) -> int:
        rank = ranks.get((symbols[left], symbols[right]))
        return _NONE if rank is None else rank << 32 | left

    symbols = list(symbols)
    tree = PairTree([key(i, i + 1) for i in range(n - 1)])
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree.least()) != _NONE:
        at = least & _PLACE
        gone = following[at]
        symbols[at] = made[least >> 32]
        symbols[gone] = -1
        after = following[at] = following[gone]
        if gone < n - 1:
            tree.put(gone, _NONE)
        if after < n:
            before[after] = at
            tree.put(at, key(at, after))
        else:
            tree.put(at, _NONE)
        if before[at] >= 0:
            tree.put(before[at], key(before[at], at))
    return [s for s in symbols if s >= 0]


class PairRanks:
    """The rank of pairs of symbols, for many at once, and the symbol each rank makes."""

    def __init__(self, ranks: dict[tuple[int, int], int], made: list[int]):
        pairs = np.array(sorted((a << 32 | b, r) for (a, b), r in ranks.items()), dtype=np.int64)
        self._keys, self._ranks = pairs.reshape(-1, 2).T
        self.made = np.array(made, dtype=np.int64)

    def of(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place as one number, ``_NONE`` for pairs without a rank."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
        return np.where(self._keys[at] == wanted, self._ranks[at] << 32 | place, _NONE)


def merged_together(
    symbols: np.ndarray, lengths: np.ndarray, ranks: PairRanks
) -> tuple[np.ndarray, np.ndarray]:
    """``merged`` for many words at once: all that are left, in order, and each word's number.

    ``symbols`` has a word in each row, ``lengths`` say how much of it counts. The words' segment
    trees lie side by side, one node of all of them in a row; every round merges one pair in each
    word that has one left, with the same point updates as ``PairTree``.
    """
    n, width = symbols.shape
    leaves = 1 << (width - 1).bit_length()
    symbols = np.ascontiguousarray(symbols.T)
    places = np.arange(width)[:, None]
    symbols[places >= lengths] = -1
    nodes = np.full((2 * leaves, n), _NONE)
    keys = ranks.of(symbols[:-1], symbols[1:], places[:-1])
    nodes[leaves : leaves + width - 1] = np.where(places[1:] < lengths, keys, _NONE)
    for at in range(leaves - 1, 0, -1):
        np.minimum(nodes[2 * at], nodes[2 * at + 1], out=nodes[at])
    after = np.repeat(places + 1, n, axis=1)
    before = np.repeat(places - 1, n, axis=1)

    def put(place: np.ndarray, words: np.ndarray, key) -> None:
        at = place + leaves
        nodes[at, words] = key
        for _ in range(leaves.bit_length() - 1):
            at = at >> 1
            nodes[at, words] = np.minimum(nodes[2 * at, words], nodes[2 * at + 1, words])

    words = np.flatnonzero(nodes[1] != _NONE)
    while len(words):
        least = nodes[1, words]
        at = least & _PLACE
        gone = after[at, words]
        symbols[at, words] = ranks.made[least >> 32]
        symbols[gone, words] = -1
        then = after[at, words] = after[gone, words]
        put(gone, words, _NONE)
        more = then < lengths[words]
        place, word, right = at[more], words[more], then[more]
        before[right, word] = place
        put(place, word, ranks.of(symbols[place, word], symbols[right, word], place))
        put(at[~more], words[~more], _NONE)
        left = before[at, words]
        some = left >= 0
        place, word, right = left[some], words[some], at[some]
        put(place, word, ranks.of(symbols[place, word], symbols[right, word], place))
        words = words[nodes[1, words] != _NONE]
    alive = symbols.T >= 0
    return symbols.T[alive], alive.sum(1)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, the others in order the
    letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encodes and decodes as the tokenizer file prescribes.

    Takes files of one kind: white space dropped and letters lower-cased by the normaliser, words
    by ``PATTERN``, byte-level symbols with a mark on a word's last, no decoder. Others raise
    ValueError.
    """

    def __init__(self, text: str):
        file = json.loads(text)
        model, splits = file["model"], (file["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        steps = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        plain = not (model.get("dropout") or model.get("unk_token") or model.get("byte_fallback"))
        if (
            model["type"] != "BPE"
            or not plain
            or not model.get("end_of_word_suffix")
            or steps != ["NFC", "Replace", "Lowercase"]
            or splits[0].get("pattern") != {"Regex": PATTERN}
            or file["decoder"] is not None
        ):
            raise ValueError("not a file of lower-cased words with end marks")
        self._library = Tokenizer.from_str(text)
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self._inner = np.array([vocab[c] for c in letters])
        self._last = np.array([vocab[c + mark] for c in letters])
        self._bytes = {c: b for b, c in enumerate(letters)}
        self._ranks: dict[tuple[int, int], int] = {}
        self._made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._ranks[vocab[left], vocab[right]] = rank
            self._made.append(vocab[left + right])
        self._pairs = PairRanks(self._ranks, self._made)
        self._special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ordered = sorted(self._special, key=len, reverse=True)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")")
        self._pattern = regex.compile(PATTERN)
        named = vocab | self._special
        self._names: list[str | None] = [None] * (max(named.values()) + 1)
        for name, i in named.items():
            self._names[i] = name
        self._seen: dict[str, bytes] = {}

    def _words(self, string: str) -> list[bytes]:
        """The words of a normalised string without white space, in UTF-8."""
        if string.isascii() and string.isalpha():
            return [string.encode()]
        if SETTLED.fullmatch(string):
            return [w.encode() for w in self._pattern.findall(string)]
        found = self._library.pre_tokenizer.pre_tokenize_str(string)
        return [bytes(map(self._bytes.__getitem__, letters)) for letters, _ in found]

    def _merge(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different words: by length, so that words merged together are alike long;
        long ones alone."""
        out: dict[bytes, bytes] = {}
        by_size: dict[int, list[bytes]] = {}
        for w in words:
            by_size.setdefault((len(w) - 1).bit_length(), []).append(w)
        for size, alike in by_size.items():
            for at in range(0, len(alike), _ROWS):
                part = alike[at : at + _ROWS]
                if 1 << size > _WIDEST:
                    out.update((w, self._long_word(w)) for w in part)
                else:
                    out.update(zip(part, self._short_words(part, 1 << size)))
        return out

    def _long_word(self, word: bytes) -> bytes:
        letters = np.frombuffer(word, np.uint8)
        symbols = self._inner[letters].tolist()
        symbols[-1] = int(self._last[letters[-1]])
        return np.array(merged(symbols, self._ranks, self._made), dtype="<u4").tobytes()

    def _short_words(self, words: list[bytes], width: int) -> Iterator[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        flat = self._inner[letters]
        flat[ends - 1] = self._last[letters[ends - 1]]
        symbols = np.full((len(words), max(width, 2)), -1)
        row = np.repeat(np.arange(len(words)), lengths)
        symbols[row, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
        ids, counts = merged_together(symbols, lengths, self._pairs)
        data, end = ids.astype("<u4").tobytes(), 0
        for n in (4 * counts).tolist():
            yield data[end : end + n]
            end += n

    def _strings(self, text: str) -> list[str]:
        """The normalised text cut at white space."""
        if SETTLED.fullmatch(text):
            return text.lower().split()
        return self._library.normalizer.normalize_str(text).split(" ")

    def _learn(self, strings: set[str]) -> list[str]:
        """Merges what is not remembered of these strings, all together. Returns those of them
        that are too long to be remembered beyond their run."""
        seen = self._seen
        missing = strings.difference(seen)
        if len(seen) + len(missing) > MOST_KEPT:
            seen.clear()
            missing = strings
        words = {s: self._words(s) for s in missing}
        ids = self._merge(list({w for found in words.values() for w in found}))
        seen.update((s, b"".join([ids[w] for w in found])) for s, found in words.items())
        return [s for s in missing if len(s) > LONGEST_KEPT]

    def _chunks(self, texts: list[str]) -> Iterator[tuple[int, str, int | None]]:
        """(number of the text, piece of it, id if the piece is a special token's string)."""
        for number, text in enumerate(texts):
            for i, part in enumerate(self._specials.split(text) if self._special else [text]):
                if i % 2:
                    yield number, part, self._special[part]
                else:
                    yield from ((number, chunk, None) for chunk in chunks(part))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. The strings of special
        tokens are those tokens, as the library has it by default."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def flush() -> None:
            long = self._learn(set().union(*(f for _, f in held if isinstance(f, list))))
            seen = self._seen
            for number, found in held:
                if isinstance(found, list):
                    found = b"".join([seen[s] for s in found])
                out[number].append(found)
            for s in long:
                del seen[s]
            held.clear()

        for number, chunk, special in self._chunks(texts):
            if special is not None:
                held.append((number, np.array([special], dtype="<u4").tobytes()))
                continue
            held.append((number, self._strings(chunk)))
            size += len(chunk)
            if size > TOGETHER:
                flush()
                size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> str:
        """The names of the ids, special ones too, with spaces between; ids that name nothing are
        left out."""
        names, most = self._names, len(self._names)
        found = np.frombuffer(ids, dtype="<u4").tolist()
        kept = [names[i] for i in found if i < most]
        return " ".join([n for n in kept if n is not None])


def chunks(text: str, most: int = CHUNK) -> Iterator[str]:
    """The text in pieces of about ``most`` characters that begin with white space. Words never
    hold white space and no letter composes with white space before it, so the pieces encode as
    the whole does. Text without white space stays whole."""
    start = 0
    while len(text) - start > most:
        found = _SPACE.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


@lru_cache(maxsize=1)
def _tokenizer(text: str) -> WordBpe:
    """One tokenizer for each Python process, so that its tasks share what it remembers."""
    return WordBpe(text)


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the id, ``n_tokens`` and ``ids``, the token ids of the whole text as
    little-endian unsigned 32-bit integers, by the tokenizer file at ``path`` (read once by the
    driver, some megabytes).

    A null or empty text has no ids. Null and repeated ids stay as they are, one row for each
    input row; an empty table gives no rows; further columns are left out. Runs of about a
    megabyte of texts are encoded at once, a longer text in pieces; what a task remembers of
    earlier strings has a bound. A string without white space is merged as a whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    WordBpe(shared.value)  # another kind of file fails here, not in tasks
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(texts: list[str]):
        ids = _tokenizer(shared.value).encode(texts)
        return [len(i) // 4 for i in ids], ids

    return _mapped(
        docs.select(id_column, "text"),
        run,
        f"`{id_column}` {id_type}, n_tokens long, ids binary",
        [pa.int64(), pa.binary()],
    )


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of the token ids in their column ``ids`` (which must be
    the last; null: none), by the tokenizer file at ``path``. Special tokens are kept, and names
    stand with a space between, as the library has it for files without a decoder."""
    shared = rows.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(ids: list[bytes]):
        texts = list(map(_tokenizer(shared.value).decode, (i or b"" for i in ids)))
        return ids, texts

    schema = ", ".join([*kept, "decoded string"])
    return _mapped(rows, run, schema, [pa.binary(), pa.string()])


def _mapped(rows: DataFrame, function, schema: str, types: list[pa.DataType]) -> DataFrame:
    """``by_rows`` over the last column of ``rows``, the others passing through."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = rows.columns[:-1]
    passed = to_arrow_schema(rows.select(kept).schema)
    names = [c.split()[0].strip("`") for c in schema.split(", ")][len(kept) :]
    arrow = pa.schema([*passed, *zip(names, types)])
    return rows.mapInArrow(tidied(by_rows(function, rows.columns, arrow)), schema)
