"""Byte-level BPE by pre-tokens: how a text falls into pre-tokens, and which strings are one token."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import regex
from tokenizers import Tokenizer

# Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters whose classes are settled in every Unicode version in use: Latin letters, signs and
#: general punctuation. Text with others goes through the tokenizer's own splitter.
SETTLED = r"[\x00-ɏ‐-‧]*"

LONGEST_KEPT = 64  # characters of a pre-token that is remembered
MOST_KEPT = 1 << 19  # remembered pre-tokens per task
CHUNK = 1 << 16  # characters split at once


def read_tokenizer(path: str) -> str:
    """The tokenizer file's JSON, read once by the driver and sent along; some megabytes."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def chunks(text: str, most: int = CHUNK) -> Iterator[str]:
    """The text in pieces that tokenize alone as they do together.

    A cut stands between a character that is no white space and one that is: no pre-token spans
    that place, and the look-ahead for white space at the end of a run sees the same. A text
    without such a place in reach stays whole up to the next one.
    """
    start = 0
    while len(text) - start > most:
        found = _CUT.search(text, start + most)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


_CUT = regex.compile(r"[^\s\x1c-\x1f\x85](?=[\t\n\r ])")


class Pretokens:
    """Splits texts and remembers what each pre-token becomes.

    ``value`` maps the ids of one pre-token to what is remembered. ``known`` has the values of
    strings proved to be one token; only others are merged, in batches, by the library.
    Special strings in texts are special tokens, as the library has it by default.
    """

    def __init__(self, tokenizer: Tokenizer, value, known: dict | None = None):
        self._tokenizer = tokenizer
        self._value = value
        self._known = known or {}
        self._seen: dict = {}
        self._pattern = regex.compile(PATTERN)
        self._settled = regex.compile(SETTLED)
        added = tokenizer.get_added_tokens_decoder()
        self._special = {t.content: i for i, t in added.items()}
        alternatives = sorted(self._special, key=len, reverse=True)
        self._specials = regex.compile(
            "(" + "|".join(map(regex.escape, alternatives)) + ")" if alternatives else r"((?!))"
        )

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self._settled.fullmatch(text):
            return self._pattern.findall(text)
        pieces = self._tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in pieces]

    def _merge(self, missing: set[str]) -> dict:
        order = list(missing)
        encoded = self._tokenizer.encode_batch(order, add_special_tokens=False)
        return {p: self._value(e.ids) for p, e in zip(order, encoded)}

    def values(self, text: str) -> Iterator[Iterable]:
        """What the pre-tokens of the text become, chunk by chunk, in order."""
        for i, part in enumerate(self._specials.split(text)):
            if i % 2:
                yield [self._value([self._special[part]])]
                continue
            for chunk in chunks(part):
                pieces = self.split(chunk)
                known, seen = self._known, self._seen
                missing = {p for p in set(pieces) if p not in known and p not in seen}
                if len(seen) + len(missing) > MOST_KEPT:
                    seen.clear()
                    missing = {p for p in set(pieces) if p not in known}
                if missing:
                    seen.update(self._merge(missing))
                yield [known[p] if p in known else seen[p] for p in pieces]
                for p in missing:
                    if len(p) > LONGEST_KEPT:
                        del seen[p]


def single_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Vocabulary strings proved to be one token where they stand as a pre-token.

    Each entry of the vocabulary is decoded; it qualifies if its bytes are UTF-8, the tokenizer's
    splitter leaves it whole and encoding it alone yields exactly its own id. Merges never cross
    pre-tokens, so such a string counts one wherever the splitter yields it.
    """
    ids = [i for i in tokenizer.get_vocab(with_added_tokens=False).values()]
    texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    kept = [(i, t) for i, t in zip(ids, texts) if t and "�" not in t]
    encoded = tokenizer.encode_batch([t for _, t in kept], add_special_tokens=False)
    whole = tokenizer.pre_tokenizer.pre_tokenize_str
    return frozenset(
        t for (i, t), e in zip(kept, encoded) if e.ids == [i] and len(whole(t)) == 1
    )
