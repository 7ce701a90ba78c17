"""BPE, source divergence and collocations against the library and brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import difference
from tokenizers import Tokenizer

from tableload.llm import bpe, collocations as mining, divergence
from tableload.llm.bpe import (
    PairRanks,
    PairTree,
    WordBpe,
    decode_ids,
    encode_texts,
    merged,
    merged_together,
)
from tableload.llm.collocations import Proposals, collocations, phrase_counts
from tableload.llm.divergence import source_divergence
from tableload.llm.queries import COLLOCATION_SQL, DIVERGENCE_SQL

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    "Hello <|endoftext|> World's<|startoftext|>123 don't",
    "<|STARTOFTEXT|> <|endoftext|><|endoftext|>",
    "Σίσυφος ΟΔΟΣ ΣΑΣ. İstanbul ǅ ﬁne",
    "é ́x Ạ̊ 한글 각",
    "a\x1cb \x85 c d e f \x1c\x1d",
    "漢字かな交じり文 １２３ ² ½ ⅷ 👩‍👩‍👧 🏳️‍🌈 ☃",
    "'S 'stop we'LL I'Ve ''ve \t\n\v\f\r",
    "x" * 5000 + "y" * 300,
    "!" * 3000 + "?!" * 700,
    "\x00\x01\x7f ퟿",
]


def test_pair_tree_root_is_the_leftmost_least():
    rng = random.Random(3)
    for n in (1, 2, 3, 8, 13):
        keys = [rng.randrange(4) << 32 | i for i in range(n)]
        tree = PairTree(list(keys))
        for _ in range(60):
            at = rng.randrange(n)
            keys[at] = rng.choice([bpe._NONE, rng.randrange(4) << 32 | at])
            tree.put(at, keys[at])
            assert tree.least() == min(keys)


def test_merges_are_leftmost_of_the_lowest_rank():
    rng = random.Random(4)
    for _ in range(300):
        ranks, made = {}, []
        for rank in range(rng.randrange(1, 12)):
            known = range(3 + rank)
            pair = rng.choice(known), rng.choice(known)
            if pair not in ranks:
                ranks[pair] = len(made)
                made.append(3 + len(made))
        symbols = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        plain = list(symbols)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]
            if not found:
                break
            rank, i = min(found)
            plain[i : i + 2] = [made[rank]]
        assert merged(symbols, ranks, made) == plain


def test_words_merged_together_merge_as_they_do_alone():
    rng = np.random.default_rng(5)
    ranks, made = {}, []
    for rank in range(60):
        pair = tuple(int(x) for x in rng.integers(0, 4 + rank, 2))
        if pair not in ranks:
            ranks[pair] = len(made)
            made.append(4 + len(made))
    pairs = PairRanks(ranks, made)
    for width in (2, 3, 8, 16, 33):
        lengths = rng.integers(1, width + 1, 400)
        symbols = rng.integers(0, 4, (400, width))
        expected = [merged(row[:n].tolist(), ranks, made) for row, n in zip(symbols, lengths)]
        ids, counts = merged_together(symbols, lengths, pairs)
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_encoding_is_the_librarys(spark, docs, doc_rows, no_docs):
    library = Tokenizer.from_file(PATH)
    extra = [(900 + i, t, None, None, None, None, None) for i, t in enumerate(AWKWARD)]
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema))

    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)

    rows = decode_ids(encode_texts(frame, PATH), PATH).collect()
    got = Counter(
        (r.doc_id, r.n_tokens, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in rows
    )
    assert got == Counter((r[0], *expected(r[1])) for r in doc_rows + extra)
    assert decode_ids(encode_texts(no_docs, PATH), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None)], "x int, ids binary")
    assert [(r.x, r.decoded) for r in decode_ids(nothing, PATH).collect()] == [(1, "")]


def test_random_texts_encode_as_the_librarys():
    library = Tokenizer.from_file(PATH)
    own = WordBpe(open(PATH, encoding="utf-8").read())
    rng = random.Random(7)
    letters = "abcdeéÜßſKÅ '.,<|>\n\t\x1c\x85 12²漢ΣσΆ̣ǅİ🙂"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(own.encode([text])[0]) == library.decode(ids, skip_special_tokens=False)
    long = " ".join("".join(rng.choice(letters) for _ in range(30)) for _ in range(3000))
    monolith = own.encode([long])[0]
    assert b"".join(own.encode(list(bpe.chunks(long, 500)))) == monolith
    assert list(np.frombuffer(monolith, "<u4")) == library.encode(long, add_special_tokens=False).ids


def test_long_words_and_space_runs_encode():
    library = Tokenizer.from_file(PATH)
    own = WordBpe(open(PATH, encoding="utf-8").read())
    for text in ("thing" * 40_000, " " * 1_000_000 + "a", "\n\t" * 300_000, "é" * 50_000):
        ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        WordBpe(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def _mixed_rows(n=900):
    """Documents of a few languages and sources, one of which holds a third of them."""
    rng = random.Random(11)
    words = ["the", "of", "Big", "apple", "é", "naïve", "x-y", "a1b", "漢字", *(f"w{i}q" for i in range(60))]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", *(f"s{j}" for j in range(7)), None])
        lang = rng.choice(["en", "en", "fr", None, ""])
        text = rng.choice([None, "", " .,; "]) if i % 40 == 0 else " ".join(
            rng.choice(words[: 9 + (i % 5) * 15]) + rng.choice(["", "", "", ".", ",", "!\n", "\t"])
            for _ in range(rng.randrange(1, 60))
        )
        rows.append((i // 2, text, lang, source, 0, "k", 1))
    rows += [(None, "the end", "zz", "solo", None, None, None), (5, None, "yy", "none", 0, "", 0)]
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    from conftest import DOCS

    return spark.createDataFrame(_mixed_rows(), DOCS)


def _duck(frame):
    import duckdb

    con = duckdb.connect()
    table = frame.toArrow()
    con.register("documents", table)
    return con


def _divergence(rows, least, top):
    """The definition, word by word."""
    group_n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        group_n[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for l, s in groups if l == lang)
        whole = sum((group_n[lang, s] for s in sources), Counter())

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept)
            return [1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept]

        p, q = {s: shares(group_n[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s]
            terms = [
                (b - a, t.encode(), t)
                for t, a, b in zip(kept, p[s], q)
                if group_n[lang, s][t] and a > b
            ]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, _, item) in enumerate(sorted(found)[:most], 1):
                    out.add((lang, s, part, item, -value, rank))
    return out


@pytest.mark.parametrize(("group_block", "term_block"), [(64, 1024), (2, 7), (3, 1)])
def test_divergence_is_the_definitions(mixed, group_block, term_block):
    got = source_divergence(mixed, 12, 5, group_block, term_block).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == _divergence(_mixed_rows(), 12, 5)


def test_divergence_matches_sql_and_takes_odd_tables(spark, mixed, no_docs):
    assert difference(source_divergence(mixed), _duck(mixed), DIVERGENCE_SQL) is None
    assert source_divergence(no_docs).count() == 0
    few = source_divergence(mixed, least_docs=10_000).collect()
    assert few and {(r.part, r.value) for r in few} == {("pair", 0)}
    schema = source_divergence(no_docs).schema
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [
        ("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"),
        ("value", "bigint"), ("rank", "int"),
    ]


def test_shares_beyond_64_bits_are_exact(spark):
    n, total, terms = 3 * 10**12, 4 * 10**13 + 7, 12345
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    got = row.selectExpr(divergence._share_sql("n", "total")).head()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_term_pieces_join_up():
    text = ("ab " * 100 + "x" * 50 + "é").encode()
    for most in (1, 7, 40, 1000):
        found = [w for p in divergence.pieces(text, most) for w in divergence.TERM.findall(p)]
        assert found == divergence.TERM.findall(text)


def _phrase_counts(rows):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    counts["und" if lang is None else lang][" ".join(w[i : i + size])] += 1
    return counts


@pytest.mark.parametrize(
    "options", [{}, {"sample_every": 1, "sample_count": 1}, {"sample_every": 10**9}, {"filter_bits": 7},
                {"sample_every": 3, "sample_count": 1, "filter_bits": 12}],
)
def test_phrase_counts_are_exact_whatever_the_sample(mixed, options):
    expected = {
        (lang, phrase.count(" ") + 1, phrase, n)
        for lang, counts in _phrase_counts(_mixed_rows()).items()
        for phrase, n in counts.items()
        if n >= 6
    }
    got = phrase_counts(mixed, 6, **options).where("size > 0").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_small_runs_and_flushes_change_nothing(monkeypatch):
    """Runs that cut texts anywhere and counters that hand on all the time, in this process."""
    rows = _mixed_rows(200)
    whole = b".".join((r[1] or "").encode() for r in rows).lower().translate(mining._SIGNS)
    everything = Proposals(10, np.full(16, 2**64 - 1, np.uint64))
    results = []
    for run, held in ((1 << 20, 1 << 20), (5, 3), (64, 1)):
        monkeypatch.setattr(mining, "_HELD", held)
        monkeypatch.setattr(mining._runs, "__defaults__", (run,))
        counter, found = mining._Counter("en", 3, everything, None), Counter()
        for batch in [*counter.add(whole), *counter.flush()]:
            for key, f in zip(*(c.to_pylist() for c in batch.columns)):
                found[key] += f
        results.append(found)
    expected = Counter()
    for counts in _phrase_counts([(0, (r[1] or ""), "en") for r in rows]).values():
        expected.update({f"en\n{p}": n for p, n in counts.items()})
    for found in results:
        assert found.pop("en\n") == sum(n for p, n in expected.items() if " " not in p)
        assert found == expected


def test_collocations_match_sql_and_take_odd_tables(spark, mixed, docs, no_docs):
    assert difference(collocations(mixed), _duck(mixed), COLLOCATION_SQL) is None
    assert difference(collocations(docs), _duck(docs), COLLOCATION_SQL) is None
    assert collocations(no_docs).count() == 0
    # A longer candidate drops the shorter ones, itself dropped or not; ties go by phrase.
    text = "red hot iron. " * 12 + "red hot. " * 5 + "cold steel. " * 12 + "blue sky. " * 12
    rows = spark.createDataFrame([(1, text, "en")], "doc_id int, text string, lang string")
    got = [tuple(r)[1:5] for r in collocations(rows).collect()]
    assert sorted(got) == [
        (1, "blue sky", 12, 12), (2, "cold steel", 12, 12), (3, "red hot iron", 12, 17),
    ]


def test_a_long_text_counts(spark):
    text = "alpha beta gamma " * 150_000
    rows = spark.createDataFrame([(1, text, "a\nb")], "doc_id int, text string, lang string")
    got = {r.phrase: (r.lang, r.a, r.l, r.r, r.n) for r in collocations(rows).collect()}
    assert got["alpha beta gamma"] == ("a\nb", 150_000, 150_000, 150_000, 450_000)
    assert got["gamma alpha beta"] == ("a\nb", 149_999, 150_000, 150_000, 450_000)
