"""The operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableload.llm import ngram_join, toxicity
from tableload.llm.common import components, staged
from tableload.llm.decontaminate import contaminated_windows, drop_contaminated, mark_contaminated
from tableload.llm.itq import link_vectors
from tableload.llm.mixing import mix, mixed_documents
from tableload.llm.ngram_join import Shingles, Signatures, near_duplicates, one_of_each
from tableload.llm.packing import CapacityTree, pack, pack_documents
from tableload.llm.pretokens import Pretokens, chunks, single_tokens
from tableload.llm.quality import fit_quality, keep_good, score_quality
from tableload.llm.secrets import ASSIGN, find_secrets
from tableload.llm.token_counts import count_tokens
from tableload.llm.toxicity import fit_toxicity, score_toxicity
from tableload.llm.url_filter import judge_urls

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b", "", "block")]


def test_components_of_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (60, 50), (7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {i: 1 for i in range(1, 31)} | {
        i: 40 for i in (40, 50, 60)
    }


def test_urls(spark):
    urls = [
        "http://Example.NET/en/1?q", "https://x.example.net/de/#a", "ftp://a.b", "http://za.b/c",
        "http://q.a.b?x", "nothing", None, "", "://", "http://net/", "http://net/", "x://é.net/a/b",
    ]
    pages = spark.createDataFrame(
        [(i, u, "x", 0) for i, u in enumerate(urls)], "page_id int, url string, rule string, best int"
    )
    rules = spark.createDataFrame(RULES, "host string, path string, action string")

    def expected(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [
            (len(h + p), h + p, a)
            for h, p, a in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule = max(fits, default=(0, None, "allow"))
        return host, path, rule[1], rule[2]

    got = judge_urls(pages, rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {
        i: expected(u) for i, u in enumerate(urls)
    }
    assert len(got) == len(urls) and judge_urls(pages.limit(0), rules).count() == 0
    none = rules.limit(0)
    assert {r.verdict for r in judge_urls(pages, none).collect()} == {"allow"}


def test_token_counts_are_the_librarys(spark, docs, doc_rows, no_docs):
    library = Tokenizer.from_file(JSON)
    extra = [(900, "a <|endoftext|> b<|endoftext|>"), (901, "x'll  \t y\n\n z"), (902, "é" * 70000)]
    extra = [(i, t, None, None, None, None, None) for i, t in extra]
    rows = doc_rows + extra
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema))

    def expected(text):
        text = text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        return len(text.encode()), n, n > 512

    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame, JSON).collect())
    assert got == Counter((r[0], *expected(r[1])) for r in rows)
    assert count_tokens(no_docs, JSON).count() == 0


def test_settled_characters_split_as_the_tokenizer_splits():
    library = Tokenizer.from_file(JSON)
    own = Pretokens(library, len)
    for code in [*range(0x250), *range(0x2010, 0x2028)]:
        c = chr(code)
        for text in (f"a{c}b", f" {c}{c} 1{c}", f"{c} {c}", f"!{c}!  {c}"):
            whole = library.pre_tokenizer.pre_tokenize_str(text)
            assert own.split(text) == [text[a:b] for _, (a, b) in whole]
    text = "ab cd\n\n  ef'll " * 9000
    assert sum(map(len, map(own.split, chunks(text, 1000)))) == len(own.split(text))
    single = single_tokens(library)
    assert " the" in single and len(single) > 49_000


def test_capacity_tree_finds_the_best_fit():
    tree, rooms, rng = CapacityTree(37), [], np.random.default_rng(1)
    for row in range(400):
        room = int(rng.integers(1, 38))
        tree.put(room, row)
        rooms.append(room)
        need = int(rng.integers(1, 38))
        best = min((r for r in rooms if r >= need), default=None)
        found = tree.fit(need)
        assert (found[0] if found else None) == best
        if found:
            rooms.remove(best)
    rows = pack([7, 3, 9, 1, 5, 5], 10)
    assert sorted(i for r in rows for i in r) == list(range(6)) and len(rows) == 3


def test_packing_round_trip(docs, doc_rows, no_docs):
    import tiktoken
    from base64 import b64decode

    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size, parts = 256, defaultdict(list)
    rows = pack_documents(docs.coalesce(1), RANKS, size=size, block_tokens=9000).collect()
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u2")
        positions = np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == size and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == 50256).all()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts[doc].append((start, ids[a:b].tolist()))
    whole = defaultdict(list)
    for doc, text, *_ in doc_rows:
        whole[doc] += encoding.encode_ordinary(text or "") + [50256]
    for doc, tokens in whole.items():
        assert sorted(x for _, p in parts[doc] for x in p) == sorted(tokens)
    single = [d for d, n in Counter(r[0] for r in doc_rows).items() if n == 1]
    for doc in single:
        assert [x for _, p in sorted(parts[doc]) for x in p] == whole[doc]
    assert pack_documents(no_docs, RANKS).count() == 0


def _labelled(spark):
    good = ["the house of and with many plain words in it " * 3 + str(i) for i in range(60)]
    bad = [f"BUY!! NOW!! {i} $$$ ### CLICK!! HERE!! %%% &&& " * 4 for i in range(60)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "label")


def test_quality_learns_scores_and_survives_odd_rows(spark, docs, no_docs):
    texts, labels = _labelled(spark)
    model = fit_quality(texts, labels, 20, 20)
    got = {r.doc_id: r.predicted for r in score_quality(texts, model).collect()}
    assert sum(got[i] == int(i < 60) for i in got) >= 118
    odd = score_quality(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert keep_good(docs, model).columns == docs.columns
    assert keep_good(texts, model).count() == sum(got.values())
    none = fit_quality(texts, labels.limit(0))
    assert score_quality(docs, none).count() == docs.count()
    assert score_quality(no_docs, model).count() == 0


def test_toxicity_learns_rare_words(spark, docs, no_docs):
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = list(rng.choice(plain, 40))
        if i % 3 == 0:
            text[rng.integers(40)] = rng.choice(["vile", "awful"])
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.selectExpr("doc_id", "toxic as label")
    model = fit_toxicity(frame, labels.where("doc_id < 300"), shards=2)
    got = {r.doc_id: r.predicted for r in score_toxicity(frame, model).collect()}
    assert sum(got[i] == int(i % 3 == 0) for i in range(300, 400)) >= 95
    assert len(score_toxicity(docs, model).collect()) == docs.count()
    assert score_toxicity(no_docs, model).count() == 0
    untaught = fit_toxicity(frame, labels.limit(0))
    assert {r.score for r in score_toxicity(docs, untaught).collect()} == {0.5}


def test_toxicity_learns_from_the_whole_sample(spark, monkeypatch):
    """9000 rows a label are within the bound: all are learnt from."""
    learnt = []

    def counted(df, name):
        rows = staged(df, name)
        learnt.append(rows.count())
        return rows

    monkeypatch.setattr(toxicity, "staged", counted)
    frame = spark.range(18_000).selectExpr(
        "id as doc_id", "concat('t', id) as text", "cast(id % 2 as int) as label"
    )
    model = fit_toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "label"), epochs=1)
    assert learnt == [18_000] and model.bits == 20


def test_toxicity_state_is_packed_without_loss():
    z, n = np.zeros((2, (1 << 20) + 1))
    z[5::7], n[::3] = np.random.default_rng(0).normal(size=len(z[5::7])), 0.25
    data = toxicity._packed((z, n))
    again = toxicity._unpacked(data, len(z))
    assert (again[0] == z).all() and (again[1] == n).all() and len(data) < z.nbytes / 4


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates(docs, doc_rows, no_docs, size, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        if len(w) < size:
            return frozenset([tuple(w)] if w else [])
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))

    sets = [(i, shingles(t)) for i, t, *_ in doc_rows]
    root = list(range(len(sets)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        least[top(i)].append(doc)
    expected = Counter(
        (d, len(s), min((x for x in least[top(i)] if x is not None), default=None) if s else d)
        for i, (d, s) in enumerate(sets)
    )
    found, links = near_duplicates(docs, size, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == expected
    kept = one_of_each(docs, size, percent)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        {c for d, n, c in expected if n} | {d for d, n, _ in expected if not n}
    )
    empty, _ = near_duplicates(no_docs, size, percent)
    assert empty.count() == 0 and one_of_each(no_docs, size, percent).count() == 0


@pytest.mark.parametrize("block", [2, 512])
def test_near_duplicates_count_every_link(spark, docs, doc_rows, no_docs, monkeypatch, block):
    """Groups of many different texts: links between members that are no hub count too."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    size, percent = 3, 80
    rng, extra = np.random.default_rng(11), []
    for group, changes in enumerate((1, 4, 7)):
        base = [f"g{group}w{i}" for i in range(100)]
        for _ in range(12):
            copy = list(base)
            for at in rng.choice(100, changes, replace=False):
                copy[at] = f"x{rng.integers(1 << 30)}"
            extra.append(" ".join(copy))
    extra += [extra[0], extra[0].upper(), extra[1]]
    extra = [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(extra)]
    extra += [extra[3], (None, extra[4][1], *extra[4][2:])]

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)) if w)

    rows = doc_rows + extra
    sets = [shingles(t) for _, t, *_ in rows]
    linked = [
        [bool(a and b) and 100 * len(a & b) >= percent * len(a | b) for b in sets] for a in sets
    ]
    expected = Counter((r[0], len(s), sum(x) - bool(s)) for r, s, x in zip(rows, sets, linked))
    pairs = {frozenset([a, b]) for a, x in zip(sets, linked) for b, y in zip(sets, x) if y and a != b}
    found, links = near_duplicates(docs.unionByName(spark.createDataFrame(extra, docs.schema)), size, percent)
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in found.collect()) == expected
    links = [(r.a, r.b) for r in links.collect()]
    assert len(links) == len(set(links)) == len(pairs) and all(a < b for a, b in links)
    assert near_duplicates(no_docs, size, percent)[1].count() == 0


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("frequent", [-100_000, 0, 100_000])
def test_linked_sets_share_a_signature(percent, frequent):
    """Whatever shingles count as frequent: all, some or none."""
    rng = np.random.default_rng(percent)
    counts = rng.integers(0, 60_000, 1 << 8)
    signatures = Signatures(counts, percent, frequent)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        lost = int(rng.integers(0, n // 10 + 1))
        b = np.unique(np.r_[a[rng.permutation(len(a))[lost:]],
                            rng.integers(0, 1 << 63, int(rng.integers(0, n // 10 + 1)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        one, two = (set(np.concatenate(signatures.of(x)).tolist()) for x in (a, b))
        assert one & two


def test_shingles_ignore_neighbouring_texts():
    own = Shingles(3)
    texts = ["a b c d", "", "x", "c d A b c"]
    assert [x.tolist() for x in own.sets(texts)] == [own.sets([t])[0].tolist() for t in texts]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for i in range(60):
        near = base[i % 30] + rng.normal(size=16) * 0.05
        rows.append((100 + i, near.tolist(), int(i % 30 % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [nan] + [1.0] * 15, 0), (303, [inf] * 16, 0),
             (304, rows[0][1], None), (305, [1.0, None] + [0.0] * 14, 0), (306, [], 0), (307, [1.0], 0),
             (308, rows[0][1], 0), (308, rows[0][1], 0), (None, rows[1][1], 1)]
    schema = "vec_id long, embedding array<float>, label int, cid string"
    frame = spark.createDataFrame([(*r, "x") for r in rows], schema)

    def usable(v, label):
        return label is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)

    unit = [np.float32(v).astype(float) if usable(v, x) else None for _, v, x in rows]
    link = [
        [
            a is not None and b is not None and i != j and rows[i][2] == rows[j][2]
            and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
            for j, b in enumerate(unit)
        ]
        for i, a in enumerate(unit)
    ]
    reach = np.array(link) | np.eye(len(rows), dtype=bool)
    for _ in range(7):
        reach = reach @ reach
    ids = [r[0] for r in rows]
    expected = Counter()
    for i, r in enumerate(rows):
        least = min((ids[j] for j in np.flatnonzero(reach[i]) if ids[j] is not None), default=None)
        expected[(ids[i], sum(link[i]), least, ids[i] is not None and ids[i] == least)] += 1
    got = Counter(tuple(r) for r in link_vectors(frame).collect())
    assert got == expected
    assert link_vectors(frame.limit(0)).count() == 0


def test_mixing_meets_targets(docs, doc_rows, no_docs):
    got = mix(docs).collect()
    assert len(got) == len(doc_rows)
    sizes = defaultdict(int)
    for _, text, _, source, *_ in doc_rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left = 1.5 * sum(sizes.values())
    open_ = set(order)
    while left > 1e-6 and open_:  # share out, stop at the cap, share the excess again
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in order)
        for s in order:
            if target[s] >= 2 * sizes[s]:
                target[s] = 2 * sizes[s]
                open_.discard(s)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)
    again = mix(docs.repartition(5))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    assert mix(no_docs).count() == 0
    assert mixed_documents(docs).columns == docs.columns and mixed_documents(no_docs).count() == 0


def test_contamination(spark, docs, doc_rows, no_docs):
    passage = doc_rows[2][1].split()[20:60]
    changed = passage[:20] + ["other"] + passage[21:]
    items = [(1, " ".join(passage)), (2, "\t".join(changed).upper()), (3, "too short"), (4, None), (5, ""),
             (6, " ".join(f"n{i}" for i in range(30)))]
    items = spark.createDataFrame(items, "item_id long, text string")

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    def best(text, item):
        w, i = (text or "").lower().split(), (item or "").lower().split()
        if len(w) < 5 or len(i) < 5:
            return 0
        target, found = shingles(i), 0
        for start in range(max(1, len(w) - len(i) + 1)):
            own = shingles(w[start : start + len(i)])
            both = sum((own & target).values())
            found = max(found, both / (sum(own.values()) + sum(target.values()) - both))
        return found

    expected = {}
    for doc, text, *_ in doc_rows:
        hit = {r.item_id: best(text, r.text) for r in items.collect()}
        expected[(doc, text)] = sorted(i for i, s in hit.items() if s >= 0.8)
    marked = mark_contaminated(docs, items).collect()
    assert {(r.doc_id, r.text): list(r.item_ids) for r in marked} == expected
    assert len(marked) == len(doc_rows) and any(expected.values())
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not expected[(r[0], r[1])] for r in doc_rows)
    assert mark_contaminated(no_docs, items).count() == 0
    assert contaminated_windows(docs.select("doc_id", "text"), items.limit(0)).count() == 0


def test_secrets(spark, docs, no_docs):
    key = hashlib.sha256(b"x").hexdigest()
    odd = "qX9_vB2mZk7LpW4tRj8sNd3HgY6cFa1e"
    texts = [
        f'é password = "{key[:20]}" and Token:abc api-key=no apikey:abcdef', f"AKIA{key[:5].upper()}",
        "AKIA" + "B7" * 9 + " x AKIAZ", f"{key} {key[:23]} {key[:24]}", None, "", f"see {odd} there",
        "wordsandwordsandmorewordstogether " * 3, "1234567890123456789012345", "SECRETſ=abcdefgh",
        "secret=tok secret='longer-one' secret:x", odd, "A" * 40,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in find_secrets(frame).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [s for s in got[i] if s[1] < 3] == sorted(base), text
    added = {i for i, spans in got.items() if any(s[1] == 3 for s in spans)}
    assert added == {3, 6, 11}
    assert find_secrets(docs).count() == docs.count() and find_secrets(no_docs).count() == 0
