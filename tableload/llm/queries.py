"""The registered queries of the operators in this package, and their SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_ids, encode_texts
from .collocations import collocations
from .common import fold
from .decontaminate import mark_contaminated
from .divergence import source_divergence
from .itq import link_vectors
from .mixing import mix
from .ngram_join import near_duplicates
from .packing import pack_documents
from .quality import fit_quality, learnable, score_quality
from .secrets import KINDS, find_secrets
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import judge_urls

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
WORDS = "word_bpe_49k.json"

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
QUALITY_FOLD = (3, 1)  # labels of ids whose crc32 is 1 modulo 3 are held out
TOXICITY_FOLD = (5, 0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(parts: int, remainder: int):
    return F.coalesce(fold(F.col("doc_id"), parts) == remainder, F.lit(False))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = _table(spark, sf_dir, "labels").where(learnable(F.col("doc_id"), *QUALITY_FOLD))
    return fit_quality(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", _held(*QUALITY_FOLD).alias("held_out"), "score", "predicted")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", F.col("n_shingles").cast("long"), "n_links", "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    marked = mark_contaminated(docs.select("doc_id", "text"), items)
    return marked.select("doc_id", "contaminated", "item_ids", "similarity")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        def name(s):
            return F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])

        return F.array_join(F.transform(spans, name), ",")

    def of_kind(i):
        # One parameter only: a second one of the function would be the span's place.
        return F.filter("spans", lambda s: s["kind"] == i)

    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [
        F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    labels = labels.where(learnable(F.col("doc_id"), *TOXICITY_FOLD))
    model = fit_toxicity(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", _held(*TOXICITY_FOLD).alias("held_out"), "score", "predicted")


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORDS)
    rows = decode_ids(encode_texts(_table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_token_counts,
        op3_token_ids,
        op4_quality,
        op5_embedding_near_dedup,
        op6_ngram_jaccard_join,
        op7_source_mixing,
        op8_decontamination,
        op9_secret_scans,
        op10_toxicity,
        op11_bpe_encoding,
        op12_source_divergence,
        op13_phrase_collocations,
    )
}

URL_SQL = """
WITH rules(host, path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS row,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (
  SELECT p.row, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
    max_by(r.action, length(r.host || r.path)) AS action
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (row)
"""

VECTOR_SQL = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.row <> b.row AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.b AS component_id, e.vec_id = l.b AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS cap,
    coalesce(sum(2 * source_size) OVER steep, 0)::BIGINT AS caps_before,
    coalesce(sum(weight) OVER steep, 0)::BIGINT AS weights_before,
    sum(source_size) OVER ()::BIGINT AS all_words, sum(weight) OVER ()::BIGINT AS weights
  FROM sources
  WINDOW steep AS (ORDER BY 2 * source_size / weight, source IS NULL, source
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (all_words * 150 - caps_before * 100)::DOUBLE / ((weights - weights_before) * 100)
    AS level FROM ranked),
line AS (
  SELECT min_by(level, weights_before) AS level, min(weights_before) AS weights_before
  FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, CASE WHEN line.level IS NULL
      OR levels.weights_before < line.weights_before THEN cap::DOUBLE
    ELSE least(line.level * weight, cap::DOUBLE) END AS target FROM levels, line),
cuts AS (
  SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS epochs,
    floor(target)::BIGINT - floor(target)::BIGINT // greatest(source_size, 1) * source_size
      AS rest FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized)
SELECT doc_id, size, source_size, target,
  (size * epochs + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed JOIN cuts ON placed.source IS NOT DISTINCT FROM cuts.source
"""

DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      AS text FROM documents),
words AS (
  SELECT row, lang, source,
    unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
langs AS (
  SELECT d.lang, coalesce(k.v, 0)::HUGEINT AS v, coalesce(k.n, 0)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang FROM docs) d
  LEFT JOIN (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang) k USING (lang)),
counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n
  FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT d.lang, d.source, l.v, l.lang_total, coalesce(t.n, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) t USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS p,
    1 + 1000000000::HUGEINT * (k.lang_n + 5) // (g.lang_total + 5 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER
    AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (
  SELECT row_number() OVER () AS row, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM pieces),
words AS (SELECT row, lang, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM split),
places AS (
  SELECT lang, a, lead(a) OVER along AS b, lead(a, 2) OVER along AS c
  FROM words WINDOW along AS (PARTITION BY row ORDER BY i)),
grams AS (
  SELECT lang, 1 AS size, a AS phrase FROM places
  UNION ALL SELECT lang, 2, a || ' ' || b FROM places WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM places WHERE c IS NOT NULL),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (
  SELECT lang, size, phrase, f AS a, str_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS MATERIALIZED (
  SELECT *, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = c.first
  JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (
  SELECT lang, size, phrase, a, unnest(cut) FROM (
    SELECT lang, size, phrase, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS cut
    FROM scored GROUP BY ALL)),
longer AS (
  SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest([1, 2]) AS s FROM candidates WHERE size = 3) GROUP BY ALL),
ranked AS (
  SELECT l.lang, l.phrase, l.a, l.l, l.r, l.score::BIGINT AS score,
    row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, l.phrase) AS rank
  FROM lowest l LEFT JOIN longer o ON l.size = 2 AND o.lang = l.lang AND o.phrase = l.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 50 * l.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op1_url_filters": URL_SQL,
    "op5_embedding_near_dedup": VECTOR_SQL,
    "op7_source_mixing": MIX_SQL,
    "op12_source_divergence": DIVERGENCE_SQL,
    "op13_phrase_collocations": COLLOCATION_SQL,
}
