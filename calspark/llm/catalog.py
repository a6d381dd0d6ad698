"""The registered queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, divergence, embedding_dedup, ngram_join, packing, phrases, pii, quality, suffix_dedup, token_counts, toxicity

from .exact_dedup import exact_duplicates
from .shared import table


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file: in CORPUS_TOKENIZERS, or where its package is."""
    if folder := os.environ.get("CORPUS_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), special=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id WHERE r.root < p.b
), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, c.component_id) AS component_id, e.vec_id = least(e.vec_id, c.component_id) AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def _op11_sql(rounds: int = centroids.ROUNDS) -> str:
    """Each round is two steps: cN are the centroids, aN the nearest of them for each vector."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT rid, vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT rid, vec_id, v, k, list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, 65)]) AS d FROM kept, c{r}) GROUP BY ALL
)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT k, i, sum(v[i])::BIGINT AS t, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i) GROUP BY k) USING (k)
)"""
    steps = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM kept QUALIFY k < 40
)"""]
    for r in range(rounds):
        steps += [nearest.format(r=r), moved.format(r=r, n=r + 1)]
    steps.append(nearest.format(r=rounds))
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
cells AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT + 2 * count(*) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
sums AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(sum(c.n), 0)::HUGEINT + 2 * coalesce(l.v, 0) AS whole
  FROM groups g LEFT JOIN langs l USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source, l.v
), p AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // s.whole AS p, coalesce(c.n, 0) AS n
  FROM sums s JOIN kept k ON k.lang = s.lang LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM sums a JOIN sums b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), terms AS (
  SELECT p.lang, p.source, p.term AS item, p.p, 1 + (1000000000::HUGEINT * (k.total + 2)) // l.whole AS q
  FROM p JOIN kept k ON k.lang = p.lang AND k.term = p.term JOIN langs l ON l.lang = p.lang WHERE p.n > 0
), own AS (
  SELECT lang, source, item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // (p + q) DESC, item) AS rank
  FROM terms WHERE p > q QUALIFY rank <= 10
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, rank::INTEGER FROM own
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.without_phrases(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_pii": op3_pii,
        "op4_quality": op4_quality,
        "op5_packing": op5_packing,
        "op6_token_counts": op6_token_counts,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_centroids": op11_centroids,
        "op12_divergence": op12_divergence,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_embedding_dedup": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_centroids": _op11_sql(), "op12_divergence": OP12_SQL}
