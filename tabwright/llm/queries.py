"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import (
    centroids, decontaminate, divergence, esais, fmindex, language, lm, neighbours, pieces, privacy, quality, similar,
    tokenfile,
)
from tabwright.llm.rows import remainder


BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir), remainder(3) == 1)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir), remainder(7) == 2)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similarity_classes(documents(spark, sf_dir)).drop("key", "root")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(documents(spark, sf_dir), tokenizer_path(BYTE_BPE))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contained_items(documents(spark, sf_dir), items)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.find(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.without_earlier_passages(documents(spark, sf_dir)).drop("kept_text")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return esais.without_repeated_bytes(documents(spark, sf_dir)).drop("kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), tokenizer_path(PIECES), {"doc_id": "bigint"})


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(embeddings(spark, sf_dir)).drop("scans")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_lm_scoring, op3_ngram_jaccard_join, op4_token_ids, op5_benchmark_decontamination,
        op6_personal_data, op7_quality_rules, op8_substring_dedup, op9_suffix_array_dedup,
        op10_sentencepiece, op11_centroid_clustering, op12_source_divergence, op13_embedding_dedup,
    )}


_WORDS = r"""words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

_OP3 = f"""
WITH RECURSIVE {_WORDS},
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM words, unnest(range(1, greatest(len(ws) - 3, 2))) AS r(i) WHERE len(ws) > 0),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS content FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y, a.content AS own, b.content AS other
  FROM shared s JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 5 * s.n >= 4 * (a.n + b.n - s.n)),
reached(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reached GROUP BY x),
counts AS (
  SELECT x AS doc_id, count(*) AS n_links, count(DISTINCT other) FILTER (other <> own) AS n_similar_texts FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_similar_texts, 0) AS n_similar_texts
FROM classes LEFT JOIN counts USING (doc_id)"""

#: Items of at least five words.
_OP5 = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(list_transform(
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+'),
    lambda w: regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')), lambda w: w <> '') AS ws FROM texts),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM words, unnest(range(1, len(ws) - 3)) AS r(i) WHERE len(ws) >= 5),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(s.n) AS n_item_shingles, count(*) AS n_found,
       count(*) / any_value(s.n) AS containment
FROM shingles i JOIN shingles d ON i.g = d.g AND i.kind = 'i' AND d.kind = 'd' JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id HAVING 5 * count(*) >= 4 * any_value(s.n)"""

_OP8 = f"""
WITH {_WORDS},
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM words, unnest(range(1, len(ws) - 48)) AS r(i) WHERE len(ws) >= 50),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
covered AS (
  SELECT DISTINCT doc_id, j FROM windows JOIN firsts USING (h), unnest(range(i, i + 50)) AS r(j) WHERE first < doc_id),
each AS (SELECT doc_id, j, ws[j] AS word FROM words, unnest(range(1, len(ws) + 1)) AS r(j)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM each ANTI JOIN covered USING (doc_id, j)
  GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""


def _op11(rounds: int = centroids.ROUNDS) -> str:
    parts = ["""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, q AS m FROM v QUALIFY c < 16)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, q, c, m, CAST(list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM v CROSS JOIN c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  WITH s AS (SELECT c, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS x FROM a{r}, unnest(range(1, 65)) AS t(i) GROUP BY c, i),
  g AS (SELECT c, list(x ORDER BY i) AS m FROM s GROUP BY c)
  SELECT c, coalesce(g.m, old.m) AS m FROM c{r} old LEFT JOIN g USING (c))""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds}"""


_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_size FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS size FROM n GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(size, 0) AS size, coalesce(v, 0) AS v, coalesce(lang_size, 0) AS lang_size
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sizes USING (lang, source) LEFT JOIN v USING (lang)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
         1 + (1000000000 * (coalesce(n.n, 0) + 5)) // (g.size + 5 * g.v) AS p,
         1 + (1000000000 * (k.lang_n + 5)) // (g.lang_size + 5 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR r <= 50"""

_OP13 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reached(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
classes AS (SELECT x AS vec_id, min(y) AS component_id FROM reached GROUP BY x),
counts AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN counts USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query and is fast enough on small tables."""
    return {"op3_ngram_jaccard_join": _OP3, "op5_benchmark_decontamination": _OP5, "op8_substring_dedup": _OP8,
            "op11_centroid_clustering": _op11(), "op12_source_divergence": _OP12, "op13_embedding_dedup": _OP13}
