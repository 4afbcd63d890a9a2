"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import fingerprints, jaccard_forest, licenses, mixing, near_vectors, packing, quality, secrets, toxicity, url_rules
from lexmill.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.jaccard_join(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.matched(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_url_filters": op8_url_filters,
    "op9_license_scans": op9_license_scans,
    "op10_document_fingerprints": op10_document_fingerprints,
}

#: Letters, digits and all beyond ASCII: the tokens of kernel.ALNUM.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"

N, THRESHOLD = jaccard_forest.N, jaccard_forest.THRESHOLD
WEIGHT = " ".join(f"WHEN source = '{k}' THEN {v}" for k, v in sorted(mixing.WEIGHTS.items()))
LOT = f"md5('{mixing.SEED}:' || shard || ':' || coalesce(source, '') || ':' || block)"
RULES = ", ".join(f"({i}, '{url_rules.prefix(p)}', '{a}')" for i, p, a in url_rules.RULES)
#: Classes of the pairs p (a, b).
CLASSES = """     e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
     t(x, y) AS (SELECT DISTINCT a, a FROM e UNION SELECT t.x, e.b FROM t JOIN e ON e.a = t.y),
     k AS (SELECT x, min(y) AS class_id FROM t GROUP BY x),
     n AS (SELECT a, count(*) AS n FROM e GROUP BY a)"""
SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, embedding FROM embeddings WHERE vec_id IS NOT NULL),
     r AS (SELECT min(vec_id) AS vec_id, any_value(e) AS e, list(vec_id) AS ids FROM v
           WHERE list_sum(list_transform(e, lambda x: x * x)) > 0 GROUP BY embedding),
     p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM r a JOIN r b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {near_vectors.THRESHOLD}),
{CLASSES}
SELECT unnest(ids) AS vec_id, coalesce(class_id, r.vec_id) AS class_id, len(ids) - 1 AS n_copies, coalesce(n, 0) AS n_links
FROM r LEFT JOIN k ON k.x = r.vec_id LEFT JOIN n ON n.a = r.vec_id
UNION ALL SELECT vec_id, vec_id, 0, 0 FROM v WHERE coalesce(list_sum(list_transform(e, lambda x: x * x)), 0) = 0""",
    "op8_url_filters": f"""
WITH r(rule_id, prefix, action) AS (VALUES {RULES}),
     h AS (SELECT row_number() OVER () AS n, page_id, url,
             regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '\\.$', '') AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1) AS rest FROM pages),
     k AS (SELECT n, page_id, url, CASE WHEN length(host) > 0 THEN array_to_string(list_reverse(string_split(host, '.')), ',')
             || ',' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS key FROM h),
     m AS (SELECT n, page_id, url, rule_id, action,
             row_number() OVER (PARTITION BY n ORDER BY length(prefix) DESC, rule_id) AS place,
             CAST(count(rule_id) OVER (PARTITION BY n) AS INTEGER) AS n_rules
           FROM k LEFT JOIN r ON starts_with(key, prefix))
SELECT page_id, url, CAST(rule_id AS BIGINT) AS rule_id, action, n_rules FROM m WHERE place = 1""",
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS n_tokens,
             md5('{mixing.SEED}:' || doc_id) AS key FROM documents WHERE doc_id IS NOT NULL),
     s AS (SELECT *, CAST('0x' || left(key, 8) AS BIGINT) % (SELECT greatest(1, (count(*) + {mixing.DOCS_PER_SHARD - 1}) // {mixing.DOCS_PER_SHARD}) FROM d) AS shard FROM d),
     b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY shard, source ORDER BY key, doc_id, n_tokens
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {mixing.BLOCK_TOKENS} AS block FROM s),
     h AS (SELECT shard, source, greatest(ceil(sum(n_tokens) / {mixing.BLOCK_TOKENS}.0), max(block) + 1)::BIGINT AS have,
             CASE {WEIGHT} ELSE {mixing.OTHER_WEIGHT} END AS weight FROM b GROUP BY shard, source),
     q AS (SELECT shard, source, have, weight, unnest(range(have)) AS k FROM h),
     r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * k + 1) DESC, source NULLS LAST) AS rank FROM q),
     t AS (SELECT shard, floor(sum(have) * {mixing.KEEP}) AS seats FROM h GROUP BY shard),
     u AS (SELECT r.shard, r.source, max(have) AS have, count(*) AS quota FROM r JOIN t USING (shard) WHERE rank <= seats GROUP BY 1, 2),
     l AS (SELECT shard, source, quota, unnest(range(have)) AS block FROM u),
     c AS (SELECT shard, source, block FROM (SELECT *, row_number() OVER (PARTITION BY shard, source ORDER BY {LOT}, block) AS lot FROM l) WHERE lot <= quota)
SELECT b.doc_id, b.source, b.shard, b.block, b.n_tokens FROM b
WHERE EXISTS (SELECT 1 FROM c WHERE c.shard = b.shard AND c.source IS NOT DISTINCT FROM b.source AND c.block = b.block)""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
     r AS (SELECT min(doc_id) AS doc_id, array_to_string(w, ' ') AS t, any_value(w) AS w, list(doc_id) AS ids
           FROM w WHERE len(w) > 0 GROUP BY 2),
     g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [t]
             ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END) AS g FROM r),
     s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     p AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= {THRESHOLD}),
{CLASSES}
SELECT unnest(ids) AS doc_id, coalesce(class_id, r.doc_id) AS class_id, len(ids) - 1 AS n_copies, coalesce(n, 0) AS n_links
FROM r LEFT JOIN k ON k.x = r.doc_id LEFT JOIN n ON n.a = r.doc_id
UNION ALL SELECT doc_id, doc_id, 0, 0 FROM w WHERE len(w) = 0""",
}
