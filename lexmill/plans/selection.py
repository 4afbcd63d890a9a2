"""Selecting filings and counting what is selected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import selection as O
from lexmill.session import spread, table

CHOSEN = "n_chars % 3 = 0"
NAME = "concat(CAST(20120101 + (doc_id % 12) * 10000 AS STRING), '_', source, '-A_', CAST(doc_id AS STRING), '_', CAST(n_chars AS STRING), CASE WHEN doc_id % 10 = 0 THEN '.bin' ELSE '.txt' END)"
ROUTE = "CASE WHEN doc_id % 4 = 0 THEN concat(CAST(2012 + doc_id % 13 AS STRING), '-x.tar') WHEN doc_id % 4 = 1 THEN concat('filing_info_', CAST(2012 + doc_id % 13 AS STRING), '0101.jsonl') WHEN doc_id % 4 = 2 THEN concat('logs_', CAST(2012 + doc_id % 13 AS STRING), '0101.pkl') ELSE 'other' END"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whitelist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _docs(spark, sf_dir).filter(CHOSEN).select(F.col("source").alias("form_type")).distinct()
    return O.whitelisted(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "source", chosen)


def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days for which no file is there yet: incremental listing by an 8-character key."""
    day = F.date_format("ts", "yyyyMMdd").alias("day")
    remote = table(spark, sf_dir, "events").select(day).distinct()
    local = table(spark, sf_dir, "events").filter("event_id % 997 = 0").select(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit(".tar.gz")).alias("name"))
    return O.pending(remote, "day", local, "name")


def form_type_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(F.col("source").alias("form_type")).agg(F.sum("n_chars").alias("file_length"), F.sum(F.length("text")).alias("raw_file_length"), F.count("*").alias("total_filings"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.token_estimate(_docs(spark, sf_dir).filter("source IN ('src0', 'src2')"), "n_chars")


def vocab_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distinct in each text first, so that repeats are never exploded.
    words = lambda df: df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    return words(table(spark, sf_dir, "conversations")).distinct().join(words(spread(_docs(spark, sf_dir))).distinct(), "token", "left_anti")


def year_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three yearly sets exist; the missing one is skipped."""
    docs = _docs(spark, sf_dir).select("doc_id", "n_chars", (2012 + F.col("doc_id") % 3).cast("int").alias("year"))
    sets = {2012: docs.filter("year = 2012"), 2013: None, 2014: docs.filter("year = 2014")}
    return O.union_years(sets)


def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.expr(NAME).alias("name")).select("doc_id", O.form_type_of(F.col("name")).alias("form_type"))


def year_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.expr(ROUTE).alias("name")).select("doc_id", O.year_of(F.col("name")).alias("year"))


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(F.count("*").alias("n"))


def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "source", "n_chars").orderBy("doc_id").limit(100)


def skip_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.after(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", 100)


def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(F.length(T.strip(F.col("text"))) > 0).select("doc_id")


def resume_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All after the place of a name that was the last to be done (here the first that ends in 7.txt)."""
    docs = _docs(spark, sf_dir).select("doc_id", F.expr(NAME).alias("name"))
    return O.resumed(docs, "doc_id", F.endswith("name", F.lit("7.txt"))).select("doc_id", "name")


def required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether JSON records hold all required keys."""
    have = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.size(F.array_except(F.array(F.lit("k")), have)) == 0, F.lit(False)).alias("complete"))


def file_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized files go elsewhere."""
    return _docs(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") > 8000, F.lit("retry")).otherwise(F.lit("normal")).alias("route"))


QUERIES = {f.__name__: f for f in (whitelist_semi, pending_anti, form_type_metrics, token_estimate, vocab_diff, year_union, name_parse, year_route, count_rows, head_n, skip_n, blank_filter, resume_after, required_keys, file_routing)}
SQL = {
    "whitelist_semi": f"SELECT doc_id, source, n_chars FROM documents WHERE source IN (SELECT source FROM documents WHERE {CHOSEN})",
    "pending_anti": "SELECT DISTINCT strftime(ts, '%Y%m%d') AS day FROM events WHERE strftime(ts, '%Y%m%d') NOT IN (SELECT strftime(ts, '%Y%m%d') FROM events WHERE event_id % 997 = 0)",
    "form_type_metrics": "SELECT source AS form_type, CAST(sum(n_chars) AS BIGINT) AS file_length, CAST(sum(length(text)) AS BIGINT) AS raw_file_length, count(*) AS total_filings FROM documents GROUP BY 1",
    "token_estimate": "SELECT CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / 4.0 / 1e12, 12) AS lower_bound, round(sum(n_chars) / 3.0 / 1e12, 12) AS upper_bound FROM documents WHERE source IN ('src0', 'src2')",
    "vocab_diff": "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM conversations EXCEPT SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents",
    "year_union": "SELECT doc_id, n_chars, CAST(2012 + doc_id % 3 AS INTEGER) AS year FROM documents WHERE doc_id % 3 <> 1",
    "name_parse": rf"WITH n AS (SELECT doc_id, {NAME} AS name FROM documents) SELECT doc_id, CASE WHEN regexp_matches(name, '^\d{{8}}_(.*?)_\d+_\d+\.txt$') THEN regexp_extract(name, '^\d{{8}}_(.*?)_\d+_\d+\.txt$', 1) END AS form_type FROM n",
    "year_route": rf"""WITH n AS (SELECT doc_id, {ROUTE} AS name FROM documents) SELECT doc_id, CAST(coalesce(nullif(regexp_extract(name, '^(\d{{4}})', 1), ''), nullif(regexp_extract(name, 'filing_info_(\d{{4}})\d{{4}}\.jsonl$', 1), ''),
  nullif(regexp_extract(name, 'logs_(\d{{4}})\d{{4}}\.pkl$', 1), '')) AS INTEGER) AS year FROM n""",
    "count_rows": "SELECT count(*) AS n FROM documents",
    "head_n": "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "skip_n": "SELECT doc_id, source FROM documents ORDER BY doc_id OFFSET 100",
    "blank_filter": r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0",
    "resume_after": f"SELECT doc_id, {NAME} AS name FROM documents WHERE doc_id > (SELECT min(doc_id) FROM documents WHERE {NAME} LIKE '%7.txt')",
    "required_keys": "SELECT event_id, coalesce(list_contains(json_keys(props), 'k'), false) AS complete FROM events",
    "file_routing": "SELECT doc_id, CASE WHEN n_chars > 8000 THEN 'retry' ELSE 'normal' END AS route FROM documents",
}
