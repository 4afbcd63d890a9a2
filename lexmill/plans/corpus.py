"""The flagship plan: filter, select, tokenise, chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import strip
from lexmill.operators import tokens as T
from lexmill.session import spread, table

LENGTH, STRIDE = 256, 32
WHITELIST = tuple(f"src{i}" for i in range(0, 20, 2))


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).filter(F.col("source").isin(*WHITELIST) & (F.length(strip(F.col("text"))) > 0))
    return T.chunks(docs.select("doc_id", T.count_words(F.col("text")).alias("n")), "n", LENGTH, STRIDE).select("doc_id", "chunk_no", "start_tok", "end_tok", "n_real", "n_pad")


QUERIES = {"corpus_chunks": corpus_chunks}
SQL = {
    "corpus_chunks": f"""
WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents
           WHERE source IN {WHITELIST} AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0),
     s AS (SELECT doc_id, n, unnest(range(0, greatest(n, {LENGTH}), {LENGTH - STRIDE})) AS start_tok FROM t),
     e AS (SELECT *, least(start_tok + {LENGTH}, greatest(n, {LENGTH})) AS end_tok FROM s)
SELECT doc_id, CAST(start_tok / {LENGTH - STRIDE} AS INTEGER) AS chunk_no, CAST(start_tok AS INTEGER) AS start_tok,
       CAST(end_tok AS INTEGER) AS end_tok, CAST(greatest(least(end_tok, n) - start_tok, 0) AS INTEGER) AS n_real,
       CAST({LENGTH} - greatest(least(end_tok, n) - start_tok, 0) AS INTEGER) AS n_pad
FROM e"""
}
