"""Shuffles, samples and splits of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import ordering as O
from lexmill.session import table

SEED, EVAL, MOST, KEEP, SAMPLE = "s1", 200, 900, 50, 100


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source")


def md5_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ranked(_docs(spark, sf_dir), SEED, "doc_id").select("doc_id", "rank")


def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", O.bucket(SEED, "doc_id", 128).alias("bucket"))


def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.split(_docs(spark, sf_dir), SEED, "doc_id", EVAL, MOST).select("doc_id", "rank", "split")


def eval_tail_to_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.eval_tail_to_train(O.split(_docs(spark, sf_dir), SEED, "doc_id", EVAL, MOST), KEEP).select("doc_id", "split", "position")


def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sample(_docs(spark, sf_dir), SEED, "doc_id", SAMPLE)


def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred failures by time: a top-n."""
    return table(spark, sf_dir, "events").filter("value < 5").select("event_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


QUERIES = {f.__name__: f for f in (md5_shuffle, bucket_assign, train_eval_split, eval_tail_to_train, exact_sample, last_n)}
_R = f"WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) AS rank FROM documents)"
SQL = {
    "md5_shuffle": f"{_R} SELECT doc_id, rank FROM r",
    "bucket_assign": f"SELECT doc_id, CAST('0x' || left(md5('{SEED}:' || doc_id), 8) AS BIGINT) % 128 AS bucket FROM documents",
    "train_eval_split": f"{_R} SELECT doc_id, rank, CASE WHEN rank <= {EVAL} THEN 'eval' ELSE 'train' END AS split FROM r WHERE rank <= {MOST}",
    "eval_tail_to_train": f"""{_R}, s AS (SELECT * FROM r WHERE rank <= {MOST}), n AS (SELECT count(*) AS n FROM s)
SELECT doc_id, CASE WHEN rank <= {KEEP} THEN 'eval' ELSE 'train' END AS split,
  CASE WHEN rank <= {KEEP} THEN rank WHEN rank <= {EVAL} THEN greatest(n - {EVAL}, 0) + rank - {KEEP} ELSE rank - {EVAL} END AS position FROM s, n""",
    "exact_sample": f"SELECT doc_id, source FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT {SAMPLE}",
    "last_n": "SELECT event_id, ts, value FROM events WHERE value < 5 ORDER BY ts DESC, event_id DESC LIMIT 100",
}
