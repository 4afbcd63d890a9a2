"""Deterministic shuffles, samples, splits and quotas.

The order is that of a seeded md5 of a unique id, so that a second run, and an SQL engine, agree. Exact ranks over a whole table
don't go through one task: keys are cut into buckets by their first digits, rows are numbered within their bucket, and a bucket's
offset is the number of rows in the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3  # 4096 buckets; their counts, at most as many rows, are what is broadcast


def key(seed: str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def ranked(df: DataFrame, seed: str, id_col: str, digits: int = DIGITS) -> DataFrame:
    """Adds ``rank`` from 1 in the seeded order; rows of equal id go in any order."""
    keyed = df.withColumn("_key", key(seed, id_col)).withColumn("_bucket", F.substring("_key", 1, digits))
    size = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = size.select("_bucket", before.alias("_before"))  # one window over the buckets' counts only
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", id_col))
    numbered = keyed.withColumn("_place", place).join(F.broadcast(offset), "_bucket")
    return numbered.withColumn("rank", F.col("_place") + F.col("_before")).drop("_key", "_bucket", "_place", "_before")


def bucket(seed: str, id_col: str, n: int) -> Column:
    return F.pmod(F.conv(F.substring(key(seed, id_col), 1, 8), 16, 10).cast("long"), F.lit(n))


def shuffled(df: DataFrame, seed: str, id_col: str) -> DataFrame:
    """The rows in seeded order: a range exchange on the key."""
    return df.orderBy(key(seed, id_col), id_col)


def sample(df: DataFrame, seed: str, id_col: str, n: int) -> DataFrame:
    """Exactly n rows (or all) without replacement: each task keeps its own top n."""
    return df.orderBy(key(seed, id_col), id_col).limit(n)


def split(df: DataFrame, seed: str, id_col: str, eval_rows: int, most: int | None = None) -> DataFrame:
    """Adds ``split``: the first ``eval_rows`` of the seeded order are eval, the rest train; both together at most ``most`` rows."""
    rows = ranked(df, seed, id_col)
    rows = rows if most is None else rows.filter(F.col("rank") <= most)
    return rows.withColumn("split", F.when(F.col("rank") <= eval_rows, F.lit("eval")).otherwise(F.lit("train")))


def eval_tail_to_train(rows: DataFrame, keep: int) -> DataFrame:
    """Of a split table, the first ``keep`` eval rows stay; the others come after all train rows. Adds ``position`` in each part. Ranks are
    those that ``split`` gave, so that one count does it and nothing is sorted again."""
    n = rows.agg(F.count_if(F.col("split") == "eval").alias("e"), F.count_if(F.col("split") == "train").alias("t"))
    rows = rows.crossJoin(F.broadcast(n))  # one row
    moved = (F.col("split") == "eval") & (F.col("rank") > keep)
    at = F.when(moved, F.col("t") + F.col("rank") - keep).when(F.col("split") == "eval", F.col("rank")).otherwise(F.col("rank") - F.col("e"))
    return rows.withColumn("position", at).withColumn("split", F.when(moved, F.lit("train")).otherwise(F.col("split"))).drop("e", "t")
