"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Documents are spread over shards by a hash of their id. In a shard each source is a stream of tokens, its documents in
seeded order, cut into blocks of ``BLOCK_TOKENS``; a document belongs to the block of its first token. The shard has as
many seats as ``KEEP`` of all its blocks. Seats go to the highest quotients weight / (2 k + 1), k = 0, 1, ..., of the
sources, which stops at the blocks that a source has; so what a scarce source can't fill goes to the next highest
quotients. Each source's quota of blocks is then drawn by seeded order, and their documents are taken whole.

Results (doc_id, source, shard, block, n_tokens), one row per document taken; ``quotas`` gives the seats.

Only ids and counts are shuffled; no window spans more than a shard and a source. Defined cases: null and empty texts have
0 tokens and go with the block where they stand; a null source is a source of its own, of the default weight;
weights that are 0 or less get no seats; rows without an id are left out; rows that repeat an id are separate documents in
the same shard; equal quotients go to the source that sorts first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {f"src{i}": float(1 + i % 4) for i in range(20)}
OTHER_WEIGHT = 1.0
KEEP = 0.8
BLOCK_TOKENS = 2048
DOCS_PER_SHARD = 500
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _weight(source: Column, weights: dict[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(source == kv[0], F.lit(kv[1])), sorted(weights.items()), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(OTHER_WEIGHT))


def _draw(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *(p.cast("string") for p in parts)))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, shard, block and n_tokens of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens")).filter("doc_id IS NOT NULL")
    # The count is a scan of one column; it sets how many shards there are, so that a shard's size stays the same.
    shards = max(1, -(-docs.filter(F.col("doc_id").isNotNull()).count() // DOCS_PER_SHARD))
    key = _draw(F.col("doc_id"))
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(shards))).withColumn("key", key)
    before = Window.partitionBy("shard", "source").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    return rows.withColumn("block", F.floor(start / BLOCK_TOKENS).cast("long")).drop("key")


def quotas(blocks: DataFrame, weights: dict[str, float] = WEIGHTS, keep: float = KEEP) -> DataFrame:
    """shard, source, blocks that there are, and quota, from ``placed``."""
    have = blocks.groupBy("shard", "source").agg(F.greatest(F.ceil(F.sum("n_tokens") / BLOCK_TOKENS), F.max("block") + 1).cast("long").alias("have"))
    seats = have.withColumn("weight", _weight(F.col("source"), weights)).filter("weight > 0")
    seats = seats.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("have") - 1)).alias("k"))
    ranked = seats.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(F.col("weight") / (2 * F.col("k") + 1)), F.asc_nulls_last("source"))))
    total = have.groupBy("shard").agg(F.floor(F.sum("have") * F.lit(keep)).alias("seats"))
    return ranked.join(total, "shard").filter("rank <= seats").groupBy("shard", "source").agg(F.max("have").alias("have"), F.count("*").alias("quota"))


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, keep: float = KEEP) -> DataFrame:
    """See the module's docstring."""
    blocks = placed(docs)
    seats = quotas(blocks, weights, keep)
    lots = seats.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("have") - 1)).alias("block"))
    lot = _draw(F.col("shard"), F.coalesce("source", F.lit("")), F.col("block"))
    drawn = lots.withColumn("lot", F.row_number().over(Window.partitionBy("shard", "source").orderBy(lot, "block"))).filter("lot <= quota")
    chosen = drawn.select("shard", F.col("source").alias("from_source"), F.col("block").alias("from_block"))
    same = F.col("source").eqNullSafe(F.col("from_source")) & (F.col("block") == F.col("from_block"))
    taken = blocks.join(chosen.withColumnRenamed("shard", "from_shard"), (F.col("shard") == F.col("from_shard")) & same, "left_semi")
    return taken.select("doc_id", "source", "shard", "block", "n_tokens")
