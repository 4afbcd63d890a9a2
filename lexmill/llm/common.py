"""Shared plumbing of the training-data operators: cut points in a plan, sorted sweeps, unique ids."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One is made only where the session names none and driver and executors are one
    process, as in tests; a cluster has to name one."""
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not have:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="lexmill-")
        sc.setCheckpointDir(have)
    return have


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read column by column, lost with no executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold complete runs of equal keys, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and keys[-1] == held[-1].column(key)[-1].as_py():
            held.append(batch)
            continue
        last = np.flatnonzero(keys != keys[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys, and the end of the last."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def pair_blocks(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within each run, in blocks of about ``most`` pairs; every pair comes once."""
    size = np.diff(bounds)
    after = np.repeat(bounds[1:], size) - np.arange(bounds[-1]) - 1
    have = np.flatnonzero(after)
    total = np.cumsum(after[have])
    at = 0
    while at < len(have):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        who, n = have[at:to], after[have[at:to]]
        first = np.repeat(who, n)
        offset = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        yield first, first + 1 + offset
        at = to


def longs(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy() if isinstance(batch, pa.Table) else batch.column(name).to_numpy(zero_copy_only=False)


def binaries(rows: np.ndarray) -> pa.Array:
    """A binary array with one value for each row of a two-dimensional array."""
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    offsets = np.arange(n + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array with values[bounds[i]:bounds[i + 1]] in row i."""
    offsets = bounds.astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def one_row_per_id(df: DataFrame, order: str, id_col: str = "doc_id") -> DataFrame:
    """df with one row for each id: the least by ``order``, then by the row's JSON. Only rows of ids that repeat are shuffled, and they are
    aggregated before that, so an id that many rows have isn't gathered anywhere. Rows without an id stay as they are."""
    repeated = written(df.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col), "repeated")
    if repeated.isEmpty():
        return df
    row = F.struct(*df.columns)
    least = by_ids(df, repeated, True, id_col).groupBy(id_col).agg(F.min_by(row, F.struct(order, F.to_json(row))).alias("_row")).select("_row.*")
    return by_ids(df, repeated, False, id_col).union(least.select(*df.columns))


def two_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text only, whatever other columns there are; rows without an id can't be named and are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")


#: Bits of the filter of ``might``: 16 for an id, and never more than these (32 MB), whatever the number of ids.
MOST_BITS = 1 << 28
_BUCKET = 1 << 15  # bits in one value of bitmap_construct_agg


def might(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with a column ``_might``: false where the id isn't among ``ids`` for sure. The filter is a bitmap of hashed ids, broadcast, of
    bounded size: more ids make it pass more rows that an exact join then has to tell, but never drop one."""
    bits = _BUCKET
    n = ids.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(F.lit(71), F.col(id_col).cast("long")), F.lit(bits))
    marks = ids.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / _BUCKET).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_p") % _BUCKET).alias("_bitmap"))
    at = F.when(F.col(id_col).isNotNull(), place)
    rows = docs.withColumn("_at", at).join(F.broadcast(marks), F.floor(F.col("_at") / _BUCKET) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_at % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return rows.select(*docs.columns, bit.alias("_might"))


def by_ids(docs: DataFrame, ids: DataFrame, keep: bool, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is (or isn't) among ``ids``. A null id is never among them. One way at every size: what the bitmap settles isn't
    shuffled, the rest meets the ids in a merge join, so that what is measured on small tables is what runs on large ones."""
    marked, ids = might(docs, ids, id_col), ids.hint("merge")
    unclear = marked.filter("_might").drop("_might")
    if keep:
        return unclear.join(ids, id_col, "left_semi").select(*docs.columns)
    return marked.filter("NOT _might").drop("_might").union(unclear.join(ids, id_col, "left_anti").select(*docs.columns))


def partitions(df: DataFrame) -> int:
    """Number of partitions for a stage that is bound by CPU: given as a number, so that adaptive execution doesn't join them by bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
