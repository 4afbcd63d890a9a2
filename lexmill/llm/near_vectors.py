"""Embedding near-dedup by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised, so that cosine c is Euclidean distance sqrt(2 - 2c). A table's hash is the tuple of
``floor((a . v + b) / WIDTH)`` over several Gaussian projections a. How many there are follows from the
number of vectors (so that vectors at right angles share a bucket with ``CHANCE`` others on average), and
how many tables from that: a pair at the threshold is missed by all of them with probability at most ``MISS``. Vectors that share a
bucket meet in blocks (see ``similar``), where every pair's cosine is computed exactly.

Results (vec_id, class_id, n_copies, n_links), one row for each vector: the least id of those that links connect it with (its own, if
none does), how many other vectors have the same direction, and with how many other directions its cosine is at least
the threshold. Vectors of one direction are one member of the join, by their least id, and all have its links.

Defined cases: null, empty and all-zero vectors, and those with a null, NaN or infinite entry, are alone in their class and have no copies; vectors of
different lengths don't match each other; rows with a null id are left out; of rows that repeat an id the least vector
counts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernel as K
from lexmill.llm import similar
from lexmill.llm.common import longs, might, one_row_per_id, written

THRESHOLD, MISS, CHANCE, WIDTH = 0.95, 0.02, 0.1, 1.8


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection puts two points at this distance into one cell."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections in a table, tables) for n vectors."""
    near, far = collision(math.sqrt(max(2 - 2 * threshold, 1e-9))), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2) / CHANCE) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def _units(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, normalised vectors) for each length of vectors in a batch that can be normalised."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64())
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)))])
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    fine = (size > 0) & (bad[begin[1:]] == bad[begin[:-1]])
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    for d in np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == d))
        v = values[begin[rows][:, None] + np.arange(d)]
        v = v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-300)  # else squares of tiny entries vanish
        norm = np.linalg.norm(v, axis=1)
        some = norm > 0
        yield d, rows[some], v[some] / norm[some, None]


def _keys(vectors: DataFrame) -> DataFrame:
    """doc_id and two content keys of the vectors that can match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = longs(batch, "doc_id")
            for d, rows, v in _units(batch.column("v")):
                bits = (np.round(v, 12) + 0.0).view(np.uint64)
                keys = [K.mix((K.mix(bits ^ w[None, :]) * w).sum(1, dtype=np.uint64) + np.uint64(d)).view(np.int64) for w in (K.odd_constants(d, 51), K.odd_constants(d, 53))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(keys[0]), pa.array(keys[1])], ["doc_id", "k1", "k2"])

    return vectors.mapInArrow(run, "doc_id long, k1 long, k2 long")


def _buckets(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        weights = K.odd_constants(k + 1, 57)
        for batch in batches:
            ids, k1 = longs(batch, "doc_id"), longs(batch, "k1")
            for d, rows, v in _units(batch.column("v")):
                if d not in planes:
                    rng = np.random.default_rng([59, d])
                    planes[d] = rng.standard_normal((d, tables * k)), rng.uniform(0, WIDTH, tables * k)
                a, b = planes[d]
                for at in range(0, len(rows), 1024):
                    cells = np.floor((v[at : at + 1024] @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, k)
                    node = (cells * weights[:k]).sum(2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * weights[k] + np.uint64(d)
                    some = np.repeat(rows[at : at + 1024], tables)
                    yield pa.RecordBatch.from_arrays([pa.array(K.mix(node).ravel().view(np.int64)), pa.array(k1[some]), pa.array(ids[some])], ["node", "k1", "doc_id"])

    return run


def _rows(group: pa.Table | pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Length of each row's vector, its place among those of that length, and these, normalised."""
    size, place, unit = np.zeros(group.num_rows, np.int64), np.zeros(group.num_rows, np.int64), {}
    for d, rows, v in _units(group.column(column)):
        size[rows], place[rows], unit[d] = d, np.arange(len(rows)), v
    return size, place, unit


def _compare(threshold: float) -> similar.Compare:
    def prepare(group: pa.Table):
        size, place, unit = _rows(group, "v")

        def linked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = np.zeros(len(i), bool)
            for d, v in unit.items():
                of = np.flatnonzero((size[i] == d) & (size[j] == d))
                for at in range(0, len(of), 1 << 15):
                    some = of[at : at + (1 << 15)]
                    near[some] = np.einsum("ij,ij->i", v[place[i[some]]], v[place[j[some]]]) >= threshold
            return i[near], j[near]

        return linked

    return prepare


def _alike(batch: pa.RecordBatch) -> np.ndarray:
    """Cosine of each row's vector to its leader's; -1 where their lengths differ."""
    size, place, unit = _rows(batch, "v")
    other, there, of = _rows(batch, "of_v")
    out = np.full(batch.num_rows, -1.0)
    for d in unit.keys() & of.keys():
        rows = np.flatnonzero((size == d) & (other == d))
        out[rows] = np.einsum("ij,ij->i", unit[d][place[rows]], of[d][there[rows]])
    return out


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """See the module's docstring."""
    vectors = table.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("doc_id IS NOT NULL")
    vectors = one_row_per_id(vectors, "v")
    base = written(_keys(vectors), "vector-keys")
    # One vector for each content, by its least id: what the tables hold doesn't grow with copies.
    first = written(base.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "k1"), "firsts")
    single = written(might(vectors, first).filter("_might").select("doc_id", "v").join(first, "doc_id").select("doc_id", "k1", "v"), "vectors")
    k, tables = plan(single.count(), threshold)
    cells = lambda k, tables: single.mapInArrow(_buckets(k, tables), "node long, k1 long, doc_id long")
    buckets, sketch = cells(k, tables), cells(2, 1).select("doc_id", F.col("node").alias("sketch"))
    payload = lambda ids: single.join(ids, "doc_id", "left_semi").select("doc_id", F.size("v").cast("long").alias("weight"), "v")
    tight = math.cos(math.acos(threshold) / 2) + 1e-9  # rounding must not make a pair just below the threshold sure
    found = similar.classes(base, similar.links(buckets, payload, _compare(threshold), sketch, _alike, tight))
    zero = F.lit(0).cast("long")
    out = vectors.select("doc_id").join(found, "doc_id", "left")
    return out.select(F.col("doc_id").alias("vec_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("n_links", zero).alias("n_links"))
