"""Hierarchical packing of documents into windows of several lengths.

A document longer than the largest tier is cut into full windows of it and a rest. Each piece goes to the shortest tier
that holds it. In a shard, tiers are packed from the longest down: its own pieces by best fit, longest first; then the
gaps of its windows are filled with the longest pieces of shorter tiers that fit. Windows of a tier are then dealt to
step groups of equal capacity (``STEP_TOKENS``), the fullest first and each to the group with the fewest tokens so far, so
that steps carry alike.

Results (doc_id, piece, start, n_tokens, shard, tier, win, place, step), one row per piece: tokens ``start`` to
``start + n_tokens`` of the document stand at ``place`` of window ``win`` (numbered by shard and tier).

Shards hold about ``SHARD_TOKENS`` tokens, so their number grows with the corpus; only ids and counts are shuffled. A
shard is packed by one task in memory proportional to its pieces. Defined cases: documents without tokens (null or
empty texts) have no piece; rows without an id are left out; rows that repeat an id are packed each; pieces of equal length go by
id; documents of any length are cut, none is truncated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import longs, partitions, runs, whole_groups, written
from lexmill.llm.mixing import n_tokens

TIERS = (512, 2048, 8192)
STEP_TOKENS = 65_536
SHARD_TOKENS = 4_000_000

RESULT = "doc_id long, piece long, start long, n_tokens long, shard long, tier int, win long, place long, step long"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int]]:
    """(tier, window, place) of each piece; no piece is longer than the largest tier."""
    where: list[tuple[int, int, int] | None] = [None] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    pools: dict[int, list[int]] = {t: [] for t in tiers}
    for i in order:
        pools[next(t for t in tiers if lengths[i] <= t)].append(i)
    for size in reversed(tiers):
        free: list[tuple[int, int]] = []  # (room, window), sorted
        used: list[int] = []
        for i in pools[size]:
            at = bisect_left(free, (lengths[i], -1))
            window = free.pop(at)[1] if at < len(free) else len(used)
            if window == len(used):
                used.append(0)
            where[i] = (size, window, used[window])
            used[window] += lengths[i]
            if used[window] < size:
                insort(free, (size - used[window], window))
        # Gaps, the largest first, take the longest piece of any shorter tier that fits, until none does.
        shorter = [(lengths[i], -i) for t in tiers if t < size for i in pools[t]]
        shorter.sort()
        for room, window in reversed(free):
            while room and shorter:
                at = bisect_left(shorter, (room + 1, -len(lengths))) - 1
                if at < 0:
                    break
                n, i = shorter.pop(at)
                where[-i] = (size, window, used[window])
                used[window] += n
                room -= n
        for t in tiers:
            if t < size:
                pools[t] = [i for i in pools[t] if where[i] is None]
    return where


def steps(where: list[tuple[int, int, int]], lengths: list[int], step_tokens: int = STEP_TOKENS) -> dict[tuple[int, int], int]:
    """Step group of each (tier, window)."""
    filled: dict[tuple[int, int], int] = {}
    for (tier, window, _), n in zip(where, lengths):
        filled[tier, window] = filled.get((tier, window), 0) + n
    out = {}
    for tier in sorted({t for t, _ in filled}):
        windows = sorted((-n, w) for (t, w), n in filled.items() if t == tier)
        room = max(1, step_tokens // tier)
        groups = [(0, g, 0) for g in range(-(-len(windows) // room))]
        for n, w in windows:
            total, g, count = heapq.heappop(groups)
            out[tier, w] = g
            if count + 1 < room:
                heapq.heappush(groups, (total - n, g, count + 1))
    return out


def packed(docs: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """See the module's docstring."""
    tiers, largest = tuple(sorted(tiers)), max(tiers)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_tokens(F.col("text")).alias("n")).filter("doc_id IS NOT NULL AND n > 0")
    rows = written(rows, "lengths")  # ids and counts: texts are read once
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("n_tokens"), F.pmod(F.xxhash64(F.lit(3), "doc_id", "piece"), F.lit(shards)).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "shard"):
            bounds = runs(longs(group, "shard"))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = group.slice(lo, hi - lo)
                lengths = longs(part, "n_tokens").tolist()
                where = pack(lengths, tiers)
                step = steps(where, lengths)
                tier, window, place = zip(*where)
                extra = [pa.array(tier, pa.int32()), pa.array(window, pa.int64()), pa.array(place, pa.int64()), pa.array([step[t, w] for t, w in zip(tier, window)], pa.int64())]
                piece = longs(part, "piece")
                columns = [part.column("doc_id"), part.column("piece"), pa.array(piece * largest), part.column("n_tokens"), part.column("shard"), *extra]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "n_tokens", "shard", "tier", "win", "place", "step"])

    return pieces.repartition(partitions(pieces), "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece").mapInArrow(run, RESULT)
