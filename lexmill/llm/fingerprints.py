"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A hash of the last seven bytes sets boundaries: position p ends a chunk at block size 3 * 2 ** k where hash + 1 is divisible by
it, so that boundaries depend on nothing but their neighbourhood and those of 2b are among those of b. A document's block
size is the least with at most 63 boundaries; every chunk, the one after the last boundary too, gives one character (six bits of
its hash), so that ``sig`` covers the whole text in at most 64 characters; ``sig2`` is the same at twice the block size.

Two fingerprints are compared where block sizes agree: sig with sig and sig2 with sig2 at equal block sizes, sig2 of the
smaller with sig of the larger at twice. They match if signatures compared share a run of seven characters and
``100 * (1 - edit distance / longer length)``, rounded down, the best of what is compared, is at least ``SCORE``. Runs of seven are the index: all that share
one meet in blocks (see ``similar``), so that no match is missed.

Results (doc_id, block_size, sig, sig2, class_id, n_copies, n_links), one row for each document: its fingerprint, the least id of those
that matches connect it with (its own, if none does), how many other documents have the same fingerprint, and how many other
fingerprints match it. Documents of one fingerprint are one member of the comparison, by their least id, and all have its matches.

Defined cases: null text counts as empty; signatures of fewer than seven characters (short texts) match nothing and have no copies; rows with a null
id are left out; of rows that repeat an id the least text counts; other columns are ignored; an empty table gives no rows.
Texts are read whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernel as K
from lexmill.llm import similar
from lexmill.llm.common import longs, one_row_per_id, two_columns, written

WINDOW, LONGEST, RUN, SCORE = 7, 64, 7, 60
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEVELS = 48
FINGERPRINT = "doc_id long, k int, sig string, sig2 string"


def boundaries(data: np.ndarray, offsets: np.ndarray, ranges: K.Ranges) -> tuple[np.ndarray, np.ndarray]:
    """End positions of chunks and the largest k at which each is one."""
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    end = np.arange(1, len(data) + 1)
    value = ranges.hash(np.maximum(end - WINDOW, begin), end) >> np.uint64(16)
    value += np.uint64(1)
    at = np.flatnonzero(value % np.uint64(3) == 0)
    value = value[at]
    low = value & (~value + np.uint64(1))
    return end[at], np.minimum(np.log2(low.astype(np.float64)).astype(np.int64), LEVELS - 1)


def signatures(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, str]]:
    """(k, sig, sig2) of each row of a slice."""
    ranges = K.Ranges(data)
    ends, level = boundaries(data, offsets, ranges)
    first = np.searchsorted(ends, offsets, "right")  # a boundary at a row's end is that row's
    for r in range(len(offsets) - 1):
        lo, hi = int(offsets[r]), int(offsets[r + 1])
        own, of = ends[first[r] : first[r + 1]], level[first[r] : first[r + 1]]
        more = np.cumsum(np.bincount(of, minlength=LEVELS)[::-1])[::-1]
        k = int(np.argmax(more <= LONGEST - 1))
        yield k, *(_signature(own[of >= j], lo, hi, ranges) for j in (k, k + 1))


def _signature(ends: np.ndarray, lo: int, hi: int, ranges: K.Ranges) -> str:
    if len(ends) == 0 or ends[-1] < hi:
        ends = np.append(ends, hi)
    begin = np.concatenate([[lo], ends[:-1]])
    return ALPHABET[(ranges.hash(begin, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode() if hi > lo else ""


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, k (block size 3 * 2 ** k), sig and sig2, from (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for _, _, data, offsets in K.texts(batch.column("text")) for x in signatures(data, offsets)]
            k, sig, sig2 = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k, pa.int32()), pa.array(sig, pa.string()), pa.array(sig2, pa.string())], ["doc_id", "k", "sig", "sig2"])

    return docs.select("doc_id", "text").mapInArrow(run, FINGERPRINT)


def _codes(sigs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows x LONGEST character codes (0 beyond the end), and lengths."""
    size = np.array([len(s) for s in sigs], np.int64)
    return np.frombuffer(b"".join(s.encode().ljust(LONGEST, b"\0") for s in sigs), np.uint8).reshape(len(sigs), LONGEST), size


def _runs_of(codes: np.ndarray, size: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of RUN characters, together with its block size."""
    weights = K.odd_constants(RUN + 1, 61)
    n = LONGEST - RUN + 1
    h = np.repeat(k.astype(np.uint64)[:, None] * weights[RUN], n, 1)
    for j in range(RUN):
        h += codes[:, j : j + n].astype(np.uint64) * weights[j]
    row, at = np.nonzero(np.arange(n)[None, :] <= (size - RUN)[:, None])
    return row, K.mix(h)[row, at]


def index(prints: DataFrame) -> DataFrame:
    """(node, k1, doc_id): a row for each run of a fingerprint's two signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, k = longs(batch, "doc_id"), longs(batch, "k").astype(np.int64)
            pairs = [_runs_of(*_codes(batch.column(c).to_pylist()), k + up) for up, c in enumerate(("sig", "sig2"))]
            row, node = (np.concatenate(x) for x in zip(*pairs))
            mine = pa.array(ids[row])
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), mine, mine], ["node", "k1", "doc_id"])

    return prints.mapInArrow(run, "node long, k1 long, doc_id long")


class Coded:
    """Signatures as arrays: characters, lengths, the bit mask of each character's positions, and how often each stands there."""

    def __init__(self, sigs: list[str]):
        codes, self.size = _codes(sigs)
        self.codes = _PLACE[codes]
        row, at = np.nonzero(codes)
        self.masks = np.zeros((len(sigs), len(ALPHABET) + 1), np.uint64)
        np.bitwise_or.at(self.masks, (row, self.codes[row, at]), np.uint64(1) << at.astype(np.uint64))
        self.often = np.zeros((len(sigs), len(ALPHABET)), np.uint8)
        np.add.at(self.often, (row, self.codes[row, at]), 1)


#: Place of a byte in the alphabet; all that isn't in it comes after.
_PLACE = np.full(256, len(ALPHABET), np.int64)
_PLACE[ALPHABET] = np.arange(len(ALPHABET))


def least_distances(a: Coded, x: np.ndarray, b: Coded, y: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distances, from how often each character stands in either."""
    common = np.minimum(a.often[x], b.often[y]).sum(1, dtype=np.int64)
    return np.maximum(a.size[x], b.size[y]) - common


def distances(a: Coded, x: np.ndarray, b: Coded, y: np.ndarray) -> np.ndarray:
    """Edit distance of rows x of a and y of b, many pairs at once: Myers' bit vectors, a pair in one 64-bit word."""
    one, zero = np.uint64(1), np.uint64(0)
    n, m = a.size[x], b.size[y]
    full = np.where(n >= 64, ~zero, (one << np.minimum(n, 63).astype(np.uint64)) - one)
    top = one << np.maximum(n - 1, 0).astype(np.uint64)
    plus, minus, score = full.copy(), np.zeros(len(n), np.uint64), n.astype(np.int64).copy()
    text = b.codes[y]
    for j in range(int(m.max(initial=0))):
        eq = a.masks[x, text[:, j]]
        cross = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        up = minus | ~(eq | plus)
        down = plus & eq
        live = j < m
        score += live * (((up & top) != zero).astype(np.int64) - ((down & top) != zero))
        up = (up << one) | one
        down <<= one
        plus = np.where(live, (down | ~(cross | up)) & full, plus)
        minus = np.where(live, up & cross & full, minus)
    return np.where(n == 0, m, score)


def _share(x: str, y: str) -> bool:
    have = {x[i : i + RUN] for i in range(len(x) - RUN + 1)}
    return any(y[i : i + RUN] in have for i in range(len(y) - RUN + 1))


def _compare(least: int) -> similar.Compare:
    def prepare(group: pa.Table):
        k = longs(group, "k").astype(np.int64)
        sig = [group.column(c).to_pylist() for c in ("sig", "sig2")]
        coded = [Coded(s) for s in sig]

        def reach(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which pairs match, in any of the comparisons."""
            match = np.zeros(len(i), bool)
            for p, q, up in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, -1)):  # k of i is that of j plus up
                n, m = coded[p].size[i], coded[q].size[j]
                longer = np.maximum(n, m)
                able = np.flatnonzero(~match & (k[i] == k[j] + up) & (np.minimum(n, m) >= RUN) & (100 * np.minimum(n, m) >= least * longer))
                able = able[100 * (longer[able] - least_distances(coded[p], i[able], coded[q], j[able])) >= least * longer[able]]
                if len(able):
                    x, y = i[able], j[able]
                    score = 100 * (longer[able] - distances(coded[p], x, coded[q], y)) // longer[able]
                    for at in able[score >= least].tolist():
                        match[at] = _share(sig[p][i[at]], sig[q][j[at]])
            return match

        def linked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            match = np.concatenate([reach(i[at : at + (1 << 15)], j[at : at + (1 << 15)]) for at in range(0, max(len(i), 1), 1 << 15)])
            return i[match], j[match]

        return linked

    return prepare


def document_fingerprints(docs: DataFrame, least: int = SCORE) -> DataFrame:
    """See the module's docstring."""
    prints = written(fingerprints(one_row_per_id(two_columns(docs), "text")), "fingerprints")
    keyed = prints.withColumns({"k1": F.xxhash64("k", "sig", "sig2"), "k2": F.xxhash64(F.lit(67), "sig2", "sig", "k")}).filter(F.length("sig") >= RUN)
    single = written(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("k").alias("k"), F.first("sig").alias("sig"), F.first("sig2").alias("sig2")), "prints")
    payload = lambda ids: single.join(ids, "doc_id", "left_semi").select("doc_id", F.lit(1).cast("long").alias("weight"), "k", "sig", "sig2")
    found = similar.classes(keyed, similar.links(index(single), payload, _compare(least)))
    zero = F.lit(0).cast("long")
    out = prints.join(found, "doc_id", "left")
    counts = [F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("n_links", zero).alias("n_links")]
    return out.select("doc_id", F.expr("shiftleft(3L, k)").alias("block_size"), "sig", "sig2", *counts)
