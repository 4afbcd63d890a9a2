"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Every document is a query and a target. Its MinHash signature is cut into ``TREES`` labels of ``DEEPEST``
values; each tree is a prefix trie, held as rows sorted by node. Documents that share a prefix of ``SHALLOWEST`` values in
any tree come into one block or more (see ``similar``), which holds the tries' deeper levels. There prefixes are
shortened step by step, from ``DEEPEST`` on: all pairs that agree in so long a prefix are verified exactly; then each document's
recall is estimated from the links it has (each counts 1 / its probability of having been met at that depth, and one unseen link at the
threshold is assumed), and documents that reach ``TARGET`` ask no further, though others may still ask for them. At ``SHALLOWEST``
even a pair at the threshold is met with probability 0.995.

Results (doc_id, class_id, n_copies, n_links), one row for each document: the least id of those that links connect it with
(its own, if none does), how many other documents have the same words in the same order, and with how many other
texts, copies counted once, its similarity is at least ``threshold``. Copies are one member of the join, by their least id,
and all have its links.

Defined cases: null text counts as empty; texts without words are alone in their class and have no copies; texts of fewer than ``N`` words are
one gram, all of their words; rows with a null id are left out; of rows that repeat an id the one of the least text
counts; other columns are ignored; an empty table gives no rows. Texts are read whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernel as K
from lexmill.llm import similar
from lexmill.llm.common import binaries, by_ids, longs, might, one_row_per_id, ragged, two_columns, written

N, THRESHOLD = 3, 0.5
TREES, DEEPEST, SHALLOWEST, TARGET = 40, 5, 3, 0.995

BASE = "doc_id long, k1 long, k2 long, sig binary"

def _grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    small = K.lower(data)
    tokens = K.Tokens(small, offsets, K.ALNUM)
    words = K.Ranges(small).hash(tokens.start, tokens.end)
    grams, begin = K.ngrams(words, tokens.first, n)
    return grams, begin, words, tokens.first


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, content key (128 bits over the sequence of words) and signature of documents that have words (runs of letters and digits, in lower case)."""
    multipliers = K.odd_constants(TREES * DEEPEST, 23)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = longs(batch, "doc_id")
            for i, j, data, offsets in K.texts(batch.column("text")):
                grams, begin, words, first = _grams(data, offsets, n)
                have = np.flatnonzero(np.diff(begin))
                if not len(have):
                    continue
                place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
                keys = [K.mix(K.sums(words * K.powers(base, int(place.max(initial=0)))[place], first))[have] for base in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][have]), *(pa.array(k.view(np.int64)) for k in keys), binaries(K.minhash(grams, begin, multipliers)[have])], ["doc_id", "k1", "k2", "sig"])

    return docs.mapInArrow(run, BASE)


def _nodes(sig: np.ndarray, depth: int) -> np.ndarray:
    """Rows x TREES: the node of each signature at a depth."""
    weights = K.odd_constants(DEEPEST + 1, 31)
    sig = sig.reshape(len(sig), TREES, DEEPEST).astype(np.uint64)
    node = np.arange(TREES, dtype=np.uint64)[None, :] * weights[-1] + np.uint64(depth)
    for d in range(depth):
        node = node + sig[:, :, d] * weights[d]
    return K.mix(node)


def _trie(base: DataFrame) -> DataFrame:
    """A row per tree and document: its node at the depth where the search ends, its content key and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            spread = lambda c: pa.array(np.repeat(longs(batch, c), TREES))
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(sig, SHALLOWEST).ravel().view(np.int64)), spread("k1"), spread("doc_id")], ["node", "k1", "doc_id"])

    return base.mapInArrow(run, "node long, k1 long, doc_id long")


def gram_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, weight and the sorted distinct hashes of the n-grams of documents that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = longs(batch, "doc_id")
            for i, j, data, offsets in K.texts(batch.column("text")):
                grams, begin, _, _ = _grams(data, offsets, n)
                have = np.flatnonzero(np.diff(begin))
                if len(have):
                    sets = [np.unique(grams[begin[r] : begin[r + 1]]) for r in have]
                    size = np.array([len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][have]), pa.array(size), ragged(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))], ["doc_id", "weight", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, weight long, grams binary")


class Sets:
    """Sets of a group's rows, their elements numbered, so that common elements are counted by looking up marks."""

    def __init__(self, binary: list[bytes]):
        self.values = np.concatenate([np.frombuffer(b, np.uint64) for b in binary])
        self.size = np.array([len(b) // 8 for b in binary], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        known, number = np.unique(self.values, return_inverse=True)
        self.number = number.astype(np.int32)
        self.mark = np.zeros(len(known), np.int8)

    def jaccard(self, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        """Exact similarity of rows x to rows y, x in order; 0 where their sizes rule the threshold out."""
        n, m = self.size[x], self.size[y]
        able = np.flatnonzero(np.minimum(n, m) >= threshold * np.maximum(n, m))
        common = np.zeros(len(x), np.int64)
        bounds = np.concatenate([np.flatnonzero(np.diff(x[able], prepend=-1)), [len(able)]])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = self.number[self.begin[x[able[lo]]] : self.begin[x[able[lo]] + 1]]
            self.mark[own] = 1
            at = lo
            while at < hi:  # about a million elements at a time
                to = max(at + 1, min(hi, at + (1 << 20) // max(1, int(self.size[y[able[at:hi]]].max()))))
                other = y[able[at:to]]
                size = self.size[other]
                first = np.cumsum(size) - size
                place = np.repeat(self.begin[other] - first, size) + np.arange(int(size.sum()))
                common[able[at:to]] = np.add.reduceat(self.mark[self.number[place]], first, dtype=np.int64)
                at = to
            self.mark[own] = 0
        return common / (n + m - common)


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Probability that two documents agree in a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def _compare(threshold: float, target: float) -> similar.Compare:
    multipliers = K.odd_constants(TREES * DEEPEST, 23)
    unseen = {d: 1 / chance(threshold, d) - 1 for d in range(SHALLOWEST, DEEPEST + 1)}

    def prepare(group: pa.Table):
        sets = Sets(group.column("grams").to_pylist())
        sig = K.minhash(sets.values, sets.begin, multipliers)
        levels = {d: (_nodes(sig, d) >> np.uint64(32)).astype(np.uint32) for d in range(SHALLOWEST, DEEPEST + 1)}

        def depths(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            depth = np.zeros(len(i), np.int8)
            for at in range(0, len(i), 1 << 14):
                x, y, of = i[at : at + (1 << 14)], j[at : at + (1 << 14)], depth[at : at + (1 << 14)]
                left = np.arange(len(x))
                for d, nodes in levels.items():  # who differs at a depth differs deeper
                    left = left[(nodes[x[left]] == nodes[y[left]]).any(1)]
                    of[left] = d
            return depth

        def linked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            depth = depths(i, j)
            settled = np.zeros(len(sets.size), bool)
            links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for d in range(DEEPEST, SHALLOWEST - 1, -1):
                ask = np.flatnonzero((depth == d) & ~(settled[i] & settled[j]))
                score = sets.jaccard(i[ask], j[ask], threshold)
                ask, score = ask[score >= threshold], score[score >= threshold]
                links.append((i[ask], j[ask], score))
                x, y, s = (np.concatenate(c) for c in zip(*links))
                hits, expected = np.zeros(len(settled)), np.zeros(len(settled))
                for end in (x, y):
                    hits += np.bincount(end, minlength=len(settled))
                    expected += np.bincount(end, 1 / chance(s, d), len(settled))
                settled = hits >= target * (expected + unseen[d])
            return x, y

        return linked

    return prepare


def _alike(batch: pa.RecordBatch) -> np.ndarray:
    """Similarity of each row's set to its leader's."""
    out = np.zeros(batch.num_rows)
    for r, (a, b) in enumerate(zip(batch.column("grams").to_pylist(), batch.column("of_grams").to_pylist())):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        out[r] = common / (len(x) + len(y) - common)
    return out


def links(docs: DataFrame, base: DataFrame, threshold: float = THRESHOLD, n: int = N, target: float = TARGET) -> DataFrame:
    """(doc_id, root, links) of documents and their signatures (see ``similar.links``)."""
    payload = lambda ids: gram_sets(might(docs, ids).filter("_might"), n)
    sketch = base.select("doc_id", F.hex(F.substring("sig", 1, 4)).alias("sketch"))
    return similar.links(_trie(base), payload, _compare(threshold, target), sketch, _alike, (1 + threshold) / 2)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, target: float = TARGET) -> DataFrame:
    """See the module's docstring."""
    return _joined(one_row_per_id(two_columns(docs), "text"), threshold, n, target)


def _joined(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, target: float = TARGET) -> DataFrame:
    """The join of (doc_id, text) without ids that are null or repeat."""
    base = written(signatures(docs, n), "signatures")
    found = similar.classes(base, links(docs, base, threshold, n, target))
    zero = F.lit(0).cast("long")
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("n_links", zero).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class of documents the one with the least id, with all columns of ``docs``. Of rows that repeat an id the one that the join
    looks at stays (the least text); rows without an id are in no class and stay."""
    docs = one_row_per_id(docs, "text")
    known = _joined(two_columns(docs))
    return by_ids(docs, written(known.filter("doc_id <> class_id").select("doc_id"), "copies"), keep=False)
