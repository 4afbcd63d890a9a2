"""Quality classifier: a weak-label model over overlapping heuristic labellers, and a hashed linear scorer.

Eleven labellers, one for each sign by which prose differs from junk, vote good or bad on a whole document, each in either direction, or abstain
where the sign is unclear or the text too short for it. Any document gets the votes of most of them, so their agreement, counted over all
documents by vote pattern, is all that expectation-maximisation needs to estimate, without any label, how often each is right on
good and on bad documents (a labeller that sees one kind of junk only is seldom right on bad ones, and its good votes then say little).
It starts from the share of good votes. The posterior of a document's pattern then is the label from which a logistic scorer over
hashed features (words, word shapes, repeats) learns; the scorer rates every document. It is fitted on about ``TRAIN_ROWS`` different texts
at most, drawn by a hash of the text; pattern counts and scores cover all.

Results (doc_id, p_quality, accept), one row for each row of the input, in no order.

Defined cases: a null text counts as empty; a text without words has probability 0 and is rejected; a null id
stays null; repeated rows and ids are rated row by row, and a text that many rows have is drawn once or not at all; other columns are
ignored; an empty table gives no rows. If no bad (or no good) document shows, every document with words is accepted at the estimated prior.
Texts are read whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import ragged

TRAIN_ROWS = 8000
DIMENSIONS = 1 << 15
ACCEPT = 0.2  # low, as a good document lost costs more than a poor one kept
GOOD, BAD, ABSTAIN = 1, 0, 2  # digits of a vote pattern
LABELLERS = ("symbols", "glued_marks", "bare_marks", "capitals", "exclamations", "repeats", "variety", "kinds", "sentences", "word_length", "function_words")

_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() or c >= 0xC3 for c in range(256)])
_MARK = np.array([c < 128 and not chr(c).isalnum() and c > 32 and chr(c) not in ".,;:'\"!?()-" for c in range(256)])
_STOP = np.array([chr(c) in ".!?" for c in range(256)])
#: Word shapes: lower case and all beyond ASCII are one class, upper case one, digits one, other marks themselves.
_SHAPE = np.array([97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], dtype=np.uint8)

FUNCTION_WORDS = """the of and to in is was for that with as on by at from this be it are a an or der die das und ist von
zu mit den im ein eine für auf dem nicht sich des le la les de et un une que est en pour dans qui sur avec par pas el los
las y del que por con para su al se lo como es""".split()


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    tokens = K.Tokens(data, np.array([0, len(data)]), K.NONSPACE)
    return np.unique(K.Ranges(data).hash(tokens.start, tokens.end))


def member(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are among the chosen, which are sorted and few."""
    at = np.searchsorted(chosen, values)
    return chosen[np.minimum(at, len(chosen) - 1)] == values


_FUNCTION = _hashes(FUNCTION_WORDS)


class Page:
    """What both the labellers and the scorer need of one slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        small = K.lower(data)
        self.tokens = K.Tokens(data, offsets, K.NONSPACE)
        self.words = K.Tokens(small, offsets, K.ALNUM)
        self.hash = K.Ranges(small).hash(self.words.start, self.words.end)
        first = self.words.first[:-1][self.words.counts > 0]
        self.again = np.zeros(len(self.hash), bool)
        self.again[1:] = self.hash[1:] == self.hash[:-1]
        self.again[first] = False

    def votes(self) -> np.ndarray:
        data, offsets, tokens, words = self.data, self.offsets, self.tokens, self.words
        n, t = np.maximum(words.counts, 1), np.maximum(tokens.counts, 1)
        letters = np.maximum(K.sums(_LETTER[data], offsets), 1)
        chars = np.maximum(K.sums((tokens.end - tokens.start), tokens.first), 1)
        marks = K.sums(_MARK[data], offsets) / chars
        capitals = K.sums(_UPPER[data], offsets) / letters
        again = K.sums(self.again, words.first) / n
        keys = np.sort((words.row().astype(np.uint64) << np.uint64(44)) | (self.hash >> np.uint64(20)))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        kinds = K.sums(new, words.first)
        variety = kinds / np.sqrt(n)
        ends = K.sums(_STOP[data[tokens.end - 1]], tokens.first) / t
        length = K.sums(words.end - words.start, words.first) / n
        function = K.sums(member(self.hash, _FUNCTION), words.first) / n
        alnum = np.concatenate([[0], np.cumsum(K.ALNUM[data])])
        bare = K.sums(alnum[tokens.end] == alnum[tokens.start], tokens.first) / t
        bangs = K.sums(data == 33, offsets) / t

        marked = np.concatenate([[0], np.cumsum(_MARK[data])])
        glued = K.sums((marked[tokens.end] > marked[tokens.start]) & (alnum[tokens.end] > alnum[tokens.start]), tokens.first) / t
        share, size = kinds / n, words.counts
        #: What a labeller calls bad, what it calls good, and the words from which on it votes at all.
        rules = [
            (marks > 0.05, marks < 0.01, 5),
            (glued > 0.1, glued < 0.02, 5),
            (bare > 0.1, bare < 0.02, 5),
            (capitals > 0.2, capitals < 0.08, 5),
            (bangs > 0.1, bangs < 0.02, 5),
            (again > 0.05, again < 0.02, 5),
            ((variety < 4) & (share < 0.6), variety > 6, 20),
            (share < 0.3, (share > 0.4) & (share < 0.9), 50),
            ((ends < 0.02) | (ends > 0.3), (ends > 0.04) & (ends < 0.15), 20),
            ((length < 4) | (length > 7), (length > 4.3) & (length < 6), 5),
            (function < 0.1, (function > 0.2) & (function < 0.45), 10),
        ]
        return np.stack([np.where(size < least, ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))).astype(np.uint8) for bad, good, least in rules], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature of every occurrence, and the index of each row's first: words, shapes of tokens, repeats."""
        cut = np.uint64(64 - DIMENSIONS.bit_length() + 1)
        shape = K.Ranges(_SHAPE[self.data]).hash(self.tokens.start, self.tokens.end)
        kinds = [(K.mix(self.hash) >> cut, self.words), (K.mix(shape + np.uint64(1)) >> cut, self.tokens)]
        repeat = np.where(self.again, 1, 0).astype(np.uint64)
        kinds.append((repeat, self.words))
        total = sum(t.counts for _, t in kinds)
        begin = np.concatenate([[0], np.cumsum(total)])
        out, at = np.zeros(begin[-1], np.int32), begin[:-1].copy()
        for value, t in kinds:
            out[np.repeat(at - t.first[:-1], t.counts) + np.arange(t.first[-1])] = value
            at += t.counts
        return out, begin


def patterns(docs: DataFrame, text_col: str) -> dict[str, int]:
    """Documents by vote pattern, of those that have words; at most 3 ** 11 patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, int] = {}
        for batch in batches:
            for _, _, data, offsets in K.texts(batch.column(0)):
                page = Page(data, offsets)
                keys, n = np.unique(page.votes()[page.words.counts > 0] + 48, axis=0, return_counts=True)
                for k, c in zip(keys, n.tolist()):
                    count[k.tobytes()] = count.get(k.tobytes(), 0) + c
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select(text_col).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in counted.collect()}


def label_model(counts: dict[str, int], rounds: int = 500) -> tuple[float, np.ndarray, dict[str, float]]:
    """(prior of good, 2 x labellers: how often a vote is right on bad and on good documents, posterior of good by pattern), by
    expectation-maximisation. A labeller that abstains says nothing. The better-than-chance assumption, which tells the classes apart, is in
    the start and in a weak prior of 0.8."""
    order = sorted(counts)
    votes = np.array([[int(c) for c in p] for p in order], dtype=int).reshape(len(order), len(LABELLERS))
    n = np.array([counts[p] for p in order], float)
    good, bad = 1.0 * (votes == GOOD), 1.0 * (votes == BAD)
    p = (good.sum(1) + 1) / (good.sum(1) + bad.sum(1) + 2)
    accuracy, prior = np.full((2, len(LABELLERS)), 0.8), 0.5
    for _ in range(rounds):
        of_bad, of_good = n * (1 - p), n * p
        right, wrong = np.stack([of_bad @ bad, of_good @ good]), np.stack([of_bad @ good, of_good @ bad])
        accuracy = (right + 1) / (right + wrong + 1.25)
        prior = float((of_good.sum() + 1) / (n.sum() + 2))
        odds = np.log(prior / (1 - prior)) + good @ np.log(accuracy[1] / (1 - accuracy[0])) + bad @ np.log((1 - accuracy[1]) / accuracy[0])
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - p).max(initial=0) < 1e-9
        p = new
        if done:
            break
    return prior, accuracy, dict(zip(order, p.tolist()))


def distinct(features: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct features and their values, and the index of each row's first."""
    sizes = np.diff(begin)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    pairs, count = np.unique(row * DIMENSIONS + features, return_counts=True)
    own = pairs // DIMENSIONS
    value = np.sqrt(count / sizes[own])  # the square root keeps rare marks of poor text from drowning
    return (pairs % DIMENSIONS).astype(np.uint16), value.astype(np.float32), np.searchsorted(own, np.arange(len(sizes) + 1))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights and bias of a logistic model of the weighted features of a row, by Adam over the whole sample."""
    weights = np.zeros(DIMENSIONS + 1)
    if not len(rows):
        return weights
    sizes = np.array([len(f) for f, _ in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    col, value = (np.concatenate(x) for x in zip(*rows))
    begin = np.cumsum(sizes) - sizes
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 1e-3), 0.5 / max((target <= 0.5).mean(), 1e-3))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        z = np.add.reduceat(value * weights[col], begin) + weights[-1]
        g = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        grad = np.bincount(col, value * g[row], DIMENSIONS + 1)
        grad[-1] = g.sum()
        grad[:-1] += 1e-5 * weights[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weights -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights


def rate(weights: np.ndarray, features: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Probability of good for each row; 0 for rows without features."""
    sizes = np.diff(begin)
    out = np.zeros(len(sizes))
    have = np.flatnonzero(sizes)
    if len(have):
        col, value, first = distinct(features, begin)
        z = np.bincount(np.repeat(np.arange(len(sizes)), np.diff(first)), value * weights[col], len(sizes)) + weights[-1]
        out[have] = (1 / (1 + np.exp(-np.clip(z, -50, 50))))[have]
    return out


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The scorer's weights, from all documents' votes and a bounded sample's posterior labels."""
    counts = patterns(docs, text_col)
    prior, _, posterior = label_model(counts)
    total = sum(counts.values())
    # By the text, so that ids that are null or repeat make no difference; a text that is drawn counts once, which bounds what the driver gets.
    draw = F.xxhash64(F.lit(6), F.col(text_col))
    sample = docs.select(draw.alias("draw"), F.col(text_col).alias("text")).filter(F.col(text_col).isNotNull())
    if total > train_rows:
        share = int(train_rows / total * (1 << 32))
        sample = sample.filter(F.pmod("draw", F.lit(1 << 32)) < share)
    sample = sample.groupBy("draw").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.texts(batch.column(1)):
                page = Page(data, offsets)
                features, begin = page.features()
                label = [posterior.get(bytes(v + 48).decode(), prior) for v in page.votes()]
                keep = pa.array(page.words.counts > 0)
                col, value, first = distinct(features, begin)
                columns = [ragged(col, first), ragged(value, first), pa.array(label, pa.float64())]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["features", "values", "label"])

    drawn = sample.mapInArrow(run, "features binary, values binary, label double").toArrow()
    target = drawn.column("label").to_numpy()
    cols, values = drawn.column("features").to_pylist(), drawn.column("values").to_pylist()
    order = sorted(range(len(cols)), key=lambda i: (len(cols[i]), cols[i], values[i]))  # whatever order tasks ended in
    rows = [(np.frombuffer(cols[i], np.uint16), np.frombuffer(values[i], np.float32)) for i in order]
    if not len(target) or target.min() > 0.5 or target.max() <= 0.5:
        weights = np.zeros(DIMENSIONS + 1)
        weights[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return weights
    return fit_linear(rows, target[order])


def _rated(batch: pa.RecordBatch, text: str, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(batch.num_rows)
    for i, j, data, offsets in K.texts(batch.column(text)):
        page = Page(data, offsets)
        p = rate(weights, *page.features())
        out[i:j] = np.where(page.words.counts > 0, p, 0.0)
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """See the module's docstring."""
    weights = fit(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.round(_rated(batch, "text", weights), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= ACCEPT)], ["doc_id", "p_quality", "accept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, p_quality double, accept boolean")


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    weights = fit(docs, text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            yield batch.filter(pa.array(_rated(text, "text", weights) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
