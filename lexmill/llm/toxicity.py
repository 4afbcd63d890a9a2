"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features, all per document and over the whole text: densities of three lexicons (insults, threats, obscenities) and of a
fourth, drawn up from labelled documents, how much of them stands near a second-person pronoun, the share of capitals, of exclamation and question marks and of runs of
them, of words spelt with digits or marks inside, of such words that are lexicon words when read plainly, and of words
with a letter three times in a row. The fourth lexicon is there because nobody can list the insults of every language beforehand: words, and
beginnings of words, that are ``LEARN_RATIO`` times as frequent in toxic documents as in others. Trees only see its densities.
At most ``LABELLED_ROWS`` labelled documents, drawn by a hash of their id, fit all: a quarter
of them teaches the fourth lexicon, a half the trees (logistic loss, histogram splits), and a quarter calibrates the score by pooling adjacent
violators. Every document is then scored.

Results (doc_id, p_toxic, toxic), one row for each row of the input.

Defined cases: null text counts as empty and has the probability that calibration gives to all-zero features; a null id stays
null; repeated rows are scored row by row; labels that are null, or contradict each other for an id, are not used, nor do equal texts with
opposite labels teach the lexicon; of rows that repeat a labelled id the least text is learnt from; without labels of both classes every score is the share of toxic labels (0 without any); other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import written
from lexmill.llm.quality import _hashes, member

LABELLED_ROWS = 24_000
#: A unit is learnt if that many toxic documents have it and it is so many times as frequent in them as in others.
LEARN_FROM, LEARN_RATIO = 3, 8.0
STEMS = (4, 5)
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 20
TOXIC = 0.5
NEAR = 6

INSULTS = """idiot idiots idiotic moron morons moronic stupid imbecile cretin dumb dumbass fool foolish loser losers clown clowns trash
garbage scum scumbag filth filthy vermin pathetic worthless useless disgusting repulsive revolting ugly pig swine rat parasite
coward liar freak weirdo creep jerk dolt dunce halfwit nitwit airhead simpleton brainless clueless degenerate lowlife
wretch despicable contemptible vile subhuman crybaby twat wanker prick bastard idiota imbécil estúpido estúpida basura payaso
inútil asqueroso crétin imbécile débile ordure connard abruti dummkopf trottel depp arschloch dreck abschaum versager""".split()
THREATS = """kill killed die murder shoot stab hang burn strangle destroy hurt beat punch smash suffer rot bleed lynch
gas exterminate annihilate execute töten sterben umbringen matar morir tuer mourir crever""".split()
OBSCENITIES = """fuck fucking fucked fucker shit shitty bullshit crap damn ass asshole bitch bitches cunt dick cock piss slut whore
hell mierda puta cabrón joder merde putain salope scheiße scheisse fotze hure verdammt""".split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú usted te ti tus su".split()

NAMES = ("insult", "threat", "obscene", "learnt", "near_you", "insults", "learnts", "capitals", "bangs", "runs", "mixed", "disguised", "stretched", "log_words")
_LEXICONS = tuple(_hashes(w) for w in (INSULTS, THREATS, OBSCENITIES))
_ALL, _YOU = np.unique(np.concatenate(_LEXICONS)), _hashes(SECOND_PERSON)
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() or c >= 0xC3 for c in range(256)])
_PLAIN = np.array([ord({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}.get(chr(c), chr(c))) for c in range(256)], dtype=np.uint8)
_INSIDE = np.array([K.ALNUM[c] or chr(c) in "$@!*" for c in range(256)])


def units(small: np.ndarray, words: K.Tokens, ranges: K.Ranges) -> list[np.ndarray]:
    """Hashes of the words, and of the first characters of those that are longer than a stem (0 for the others)."""
    out = [ranges.hash(words.start, words.end)]
    begins = np.append(np.flatnonzero((small & 0xC0) != 0x80), len(small))  # of characters, which may have several bytes
    first = np.searchsorted(begins, words.start)
    for n in STEMS:
        end = begins[np.minimum(first + n, len(begins) - 1)]
        longer = end < words.end
        out.append(np.where(longer, ranges.hash(words.start, np.where(longer, end, words.end)) + np.uint64(n), 0))
    return out


def features(data: np.ndarray, offsets: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """Rows x len(NAMES). learnt: sorted hashes of the fourth lexicon."""
    small = K.lower(data)
    words = K.Tokens(small, offsets, K.ALNUM)
    own = units(small, words, K.Ranges(small))
    hashes = own[0]
    n = np.maximum(words.counts, 1)
    hits = [member(hashes, lexicon) for lexicon in _LEXICONS]
    hits.append(np.any([member(u, learnt) for u in own], axis=0) if len(learnt) else np.zeros(len(hashes), bool))
    any_hit = hits[0] | hits[1] | hits[2] | hits[3]
    row = words.row()
    you = np.flatnonzero(member(hashes, _YOU))
    near = np.zeros(len(hashes), bool)
    hit = np.flatnonzero(any_hit)
    if len(you) and len(hit):
        after = np.searchsorted(you, hit)
        for at in (np.maximum(after - 1, 0), np.minimum(after, len(you) - 1)):  # the nearest on either side
            near[hit] |= (np.abs(you[at] - hit) <= NEAR) & (row[you[at]] == row[hit])
    # Words as they may be disguised: letters among digits or marks, read plainly.
    spelt = K.Tokens(data, offsets, _INSIDE)
    letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
    letters = letter[spelt.end] - letter[spelt.start]
    odd = (letters > 0) & (letters < spelt.end - spelt.start)
    middle = odd & _LETTER[data[spelt.start]] & _LETTER[data[spelt.end - 1]]
    plain = np.zeros(len(odd), bool)
    if odd.any():
        plain[odd] = member(K.Ranges(_PLAIN[small]).hash(spelt.start[odd], spelt.end[odd]), _ALL)
        clean = member(K.Ranges(small).hash(spelt.start[odd], spelt.end[odd]), _ALL)
        plain[odd] &= ~clean
    bang = (data == 33) | (data == 63)
    doubled = np.zeros(len(data), bool)
    doubled[1:] = bang[1:] & bang[:-1]
    triple = np.zeros(len(data), bool)
    triple[2:] = (small[2:] == small[1:-1]) & (small[1:-1] == small[:-2]) & _LETTER[small[2:]]
    total = np.maximum(K.sums(_LETTER[data], offsets), 1)
    counts = [K.sums(h, words.first) for h in hits]
    out = [1000 * c / n for c in counts]
    out += [1000 * K.sums(near, words.first) / n, np.log1p(counts[0]), np.log1p(counts[3]), K.sums(_UPPER[data], offsets) / total]
    out += [K.sums(bang, offsets) / n, K.sums(doubled, offsets) / n, K.sums(middle, spelt.first) / n, 1000 * K.sums(plain, spelt.first) / n]
    out += [1000 * K.sums(triple, offsets) / n, np.log1p(words.counts)]
    return np.stack(out, axis=1).astype(np.float64)


class Boosted:
    """Depth-limited regression trees on binned features, boosted on the logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.concatenate([[0.0], np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])])) for c in x.T]
        binned = self.bins(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self._walk(tree, binned)
        return self

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) >= 2 * LEAST:
            for f in range(b.shape[1]):
                k, size = b[rows, f], len(self.edges[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(k, w, size))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            return RATE * gs / (hs + 1)
        f, cut = best[1]
        left = b[rows, f] <= cut
        return (f, cut, self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _walk(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, cut, low, high = tree
        return np.where(b[:, f] <= cut, self._walk(low, b), self._walk(high, b))

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(b)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability) of the non-decreasing fit, to be joined by lines; equal scores are one point."""
    at, inverse = np.unique(score, return_inverse=True)
    total, n = np.bincount(inverse, y), np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []
    for i in range(len(at)):
        blocks.append([total[i], n[i], at[i], at[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, last = blocks.pop()
            blocks[-1][3] = last
            blocks[-1][0] += s
            blocks[-1][1] += c
    return np.array([x for b in blocks for x in b[2:]]), np.repeat([b[0] / b[1] for b in blocks], 2)


class Model:
    def __init__(self, learnt: np.ndarray, trees: Boosted | None, steps: tuple[np.ndarray, np.ndarray], share: float):
        self.learnt, self.trees, self.steps, self.share = learnt, trees, steps, share

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        return np.interp(self.trees.score(features(data, offsets, self.learnt)), *self.steps)


def learn(chosen: DataFrame) -> np.ndarray:
    """Units of the fourth lexicon, from (toxic, text) of the rows that teach it; equal texts count once, or not at all if their labels differ."""
    once = chosen.groupBy("text").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("toxic", "text")
    toxic, total = once.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.texts(batch.column("text")):
                small = K.lower(data)
                words = K.Tokens(small, offsets, K.ALNUM)
                row = words.row()
                found = np.unique(np.concatenate([np.stack([row.astype(np.uint64), u], 1) for u in units(small, words, K.Ranges(small))]), axis=0)
                found = found[found[:, 1] != 0]
                marks = batch.column("toxic").slice(i, j - i).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 1].copy().view(np.int64)), pa.array(marks[found[:, 0].astype(np.int64)], pa.int32())], ["unit", "toxic"])

    counted = once.select("toxic", "text").mapInArrow(run, "unit long, toxic int").groupBy("unit").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    often = (F.col("t") + 0.5) / (toxic + 1.0) >= LEARN_RATIO * (F.col("n") - F.col("t") + 0.5) / (total - toxic + 1.0)
    kept = counted.filter((F.col("t") >= LEARN_FROM) & often).select("unit").toPandas()["unit"]
    return np.sort(kept.to_numpy(np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From (doc_id, text) and (doc_id, toxic); the draw is bounded, whatever the number of labels."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", "toxic")
    drawn = marks.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(LABELLED_ROWS)
    part = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).alias("part")
    # The limit bounds what is broadcast.
    drawn = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    chosen = written(drawn.select("doc_id", "toxic", "text", part), "labelled")
    learnt = learn(chosen.filter("part = 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.texts(batch.column("text")):
                x = features(data, offsets, learnt)
                columns = [batch.column(c).slice(i, j - i) for c in ("doc_id", "toxic", "part")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in x.T)], ["doc_id", "toxic", "part", *NAMES])

    rows = chosen.filter("part > 0").mapInArrow(run, "doc_id long, toxic int, part long, " + ", ".join(f"{n} double" for n in NAMES)).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x, y, last = rows[list(NAMES)].to_numpy(), rows["toxic"].to_numpy().astype(float), rows["part"].to_numpy() == 3
    if len(y) < 50 or not 0 < y[~last].mean() < 1 or not last.any():
        return Model(learnt, None, (np.zeros(1), np.zeros(1)), float(y.mean()) if len(y) else 0.0)
    trees = Boosted().fit(x[~last], y[~last])
    return Model(learnt, trees, isotonic(trees.score(x[last]), y[last]), 0.0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """See the module's docstring."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    model = fit(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for i, j, data, offsets in K.texts(batch.column("text")):
                p[i:j] = model(data, offsets)
            p = np.round(p, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= TOXIC)], ["doc_id", "p_toxic", "toxic"])

    return rows.mapInArrow(run, "doc_id long, p_toxic double, toxic boolean")
