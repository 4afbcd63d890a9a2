"""Secret scans by grammar inference: probabilistic automata learnt from labelled credentials.

Labelled credentials (format, value) fill one prefix tree per format over character classes. Level by level, states
whose distributions of next symbol and of ending are statistically compatible (Hoeffding's bound, on them and recursively on what
follows each symbol) merge into the level's most frequent state that they fit, so that the result is a
small probabilistic automaton that keeps lengths and fixed marks. Marks that all examples of a format hold equally often
cut a value into fields; where a field's length varies, a loop reads what goes on beyond the shortest example, with the
probabilities of staying and of leaving that the examples give, so that longer fields than any example's are read too.
Every maximal run of at least ``SHORTEST`` credential characters is read from its start and from behind each separator
(``/``, ``:``, ``=``), and ends before each separator or with the run, with and without the marks ``.:=-`` there; each
such span of ``SHORTEST`` characters or more is a candidate and is scored by each automaton, as log likelihood against a
model of ordinary characters. It is a secret of the most likely format if that passes the format's threshold, the least
score of held-out labelled examples less a margin; a run without a digit may only hold formats whose first character was
learnt, as words in capitals look like keys that have no mark of their own; of secrets that overlap the likeliest
counts. Reading stops where no continuation can pass any more, so that the work grows with a run's length.

Results (doc_id, start, length, format, score), one row per secret; ``start`` counts characters from 0. The value isn't
repeated in the result. ``redacted`` returns the texts with each secret replaced by ``<SECRET>``.

Defined cases: null and empty texts have no secrets; a null id stays null; the same secret in two places or rows is
reported each time; of formats that score alike the first by name counts; other columns are ignored; an empty table
gives no rows. Runs of any length are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernel as K

SHORTEST = 16
CANDIDATE = r"[A-Za-z0-9_+/=.:\-]{16,}"
ALPHA, RARE, SMOOTH, MARGIN = 0.05, 6, 0.01, 6.0
EXAMPLES = 300
#: A last field of up to so many lengths, none of them rare, keeps them.
FEW = 3
#: What ending counts where no example ended, against 1 for each that did.
NEVER = 1e-15
END = "$"

_RUN = np.array([chr(c).isascii() and (chr(c).isalnum() or chr(c) in "_+/=.:-") for c in range(256)])
_SEPARATOR = re.compile(r"[/:=]+")
_TRAIL = ".:=-"


def symbol(c: str) -> str:
    """Character classes: digits, letters a-f and g-z in either case, and every mark as itself."""
    if c.isdigit():
        return "0"
    if c.isalpha():
        return ("a" if c in "abcdef" else "g") if c.islower() else ("A" if c in "ABCDEF" else "G")
    return c


#: Ordinary characters: how likely lower case, upper case, a digit or a mark is after one of these. Words in one case, numbers and paths are
#: likely, runs that change between kinds at random are not.
KINDS = ("lower", "upper", "digit", "mark")
AFTER = {"lower": (0.93, 0.01, 0.03, 0.03), "upper": (0.2, 0.72, 0.05, 0.03), "digit": (0.08, 0.04, 0.8, 0.08), "mark": (0.6, 0.2, 0.15, 0.05)}
_KIND = {"0": "digit", "a": "lower", "g": "lower", "A": "upper", "G": "upper"}
_WITHIN = {"0": 1.0, "a": 0.3, "g": 0.7, "A": 0.3, "G": 0.7}
_MARKS = 8
#: The most that a character which the automaton has never read in this state may add.
UNSEEN = -2.0


def background(kind: str, s: str) -> float:
    """Log probability of a symbol after a character of some kind."""
    return math.log(AFTER[kind][KINDS.index(_KIND.get(s, "mark"))] * _WITHIN.get(s, 1 / _MARKS))


class Automaton:
    """moves[state][symbol] = (next state, probability); ends[state] = probability of ending there."""

    def __init__(self, moves: list[dict[str, tuple[int, float]]], ends: list[float], literal: list[dict[str, dict[str, float]]], unseen: list[float], loops: set[int]):
        self.moves, self.ends, self.literal, self.unseen, self.loops = moves, ends, literal, unseen, loops
        # A character that no example has here counts as a rare one, in the place of the most frequent.
        self.ahead = [state if state in loops or not m else max(m.values(), key=lambda x: (x[1], -x[0]))[0] for state, m in enumerate(moves)]
        self.steps: dict[tuple[int, str, str], tuple[int, float, str]] = {}
        self.most = self._most()

    def step(self, state: int, kind: str, c: str) -> tuple[int, float, str]:
        """The next state, what the character adds to the score after one of this kind, and its own kind."""
        if (known := self.steps.get((state, kind, c))) is None:
            s = symbol(c)
            to, p = self.moves[state].get(s, (self.ahead[state], self.unseen[state]))
            if to == state and state in self.loops and s in self.moves[state]:
                gain = 0.0  # how long a loop goes on is no evidence, else any long run would be a secret
            else:
                letters = self.literal[state].get(s)
                # Within a class: how this state's fixed characters (prefixes) favour one letter; else uniform.
                inside = letters.get(c, SMOOTH) * _SIZE.get(s, 1) if letters else 1.0
                gain = math.log(p * inside) - background(kind, s)
                if s not in self.moves[state]:
                    gain = min(gain, UNSEEN)
            known = self.steps[state, kind, c] = to, gain, _KIND.get(s, "mark")
        return known

    def _most(self) -> list[float]:
        """The most that can be added from each state to the end. States only lead to later ones or to themselves."""
        most = [0.0] * len(self.moves)
        for state in reversed(range(len(self.moves))):
            steps = [self.step(state, kind, c) for c in _EXAMPLE for kind in KINDS]
            fixed = [self.step(state, kind, c) for s in self.literal[state].values() for c in s for kind in KINDS]
            most[state] = max(math.log(self.ends[state]), *(gain + most[to] for to, gain, _ in [*steps, *fixed] if to != state), -math.inf)
            if any(to == state and gain > 0 for to, gain, _ in steps):
                most[state] = math.inf
        return most

    def spans(self, value: str, start: int, ends: set[int], least: float) -> Iterator[tuple[int, float]]:
        """(end, score) of the spans from ``start`` that score ``least`` or more."""
        state, total, kind = 0, 0.0, "mark"
        for at in range(start, len(value)):
            state, gain, kind = self.step(state, kind, value[at])
            total += gain
            if total + self.most[state] < least:
                return
            if at + 1 in ends and total + math.log(self.ends[state]) >= least:
                yield at + 1, total + math.log(self.ends[state])

    def score(self, value: str) -> float:
        """Log likelihood ratio of the whole value against ordinary characters."""
        state, total, kind = 0, 0.0, "mark"
        for c in value:
            state, gain, kind = self.step(state, kind, c)
            total += gain
        return total + math.log(self.ends[state])


_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}
#: One character of each class, and every mark.
_EXAMPLE = "0agAG_+/=.:-"


def compatible(a: Counter, b: Counter, alpha: float = ALPHA) -> bool:
    """Whether two states' counts of next symbols may come from one distribution, by Hoeffding's bound."""
    n, m = a.total(), b.total()
    if not n or not m:
        return True
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return all(abs(a[s] / n - b[s] / m) <= bound for s in a.keys() | b.keys())


def _parts(values: list[str]) -> list[tuple[list[str], list[str] | None]]:
    """Parts that all values have: what is read once, of one length, and what a loop reads after it. The last part has no loop."""
    counts = {c: {v.count(c) for v in values} for c in set("".join(values)) if not c.isalnum()}
    marks = "".join(re.escape(c) for c, n in sorted(counts.items()) if len(n) == 1)
    fields = [re.split(f"(?=[{marks}])", v) if marks else [v] for v in values]
    parts: list[tuple[list[str], list[str] | None]] = []
    once = [""] * len(values)
    for k, column in enumerate(zip(*fields)):
        lengths = Counter(map(len, column))
        least = min(lengths)
        if len(lengths) == 1 or k == len(fields[0]) - 1 and len(lengths) <= FEW and min(lengths.values()) >= RARE:
            once = [o + c for o, c in zip(once, column)]
        else:
            parts.append(([o + c[:least] for o, c in zip(once, column)], [c[least:] for c in column]))
            once = [""] * len(values)
    return [*parts, (once, None)]


def infer(values: list[str]) -> Automaton:
    """The automaton of one format. Each level of the prefix tree is a list of bags of suffixes: merging two states
    joins their bags, which merges all that follows. All states that end a part merge into the loop that follows it."""
    moves: list[dict[str, tuple[int, float]]] = []
    ends: list[float] = []
    unseen: list[float] = []
    literal: list[dict[str, dict[str, float]]] = []
    loops: set[int] = set()
    loop: Counter = Counter()  # what the first state of this part reads again and again
    for part, tails in _parts(values):
        longest = max(map(len, part))
        level: list[list[str]] = [sorted(part)]
        for depth in range(longest + (tails is None)):
            nxt: list[list[str]] = []
            origin: list[tuple[int, str]] = []
            base = len(moves)
            for bag in level:
                split: dict[str, list[str]] = {}
                for v in bag:
                    if len(v) > depth:
                        split.setdefault(symbol(v[depth]), []).append(v)
                again = loop if depth == 0 else Counter()
                total = len(bag) + again.total()
                moves.append({s: (-1, len(vs) / (total + 1)) for s, vs in split.items()} | {s: (base, n / (total + 1)) for s, n in again.items()})
                if again:
                    loops.add(base)
                over = tails is None and sum(len(v) == depth for v in bag)
                ends.append((over + NEVER) / (total + 1))
                unseen.append(0.5 / (total + 1))
                chars = {s: Counter(v[depth] for v in vs) for s, vs in split.items()}
                fixed = {s: {c: k / n.total() for c, k in n.items()} for s, n in chars.items() if s in _SIZE and n.total() >= 5 * RARE and len(n) <= 2}
                literal.append(fixed)
                for s, vs in sorted(split.items()):
                    origin.append((len(moves) - 1, s))
                    nxt.append(vs)
            if not nxt:
                break
            # Merge what is compatible, the most frequent states first; what is compatible with none becomes a state of its own.
            order = sorted(range(len(nxt)), key=lambda i: (-len(nxt[i]), origin[i]))
            merged: list[list[str]] = []
            place: dict[int, int] = {}
            for i in order:
                if tails is not None and depth + 1 == longest:
                    at = 0 if merged else None  # all states that end a part lead into one loop
                else:
                    at = next((k for k, bag in enumerate(merged) if mergeable(bag, nxt[i], depth + 1)), None)
                if at is None:
                    at = len(merged)
                    merged.append([])
                merged[at] = merged[at] + nxt[i]
                place[i] = at
            for i, (state, s) in enumerate(origin):
                moves[state][s] = (base + len(level) + place[i], moves[state][s][1])
            level = merged
        loop = Counter(symbol(c) for t in tails or [] for c in t)
    return Automaton(moves, ends, literal, unseen, loops)


def _next(bag: list[str], depth: int) -> Counter:
    return Counter(symbol(v[depth]) if len(v) > depth else END for v in bag if len(v) >= depth)


def mergeable(a: list[str], b: list[str], depth: int) -> bool:
    """Whether two bags may come from one state: their next symbols are compatible, and so is, symbol by symbol, what follows. The recursion ends
    where either bag is too small to tell."""
    if not compatible(_next(a, depth), _next(b, depth)):
        return False
    if min(len(a), len(b)) < RARE:
        return True
    split: dict[str, tuple[list[str], list[str]]] = {}
    for side, bag in enumerate((a, b)):
        for v in bag:
            if len(v) > depth:
                split.setdefault(symbol(v[depth]), ([], []))[side].append(v)
    return all(mergeable(x, y, depth + 1) for x, y in split.values() if x and y)


def labelled(seed: int = 17, n: int = EXAMPLES) -> list[tuple[str, str]]:
    """Credentials of publicly documented formats, made from a seed: what a labelled set holds. Those that have no one length are drawn
    at many, from the shortest that the format allows."""
    rng = np.random.default_rng(seed)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    size = lambda least, most: int(least * (most / least) ** rng.random())
    makers = {
        "access_key_id": lambda: ["AKIA", "ASIA"][rng.integers(2)] + pick(up + "234567", 16),
        "cloud_api_key": lambda: "AIza" + pick(low + up + num + "_-", 35),
        "git_token": lambda: ["ghp_", "gho_", "ghs_"][rng.integers(3)] + pick(low + up + num, 36),
        "hex_32": lambda: pick("0123456789abcdef", 32),
        "hex_40": lambda: pick("0123456789abcdef", 40),
        "hex_40_upper": lambda: pick("0123456789ABCDEF", 40),
        "hex_64": lambda: pick("0123456789abcdef", 64),
        "chat_token": lambda: "xoxb-" + pick(num, size(10, 14)) + "-" + pick(num, size(10, 14)) + "-" + pick(low + up + num, 24),
        "payment_key": lambda: ["sk_live_", "rk_live_"][rng.integers(2)] + pick(low + up + num, size(24, 108)),
        "secret_key_40": lambda: pick(low + up + num + "/+", 40),
        "web_token": lambda: "eyJ" + pick(low + up + num + "_-", size(16, 120)) + "." + "eyJ" + pick(low + up + num + "_-", size(7, 900)) + "." + pick(low + up + num + "_-", size(43, 684)),
        "uuid_key": lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
    }
    return [(name, make()) for name, make in makers.items() for _ in range(n)]


class Scanner:
    """Automata and thresholds of all formats."""

    def __init__(self, examples: list[tuple[str, str]] | None = None):
        by: dict[str, list[str]] = {}
        for name, value in examples if examples is not None else labelled():
            if name is not None and value:
                by.setdefault(name, []).append(value)
        self.formats = {}
        for name, values in sorted(by.items()):
            cut = max(1, len(values) * 2 // 3)
            automaton = infer(values[:cut])
            self.formats[name] = (automaton, min(automaton.score(v) for v in values[cut:] or values) - MARGIN)
            automaton.steps.clear()  # made again where they are used

    def best(self, value: str) -> tuple[str, float] | None:
        top = None
        for name, (automaton, least) in self.formats.items():
            score = automaton.score(value)
            if score >= least and score > 0 and (top is None or score > top[1]):
                top = (name, score)
        return top

    def scan(self, value: str) -> list[tuple[int, int, str, float]]:
        """(start, end, format, score) of the secrets of a run, in order; none overlap."""
        cuts = [m.span() for m in _SEPARATOR.finditer(value)]
        starts = sorted({0, *(p for a, b in cuts for p in range(a + 1, b + 1))})
        ends = {len(value), *(p for a, b in cuts for p in range(a, b))}
        for at in range(len(value) - 1, 0, -1):  # with and without each of the marks before an end
            if at + 1 in ends and value[at] in _TRAIL:
                ends.add(at)
        hits = []
        for name, (automaton, least) in self.formats.items():
            for start in starts:
                hits += [(-score, start, -end, name) for end, score in automaton.spans(value, start, ends, max(least, 0.0)) if score > 0 and end - start >= SHORTEST]
        taken: list[tuple[int, int, str, float]] = []
        for score, start, end, name in sorted(hits, key=lambda h: (h[0], h[3], h[1], h[2])):
            if all(-end <= a or b <= start for a, b, _, _ in taken):
                taken.append((start, -end, name, -score))
        return sorted(taken)


def _candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes of every candidate of a slice."""
    runs = K.Tokens(data, offsets, _RUN)
    long = np.flatnonzero(runs.end - runs.start >= SHORTEST)
    if not len(long):
        return long, long, long
    start, end = runs.start[long], runs.end[long]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def _found(scanner: Scanner, column: pa.Array) -> Iterator[tuple[int, int, int, int, str, float]]:
    """(row, first byte within the row's text, first character, bytes, format, score), in order. A secret has one byte a character."""
    for i, _, data, offsets in K.texts(column):
        characters = None
        for r, s, e in zip(*(x.tolist() for x in _candidates(data, offsets))):
            value = data[s:e].tobytes().decode()
            for start, end, name, score in scanner.scan(value):
                if characters is None:  # counted once for all secrets of the slice
                    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                at = int(offsets[r])
                yield i + r, s + start - at, int(characters[s + start] - characters[at]), end - start, name, score


def secrets(docs: DataFrame, examples: list[tuple[str, str]] | None = None) -> DataFrame:
    """See the module's docstring."""
    scanner = Scanner(examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, before, n, name, round(score, 6)) for r, _, before, n, name, score in _found(scanner, batch.column("text"))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            ids = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], ["doc_id", "start", "length", "format", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length int, format string, score double")


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", examples: list[tuple[str, str]] | None = None) -> DataFrame:
    """The documents with their secrets replaced by <SECRET>, and their number of characters brought up to date."""
    scanner = Scanner(examples)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: dict[int, list[tuple[int, int]]] = {}
            for r, at, _, n, _, _ in _found(scanner, batch.column(place)):
                hits.setdefault(r, []).append((at, at + n))
            if hits:
                texts = batch.column(place).to_pylist()
                for r, spans in hits.items():
                    raw = texts[r].encode()
                    kept = [raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)])]
                    texts[r] = b"<SECRET>".join(kept).decode()
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        # Recounted where the text changed; a count that never matched its text is left as it was otherwise.
        out = out.withColumn(chars_col, F.when(F.contains(text_col, F.lit("<SECRET>")), F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    return out
