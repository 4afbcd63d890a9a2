"""URL filters as a sort-merge range join with a stack of nested rules.

A URL's canonical key is its host's labels in reverse, each followed by a comma, then its path and query: a rule
for a domain (all its subdomains with it) or for a host and path prefix is a prefix of keys, hence one interval of
the key order. Pages and rules are cut into ranges of keys at sampled boundaries, a rule that spans several ranges being
copied to each; a key that many pages have is a range by itself, dealt out in turn to as many sweeps as it has shares of the sample. Every range is swept in order: rules whose prefix has ended are popped, rules that begin are
pushed, so that the stack holds just the rules that apply to the page at hand, the most specific on top.

Results (page_id, url, rule_id, action, n_rules), one row per page: the most specific rule, and how many apply; where none
does, rule and action are null and n_rules is 0.

Defined cases: a null, empty or unparsable URL matches no rule; null page ids stay null; repeated pages are each looked
up; of rules with the same prefix the least id counts as the most specific; rules without a pattern or id are left out;
without rules every page has none; other columns are ignored; without pages there are no rows. Keys compare byte by byte, at any length.
A range is read in order and never held, so its size is no matter of memory.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages in a range, on average, as long as there are no more than the most ranges; ranges are larger beyond. So the sample of keys that
#: the driver sorts (about ``MOST_RANGES * SAMPLES_PER_RANGE`` at most) and the boundaries that tasks keep are bounded.
PAGES_PER_RANGE = 20_000
MOST_RANGES = 2048
SAMPLES_PER_RANGE = 50

RULES = (
    (1, "example.com", "allow"),
    (2, "casino-win.example.com", "block"),
    (3, "free-bets.example.com", "block"),
    (4, "ads-track.example.com", "block"),
    (5, "adult-x.example.net", "block"),
    (6, "adult-x.example.net/en/", "review"),
    (7, "example.net/de/", "review"),
    (8, "blog.tionsh.example.com", "allow"),
    (9, "blog.tionsh.example.com/fr/", "block"),
    (10, "blog.tionsh.example.com/fr/1", "review"),
    (11, "org", "allow"),
    (12, "tionble.example.org/en/9", "block"),
    (13, "casino-win.example.com/en/", "block"),
    (14, "tracker.invalid", "block"),
)
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def key(url: Column) -> Column:
    """Canonical key; null where there is no host."""
    host = F.lower(F.regexp_extract(url, SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.$", "")
    rest = F.regexp_extract(url, SCHEME + r"[^/?#]*([^#]*)", 1)
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.length(host) > 0, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","), path))


def prefix(pattern: str) -> str:
    """The key prefix of a rule ``host`` or ``host/path``."""
    host, slash, path = pattern.partition("/")
    host = host.lower().removeprefix("www.").rstrip(".")
    return "".join(f"{label}," for label in reversed(host.split("."))) + slash + path


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    rows = [(i, prefix(p), a) for i, p, a in rules if i is not None and p]
    return spark.createDataFrame(rows, "rule_id long, prefix string, action string")


class Ranges:
    """Half-open intervals of keys between sorted boundaries. A boundary that is drawn several times begins a range of that key alone, which has
    so many sweeps."""

    def __init__(self, drawn: list[bytes]):
        self.bounds: list[bytes] = []
        self.sweeps = [1]
        for k in sorted(set(drawn)):
            times = drawn.count(k)
            self.bounds.append(k)
            self.sweeps.append(times)
            if times > 1:
                self.bounds.append(k + b"\0")  # the next key in order
                self.sweeps.append(1)
        self.first = np.concatenate([[0], np.cumsum(self.sweeps)])[:-1]


def _ranges(ranges: Ranges, prefixes: bool):
    """Adds the sweep of a page's key, or a row for each sweep that a rule's interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        many = np.array(ranges.sweeps)
        for batch in batches:
            keys = [k.encode() for k in batch.column("key").to_pylist()]
            low = np.array([bisect_right(ranges.bounds, k) for k in keys], dtype=np.int64)
            if prefixes:
                # 0xFF stands in no UTF-8 text, so this is above every key with the prefix.
                high = np.array([bisect_right(ranges.bounds, k + b"\xff") for k in keys], dtype=np.int64)
                begin, end = ranges.first[low], ranges.first[high] + many[high]
            else:
                begin = ranges.first[low] + (turn + np.arange(len(keys))) % many[low]
                end = begin + 1
                turn += len(keys)
            times = end - begin
            rows = np.repeat(np.arange(len(keys)), times)
            at = begin[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int64())], [*taken.schema.names, "range"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, int, str]] = []
    current = None
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("range", "key", "kind", "rule_id", "action", "page_id", "url"))
        for at, k, kind, rule, action, page, url in zip(*columns):
            if at != current:
                stack, current = [], at
            while stack and not k.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((k, rule, action))
            else:
                top = stack[-1] if stack else (None, None, None)
                out.append((page, url, top[1], top[2], len(stack)))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32()))], ["page_id", "url", "rule_id", "action", "n_rules"])


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """See the module's docstring. rules: rule_id, prefix, action."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), key(F.col("url")).alias("key"))
    keyed = rows.filter("key IS NOT NULL")
    n = pages.count()
    many = min(MOST_RANGES, max(1, -(-n // PAGES_PER_RANGE)))
    ranges = Ranges([])
    if many > 1:
        share = min(1.0, many * SAMPLES_PER_RANGE / n)
        drawn = sorted(r["key"].encode() for r in keyed.select("key").sample(share, 8).collect())
        ranges = Ranges([drawn[len(drawn) * i // many] for i in range(1, many)] if drawn else [])
    page_rows = keyed.mapInArrow(_ranges(ranges, False), "page_id long, url string, key string, range long")
    rule_rows = rules.filter("rule_id IS NOT NULL AND length(prefix) > 0").select("rule_id", "action", F.col("prefix").alias("key"))
    rule_rows = rule_rows.mapInArrow(_ranges(ranges, True), "rule_id long, action string, key string, range long")
    both = page_rows.select("range", "key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("action"), "page_id", "url")
    both = both.union(rule_rows.select("range", "key", F.lit(0), "rule_id", "action", F.lit(None).cast("long"), F.lit(None).cast("string")))
    swept = both.repartition("range").sortWithinPartitions("range", "key", "kind", F.desc("rule_id"))
    found = swept.mapInArrow(_sweep, "page_id long, url string, rule_id long, action string, n_rules int")
    none = rows.filter("key IS NULL").select("page_id", "url", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(0))
    return found.union(none)
