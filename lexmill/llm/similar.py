"""Classes of similar members: candidates that share a node meet in blocks of bounded size, where links are counted and joined up.

A similarity join gives (node, content key, id) rows; members that share a node are candidates. The name of a node is the least member
near it, and a member goes to the names of its nodes, so that near copies, which share many nodes, meet once. A name's members are cut
into parts of at most about ``PART_ROWS`` members and ``PART_WEIGHT`` weight, and each two parts meet in a block; nothing is left out, however many there are.

A group of near copies costs no such meetings among themselves: where a name has more than a part, its members are first held
against its leader (one row a member, the leader copied to every part). Distance is a metric, so two members at most half the distance allowed from their
leader are linked for sure: they are its core, counted by an aggregation, and only what is outside the core meets in blocks, with itself
and with the core. So a hot group of near copies shuffles rows in proportion to its members.

A block gives one row for each member linked in it: (id, least id that it is connected with there, number of links), so that no list of
pairs is ever written. Sums of these and the connected components of (id, least id) are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import components
from lexmill.llm.common import longs, might, pair_blocks, partitions, runs, whole_groups, written

PART_ROWS, PART_WEIGHT = 1024, 1 << 21
LINKS = "doc_id long, root long, links long"
#: From a group's columns: a function of index pairs (of whole blocks) that gives those that are links.
Compare = Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with more than one content: their members (of copies the least id) and the least of them."""
    for group in whole_groups(batches, "node"):
        node, k1, ids = (longs(group, c) for c in ("node", "k1", "doc_id"))
        fresh = np.ones(len(node), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (k1[1:] != k1[:-1])
        node, ids = node[fresh], ids[fresh]
        bounds = runs(node)
        size = np.diff(bounds)
        least = np.repeat(np.minimum.reduceat(ids, bounds[:-1]), size)
        more = np.repeat(size > 1, size)
        yield pa.RecordBatch.from_arrays([pa.array(node[more]), pa.array(ids[more]), pa.array(least[more])], ["node", "doc_id", "least"])


def places(nodes: DataFrame) -> DataFrame:
    """(doc_id, name) of members that share a node with another content, from (node, k1, doc_id)."""
    rows = written(nodes.repartition("node").sortWithinPartitions("node", "k1", "doc_id").mapInArrow(_shared, "node long, doc_id long, least long"), "nodes")
    label = rows.groupBy("doc_id").agg(F.min("least").alias("label"))
    name = rows.join(label, "doc_id").groupBy("node").agg(F.min("label").alias("name"))
    return written(rows.select("node", "doc_id").join(name, "node").select("doc_id", "name").distinct(), "places")


def _cores(placed: DataFrame, have: DataFrame, sketch: DataFrame, alike: Callable[[pa.RecordBatch], np.ndarray], tight: float) -> DataFrame | None:
    """(doc_id, core): the name whose leader is within half the distance; a member has one core at most. A name's leader is the least member
    that has its most frequent sketch. None where no name is large."""
    hot = placed.groupBy("name").count().filter(F.col("count") > PART_ROWS)
    hot = written(hot.select("name", F.ceil(F.col("count") / PART_ROWS).cast("long").alias("parts")), "hot")
    if hot.isEmpty():
        return None
    member = written(placed.join(hot, "name").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))), "members")
    ids = member.select("doc_id").distinct()
    often = might(sketch, ids).filter("_might").select("doc_id", "sketch").join(member, "doc_id").groupBy("name", "sketch").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader"))
    chosen = written(often.groupBy("name").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader")).join(hot, "name"), "leaders")
    own = [c for c in have.columns if c not in ("doc_id", "weight")]
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    # Only what members of large names need is shuffled.
    leads = might(have, chosen.select(F.col("leader").alias("doc_id")).distinct()).filter("_might").withColumnRenamed("doc_id", "leader")
    leader = chosen.join(leads, "leader").select("name", part, *(F.col(c).alias(f"of_{c}") for c in own))
    member = member.join(might(have, ids).filter("_might").select("doc_id", *own), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = alike(batch)
                near = pa.array(score >= tight)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(near), batch.column("name").filter(near), pa.array(score).filter(near)], ["doc_id", "name", "score"])

    met = member.join(leader, ["name", "part"]).select("doc_id", "name", *own, *(f"of_{c}" for c in own))
    close = met.mapInArrow(run, "doc_id long, name long, score double")
    return written(close.groupBy("doc_id").agg(F.max_by("name", F.struct("score", -F.col("name"))).alias("core")), "cores")


def _chunks(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of whole blocks, of several blocks at once as long as they have few pairs."""
    size = np.diff(bounds)
    total = np.cumsum(size * (size - 1) // 2)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        pairs = list(pair_blocks(bounds[at : to + 1] - bounds[at], 1 << 22))
        if pairs:
            i, j = (np.concatenate(x) + bounds[at] for x in zip(*pairs))
            yield i, j
        at = to


def _met(compare: Compare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "grp"):
            ids, own, part, low, high = (longs(group, c) for c in ("doc_id", "name", "part", "low", "high"))
            cored = group.column("core").combine_chunks()
            has, core = cored.is_valid().to_numpy(zero_copy_only=False), cored.fill_null(0).to_numpy(zero_copy_only=False)
            names = group.column("all").to_pylist()
            several = np.array([len(n) > 1 for n in names])
            links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            linked = compare(group)
            for i, j in _chunks(runs(longs(group, "grp"))):
                # Pairs within a part meet in that part's own block only, and those of a core are known.
                known = has[i] & has[j] & (core[i] == core[j])
                new = ~known & ((low[i] == high[i]) | (part[i] != part[j])) & (ids[i] != ids[j])
                i, j = linked(i[new], j[new])
                # Members that share several names are a pair of the least only.
                twice = np.flatnonzero(several[i] & several[j])
                if len(twice):
                    keep = np.ones(len(i), bool)
                    keep[twice] = [own[x] == min(set(names[x]).intersection(names[y])) for x, y in zip(i[twice].tolist(), j[twice].tolist())]
                    i, j = i[keep], j[keep]
                links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                while True:
                    least = np.minimum(root[i], root[j])
                    if (least == root[i]).all() and (least == root[j]).all():
                        break
                    np.minimum.at(root, i, least)
                    np.minimum.at(root, j, least)
                    root = root[root]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], ["doc_id", "root", "links"])

    return run


def blocks(placed: DataFrame, have: DataFrame, cores: DataFrame | None) -> DataFrame:
    """Members with what is compared, a row for each block that they go to, in the blocks' order."""
    rows = placed.join(have.select("doc_id", "weight"), "doc_id")
    rows = rows.join(cores, "doc_id", "left") if cores is not None else rows.withColumn("core", F.lit(None).cast("long"))
    rows = rows.withColumn("inner", F.coalesce(F.col("core") == F.col("name"), F.lit(False)))

    def parts(of):
        n, weight = F.sum(F.when(of, 1).otherwise(0)), F.sum(F.when(of, F.col("weight")).otherwise(0))
        return F.greatest(F.ceil(n / PART_ROWS), F.ceil(weight / PART_WEIGHT)).cast("long")

    cut = rows.groupBy("name").agg(parts(~F.col("inner")).alias("outside"), parts(F.col("inner")).alias("inside")).filter("outside > 0")
    near = rows.join(cut, "name").groupBy("doc_id").agg(F.first("core").alias("core"), F.collect_list(F.struct("name", "outside", "inside", "inner")).alias("names"))
    own = [c for c in have.columns if c not in ("doc_id", "weight")]
    out = have.select("doc_id", *own).join(near, "doc_id").select("doc_id", *own, "core", F.col("names.name").alias("all"), F.explode("names").alias("n"))
    draw = F.xxhash64(F.lit(73), "doc_id")
    part = F.when(F.col("n.inner"), F.col("n.outside") + F.pmod(draw, F.greatest(F.col("n.inside"), F.lit(1)))).otherwise(F.pmod(draw, F.col("n.outside")))
    others = F.when(F.col("n.inner"), F.col("n.outside")).otherwise(F.col("n.outside") + F.col("n.inside"))
    out = out.select("doc_id", *own, "core", "all", F.col("n.name").alias("name"), part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other"))
    out = out.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    out = out.select(F.xxhash64("name", "low", "high").alias("grp"), "doc_id", "name", "part", "low", "high", "core", "all", *own)
    return out.repartition(partitions(out), "grp").sortWithinPartitions("grp", "doc_id")


def links(nodes: DataFrame, payload: Callable[[DataFrame], DataFrame], compare: Compare, sketch: DataFrame | None = None, alike: Callable[[pa.RecordBatch], np.ndarray] | None = None, tight: float = 0.0) -> DataFrame:
    """(doc_id, root, links) of linked members, partial sums. ``payload`` gives (doc_id, weight, ...), what is to be compared, for a table of ids (more than these does no
    harm); ``sketch`` a value (doc_id, sketch) that near copies mostly share; ``alike`` the similarity of a row's own columns to its leader's (``of_...``);
    ``tight`` the similarity at half the distance allowed. Without the last three there are no cores."""
    placed = places(nodes)
    have = written(payload(placed.select("doc_id").distinct()), "compared")
    cores = _cores(placed, have, sketch, alike, tight) if alike else None
    found = blocks(placed, have, cores).mapInArrow(_met(compare), LINKS)
    if cores is not None:
        size = cores.groupBy("core").agg(F.min("doc_id").alias("root"), (F.count("*") - 1).alias("links"))
        found = found.union(cores.join(size, "core").filter("links > 0").select("doc_id", "root", "links"))
    return written(found, "links")


def classes(members: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) of members (doc_id, k1, k2), from ``links`` between their representatives: the least
    id of what a member is connected with, how many others have its content, and how many other contents are linked with it."""
    group = written(members.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), (F.count("*") - 1).alias("n_copies")), "contents")
    label = components.labels(found.select("doc_id", "root")).withColumnRenamed("doc_id", "least")
    total = found.groupBy(F.col("doc_id").alias("least")).agg(F.sum("links").alias("n_links"))
    known = group.join(label.join(total, "least"), "least", "left")
    known = known.select("k1", "k2", F.coalesce("label", "least").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return members.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).select("doc_id", "class_id", "n_copies", "n_links")
