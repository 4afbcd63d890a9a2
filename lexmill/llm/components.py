"""Connected groups of a similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import written


def labels(edges: DataFrame) -> DataFrame:
    """(doc_id, label) of all ids of the edges (doc_id, root): the least id of an id's group, by alternating the least neighbour's label
    with the label's own label, so that chains shorten by half; each round is written to the shared folder. Edges
    from an id to itself do no harm; without edges there are no rows."""
    ends = edges.toDF("x", "y").filter("x <> y").distinct()
    ends = written(ends.union(ends.select("y", "x")).distinct(), "edges")
    now = written(ends.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("label")), "labels")
    while True:
        near = ends.join(now.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = now.join(near, "x").select("x", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = step.select(F.col("x").alias("next"), F.col("next").alias("beyond"))
        new = written(step.join(jump, "next").select("x", F.least("next", "beyond").alias("label"), "was"), "labels")
        if new.filter("label <> was").isEmpty():
            return new.select(F.col("x").alias("doc_id"), "label")
        now = new.select("x", "label")
