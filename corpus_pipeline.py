"""A corpus pipeline over ``documents``: quality, near copies, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. ``run`` applies them, writing each stage's result to the shared folder and reading it again.

Defined cases, by stage: null and empty texts are rejected by the first, as texts without words; rows without an id pass the first three as they are
and go with the mixture, which deals documents out by id; of rows that repeat an id the first judges each, and one, of the least text, is left by the second;
texts are read whole, at any length; columns beyond those of ``documents`` are kept up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import jaccard_forest, mixing, packing, quality, secrets
from lexmill.llm.common import by_ids, written
from lexmill.session import spread


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that the join connects, the one with the least id stays."""
    return jaccard_forest.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the blocks that the apportionment drew stay."""
    return by_ids(docs, written(mixing.mix(docs).select("doc_id"), "drawn"), keep=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixture),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for place, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{place}")
    return docs
