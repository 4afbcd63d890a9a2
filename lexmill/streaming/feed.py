"""Streams of chunk files: incremental discovery, resumable position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from lexmill.operators.selection import after
from lexmill.sources.files import CHUNKS

COLUMNS = ("input_ids", "attention_mask", "labels")


def chunks(spark: SparkSession, path: str, schema: str = CHUNKS, files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files as they come; the checkpoint of the query that reads remembers which have been."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path).select(*COLUMNS)


def consume(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is new to Parquet and ends; a second run with the same checkpoint goes on where this one ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n = (state.get[0] if state.exists else 0) + sum(int(b["n"].sum()) for b in batches)
    state.update((n,))
    yield pd.DataFrame({"stream": [key[0]], "processed_examples": [n]})


def positions(stream: DataFrame, name: str = "train") -> DataFrame:
    """(stream, processed_examples), a row for each micro-batch: the count goes on over batches and restarts. Every task counts its own
    examples; one number for each Arrow batch goes on to the state."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([batch.num_rows], pa.int64())], ["stream", "n"])

    named = stream.select(F.lit(1).alias("one")).mapInArrow(counted, "stream string, n long")
    return named.groupBy("stream").applyInPandasWithState(_count, "stream string, processed_examples long", "processed_examples long", "update", "NoTimeout")


def skip(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Row-granular resume on a table with a unique order."""
    return after(rows, order, n)
