"""Every query of the engine's own operators, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import corpus, filings, ordering, records, reporting, selection, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for module in (corpus, selection, filings, ordering, training, reporting, records):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
