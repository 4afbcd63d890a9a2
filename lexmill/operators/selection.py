"""Selecting rows: whitelists, incremental listings, names and years, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.text import first_group

#: Whitelists of up to so many form types are broadcast; larger ones meet the rows by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more rows than that; the count reads one row more at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def whitelisted(rows: DataFrame, column: str, whitelist: DataFrame) -> DataFrame:
    """Rows whose form type is on the list; null never is. Both sides use dashes for slashes, as in file names."""
    name = whitelist.columns[0]
    listed = small(whitelist.select(F.replace(F.col(name), F.lit("/"), F.lit("-")).alias("_listed")).distinct())
    return rows.join(listed, F.replace(F.col(column), F.lit("/"), F.lit("-")) == F.col("_listed"), "left_semi")


def pending(remote: DataFrame, key: str, local: DataFrame, name: str) -> DataFrame:
    """Remote rows whose key's first eight characters begin no local name of eight digits."""
    have = local.filter(F.regexp_like(name, F.lit(r"^\d{8}"))).select(F.substring(name, 1, 8).alias("_have")).distinct()
    return remote.join(have, F.substring(key, 1, 8) == F.col("_have"), "left_anti")


def after(rows: DataFrame, order: str, n: int) -> DataFrame:
    """All but the first n rows in the order of a unique column. The n-th key is found by a top-n, so the rest isn't sorted."""
    if n < 1:
        return rows
    first = rows.select(F.col(order).alias("_at")).orderBy("_at").limit(n)
    edge = first.agg(F.max("_at").alias("_at"))
    return rows.crossJoin(F.broadcast(edge)).filter(F.col(order) > F.col("_at")).drop("_at")


def resumed(rows: DataFrame, order: str, last_done: Column) -> DataFrame:
    """The rows after the first that fits, in the order of a column; none if nothing fits. One value is broadcast."""
    edge = rows.filter(last_done).agg(F.min(order).alias("_at"))
    return rows.crossJoin(F.broadcast(edge)).filter(F.col(order) > F.col("_at")).drop("_at")


def form_type_of(name: Column) -> Column:
    return first_group(name, r"^\d{8}_(.*?)_\d+_\d+\.txt$")


def year_of(name: Column) -> Column:
    """The year in a file name by the first of three patterns that fits, else null."""
    patterns = (r"^(\d{4})", r"filing_info_(\d{4})\d{4}\.jsonl$", r"logs_(\d{4})\d{4}\.pkl$")
    return F.coalesce(*(first_group(name, p) for p in patterns)).cast("int")


def union_years(sets: dict[int, DataFrame | None]) -> DataFrame:
    """The yearly sets that exist, one after the other; at least one must."""
    there = [df for _, df in sorted(sets.items()) if df is not None]
    out = there[0]
    for df in there[1:]:
        out = out.unionByName(df)
    return out


def head_of_each(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; every task drops what can't be among them before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def merged(parts: dict[int, DataFrame | None], order: str) -> DataFrame:
    """The workers' parts that exist, with ``worker``, in the order of worker and position."""
    there = [df.withColumn("worker", F.lit(w)) for w, df in sorted(parts.items()) if df is not None]
    out = there[0]
    for df in there[1:]:
        out = out.unionByName(df)
    return out.orderBy("worker", order)


def flat(rows: DataFrame) -> DataFrame:
    """Structs as columns ``outer_inner``, at any depth."""
    while any(isinstance(f.dataType, StructType) for f in rows.schema):
        inner = lambda f: [F.col(f.name)[g.name].alias(f"{f.name}_{g.name}") for g in f.dataType] if isinstance(f.dataType, StructType) else [F.col(f.name)]
        rows = rows.select(*(c for f in rows.schema for c in inner(f)))
    return rows


def token_estimate(rows: DataFrame, chars: str) -> DataFrame:
    """Characters, and tokens in units of 1e12 at four and at three characters each."""
    total = F.coalesce(F.sum(chars), F.lit(0))
    return rows.agg(total.alias("chars"), F.round(total / 4.0 / 1e12, 12).alias("lower_bound"), F.round(total / 3.0 / 1e12, 12).alias("upper_bound"))
