"""Readers with declared schemas, and sinks that commit once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import decode_lossy
from lexmill.operators.instruct import RECORD
from lexmill.sources import tar

CORPUS = "filing string"
CHUNKS = "input_ids array<int>, attention_mask array<int>, labels array<int>"
EXAMPLES = "instruction string, input string, output string"
WHITELIST = "form_type string, file_length bigint, raw_file_length bigint, total_filings bigint, whitelisted int"


def jsonl(spark: SparkSession, path: str, schema: str = CORPUS, broken: bool = False) -> DataFrame:
    """JSON lines. Lines that don't parse give nulls, and with ``broken`` are kept in ``_corrupt_record``."""
    if broken:
        return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return spark.read.schema(schema).json(path)


def qa_records(spark: SparkSession, path: str) -> DataFrame:
    """A document that is one JSON array of records; answers of any kind come as JSON text."""
    return spark.read.schema(RECORD).option("primitivesAsString", True).json(path, multiLine=True)


def csv_renamed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header whose names are replaced by position."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """The form types marked in a CSV of form types."""
    return csv_renamed(spark, path, WHITELIST).filter("whitelisted = 1").select("form_type")


def filings(spark: SparkSession, path: str, form_types: list[str] | None = None) -> DataFrame:
    """Filings of a folder of archives: archive, member, size and decoded content; invalid bytes are left out, broken archives skipped."""
    tar.register(spark)
    reader = spark.read.format("tarmembers").option("path", path)
    if form_types is not None:
        reader = reader.option("form_types", ",".join(form_types))
    return reader.load().filter("error IS NULL").select("archive", "member", "size", decode_lossy("content").alias("content"))


def archive_errors(spark: SparkSession, path: str) -> DataFrame:
    """Archives that couldn't be read to their end, and why."""
    tar.register(spark)
    return spark.read.format("tarmembers").option("path", path).load().filter("error IS NOT NULL").select("archive", "error")


def inventory(spark: SparkSession, path: str, glob: str = "*", max_depth: int | None = None) -> DataFrame:
    """Files under a folder by their directory: number, bytes, depth below the folder, and whether directories with files lie below it; the largest
    first. Directories deeper than ``max_depth`` don't count. Content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(F.regexp_replace("path", r"/[^/]*$", "").alias("directory"), "length")
    root = "/" + path.partition(":")[2].strip("/") if ":" in path else "/" + path.strip("/")
    below = F.replace(F.regexp_replace("directory", r"^[a-z0-9]+:/*", "/"), F.lit(root), F.lit(""))
    each = files.groupBy("directory").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).withColumn("depth", F.regexp_count(below, F.lit("/")))
    if max_depth is not None:
        each = each.filter(F.col("depth") <= max_depth)
    # A directory has others below it if it is among their ancestors.
    parts = F.split("directory", "/")
    ancestors = each.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("directory")).distinct().withColumn("has_subdirs", F.lit(True))
    found = each.join(ancestors, "directory", "left").withColumn("has_subdirs", F.coalesce("has_subdirs", F.lit(False)))
    return found.withColumn("is_leaf", ~F.col("has_subdirs")).orderBy(F.desc("bytes"), F.desc("depth"), "directory")


def ascii_json(text: Column) -> Column:
    """A JSON string with all beyond ASCII escaped, as UTF-16 units in lower case."""
    quoted = F.to_json(F.array(text))
    units = lambda c: F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1"))
    each = F.transform(F.split(F.substring(quoted, F.lit(2), F.length(quoted) - 2), ""), lambda c: F.when(F.octet_length(c) > 1, units(c)).otherwise(c))
    plain = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    # Characters are only taken apart where there is one to escape.
    return F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(F.array_join(each, ""))


def write_batches(df: DataFrame, path: str, column: str, most_chars: int) -> int:
    """JSON lines of one text column, in ASCII, as files that end with the line that brings them to ``most_chars`` characters; gives the number of rows
    written, counted while writing. Each task cuts its own rows, so that nothing is shuffled."""
    spark = df.sparkSession
    lines = df.select(F.concat(F.lit(f'{{"{column}": '), ascii_json(F.col(column)), F.lit("}")).alias("value"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        for batch in batches:
            of = []
            for n in pc.utf8_length(batch.column(0)).to_pylist():
                of.append(number)
                size += n + 1
                if size >= most_chars:
                    number, size = number + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int32())], ["value", "batch"])

    seen = Observation()
    cut_lines = lines.mapInArrow(cut, "value string, batch int").observe(seen, F.count("*").alias("n"))
    cut_lines.write.mode("overwrite").partitionBy("batch").text(path)
    return seen.get["n"]


def write_daily(df: DataFrame, path: str, day: str) -> None:
    """JSON lines in a folder for each day."""
    df.repartition(day).write.mode("overwrite").partitionBy(day).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, by: str = "split") -> dict[str, int]:
    """Parquet in a folder for each part of a split, from one pass; gives the rows of each part, counted while writing, and raises if what is on
    disk differs."""
    seen = Observation()
    counts = [F.count("*").alias("all"), *(F.count_if(F.col(by) == v).alias(v) for v in ("train", "eval"))]
    write_parts(df.observe(seen, *counts), path, by)
    there = {r[by]: r["count"] for r in df.sparkSession.read.parquet(path).groupBy(by).count().collect()}
    found = {v: seen.get[v] for v in ("train", "eval")}
    if sum(found.values()) != seen.get["all"] or any(there.get(v, 0) != n for v, n in found.items()):
        raise RuntimeError(f"written {seen.get}, found {there}")
    return found


def write_corpus(df: DataFrame, path: str, most_rows: int = 1_000_000, codec: str = "gzip") -> None:
    """JSON lines in committed files of bounded size; a second run replaces the first. The text writer has zstd only with native libraries."""
    df.write.mode("overwrite").option("maxRecordsPerFile", most_rows).option("compression", codec).json(path)


def write_parts(df: DataFrame, path: str, *by: str, codec: str = "zstd") -> None:
    """Parquet in a folder per value of ``by`` (a year, a day, a split), which later scans prune."""
    df.write.mode("overwrite").option("compression", codec).partitionBy(*by).parquet(path)
