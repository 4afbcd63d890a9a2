"""Readers, sinks, counters and record operators, each written to the shared folder and read back where it is a sink."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import tokenizers
from lexmill.operators import filings as L
from lexmill.operators import instruct as I
from lexmill.operators import ordering, report, selection
from lexmill.operators import tokens as T
from lexmill.plans import filings as P
from lexmill.session import spread, table
from lexmill.sources import files

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Window and overlap of the two pre-training set-ups, and the id that pads, which is the end of text.
SETUPS = {"short": (2048, 128), "long": (8192, 512)}
END_OF_TEXT = 50256
KEYS = ("base.layers.0.q_proj.lora_A.weight", "base.layers.0.q_proj.lora_B.weight", "base.embed_tokens.weight", "lm_head.weight", "base.layers.0.q_proj.weight", "base.lm_head.lora_A.weight")


def tokenizer_path(spark: SparkSession) -> str:
    return spark.conf.get("spark.lexmill.tokenizer", TOKENIZER)


def _folder(spark: SparkSession, name: str) -> str:
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not have:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="lexmill-")
        sc.setCheckpointDir(have)
    return f"{have}/lexmill-{name}-{uuid.uuid4().hex}"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def daily_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines in a folder a day, read back."""
    path = _folder(spark, "daily")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("day"))
    files.write_daily(events, path, "day")
    return files.jsonl(spark, path, "event_id long, event_type string, day string").groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def corpus_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as JSON lines in ASCII, in batches bounded by characters; rows as written and as read back."""
    path = _folder(spark, "batches")
    written = files.write_batches(spread(_docs(spark, sf_dir)).select(F.coalesce("text", F.lit("")).alias("filing")), path, "filing", 200_000)
    back = files.jsonl(spark, path)
    return back.agg(F.lit(written).cast("long").alias("written"), F.count("*").alias("n"), F.sum(F.length("filing")).cast("long").alias("chars"), F.sum(F.conv(F.substring(F.md5("filing"), 1, 8), 16, 10).cast("long")).alias("digests"))


def split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and eval written as two folders and read back; the write fails if the counts don't add up."""
    path = _folder(spark, "split")
    files.write_split(ordering.split(_docs(spark, sf_dir).select("doc_id"), "s", "doc_id", 100), path)
    return spark.read.parquet(path).select("doc_id", F.col("split").cast("string").alias("split"))


def whitelist_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of form types, written, read by position and by its flag, then the documents of the types marked."""
    path = _folder(spark, "whitelist")
    kinds = _docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("a"), F.sum("n_chars").alias("b"), F.count("*").alias("c"), (F.sum("n_chars") % 2).cast("int").alias("d"))
    files.write_csv(kinds, path)
    return selection.whitelisted(_docs(spark, sf_dir).select("doc_id", "source"), "source", files.whitelist(spark, path))


def form_type_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by form type, less the columns that aren't wanted: a folder each, read back."""
    path = _folder(spark, "types")
    files.write_parts(_docs(spark, sf_dir).drop("text", "lang"), path, "source")
    return spark.read.parquet(path).select("doc_id", F.col("source").cast("string").alias("source"), "n_chars")


def log_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested processing log of each day (here source), made flat."""
    log = L.processing_log(L.cleaned(P.filings(spark, sf_dir), build=False), "source")
    html = F.struct(F.col("html_characters_removed").alias("characters_removed"), F.col("html_blocks_parsed").alias("blocks_parsed"))
    kills = F.struct(F.col("kill_characters_removed").alias("characters_removed"), F.col("files_killed").alias("files_killed"))
    return selection.flat(log.select("source", "files_processed", "documents_processed", html.alias("HTML"), F.struct(kills.alias("Kills")).alias("all")))


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with an error: which document, what kind."""
    return L.error_log(L.cleaned(P.filings(spark, sf_dir), build=False)).select("filing_id", "removed", F.explode("log").alias("e")).select("filing_id", "removed", "e.pos", "e.type", "e.error_type")


def head_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.head_of_each(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 3)


def worker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three workers' parts, one of them missing, in one."""
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    return selection.merged({2: docs.filter("doc_id % 3 = 0"), 0: docs.filter("doc_id % 3 = 1"), 1: None}, "doc_id")


def adapter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of weights, a literal relation, by kind."""
    return spark.createDataFrame([(k,) for k in KEYS], "name string").select("name", I.key_kind(F.col("name")).alias("kind"))


def zipped_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel lists of ids and masks as rows."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.token_ids(F.col("text"), 5000).alias("id"))
    rows = rows.withColumn("mask", F.transform("id", lambda x: (x % 7 != 0).cast("int")))
    return rows.select("item_id", F.posexplode(F.arrays_zip("id", "mask")).alias("pos", "z")).select("item_id", "pos", "z.id", "z.mask")


def line_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations that aren't blank."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.filter(F.length(F.trim("value")) > 0).select("conv_id", "turn", "line", F.md5("value").alias("digest"))


def required_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that all have their keys; the query fails where one hasn't."""
    return I.required(table(spark, sf_dir, "events").select("event_id", "props"), "props", ["k"])


def _three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("doc_id") % 10 != 0, (F.col("n_chars") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)) % 3)
    return _docs(spark, sf_dir).select("lang", (F.col("n_chars") % 3).alias("gold"), guess.alias("guess"))


def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.multiclass_metrics(_three_classes(spark, sf_dir), "gold", "guess")


def avg_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.avg_f1(_three_classes(spark, sf_dir), "lang", "gold", "guess")


def subword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword tokens of every document, with one special token in front; blank documents go."""
    docs = spread(_docs(spark, sf_dir)).filter(F.length(P.T.strip(F.col("text"))) > 0)
    return docs.select("doc_id", F.size(tokenizers.subword_ids(tokenizer_path(spark), END_OF_TEXT)(F.col("text"))).alias("n_tokens"))


def _subword_chunks(spark: SparkSession, sf_dir: str, setup: str) -> DataFrame:
    length, stride = SETUPS[setup]
    docs = spread(_docs(spark, sf_dir)).filter(F.length(P.T.strip(F.col("text"))) > 0)
    ids = docs.select("doc_id", tokenizers.subword_ids(tokenizer_path(spark))(F.col("text")).alias("ids"))
    return T.chunk_arrays(ids, "ids", length, stride, END_OF_TEXT).select("doc_id", "chunk_no", "input_ids", "attention_mask", "labels")


def subword_chunks_2048(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subword_chunks(spark, sf_dir, "short")


def subword_chunks_8192(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subword_chunks(spark, sf_dir, "long")


def subword_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids back to their pieces."""
    path = tokenizer_path(spark)
    ids = table(spark, sf_dir, "benchmark").select("item_id", tokenizers.subword_ids(path)(F.col("text")).alias("ids"))
    return ids.select("item_id", "ids", tokenizers.pieces(path)(F.col("ids")).alias("pieces"))


QUERIES = {
    f.__name__: f
    for f in (daily_json, corpus_batches, split_sink, whitelist_csv, form_type_parts, log_flat, error_log, head_per_group, worker_merge, adapter_keys, zipped_masks, line_skip, required_records, multiclass_metrics, avg_f1, subword_counts, subword_chunks_2048, subword_chunks_8192, subword_decode)
}
_M = """WITH r AS (SELECT lang, n_chars % 3 AS g, CASE WHEN doc_id % 10 <> 0 THEN (n_chars + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) % 3 END AS p FROM documents)"""
SQL = {
    "daily_json": "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "corpus_batches": "SELECT count(*) AS written, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, CAST(sum(CAST('0x' || left(md5(coalesce(text, '')), 8) AS BIGINT)) AS BIGINT) AS digests FROM documents",
    "split_sink": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('s:' || doc_id), doc_id) <= 100 THEN 'eval' ELSE 'train' END AS split FROM documents",
    "whitelist_csv": "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING sum(n_chars) % 2 = 1)",
    "form_type_parts": "SELECT doc_id, source, n_chars FROM documents",
    "log_flat": P._D + """SELECT source, count_if(NOT removed)::BIGINT AS files_processed, sum(CASE WHEN paper THEN 0 ELSE docs END)::BIGINT AS documents_processed,
  sum(CASE WHEN paper THEN 0 ELSE html_c END)::BIGINT AS "HTML_characters_removed", sum(CASE WHEN paper THEN 0 ELSE html_n END)::BIGINT AS "HTML_blocks_parsed",
  sum(CASE WHEN removed THEN length(content) ELSE 0 END)::BIGINT AS "all_Kills_characters_removed", count_if(removed)::BIGINT AS "all_Kills_files_killed" FROM c GROUP BY source""",
    "error_log": P._D + r""", n AS (SELECT filing_id, CAST(pos AS INTEGER) AS pos, trim(nullif(regexp_extract(d, '<TYPE>(.*)', 1), '')) AS type, action FROM a)
SELECT n.filing_id, removed, pos, type, 'pdf_extraction' AS error_type FROM n JOIN c USING (filing_id) WHERE action = 'extract' AND NOT paper
UNION ALL SELECT n.filing_id, removed, pos, type, 'no_type' FROM n JOIN c USING (filing_id) WHERE type IS NULL AND NOT paper""",
    "head_per_group": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3",
    "worker_merge": "SELECT doc_id, source, CAST(CASE doc_id % 3 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS worker FROM documents WHERE doc_id % 3 <> 2",
    "adapter_keys": "SELECT name, CASE WHEN contains(name, 'embed_tokens') OR contains(name, 'lm_head') THEN 'dropped' WHEN contains(name, 'lora_A') OR contains(name, 'lora_B') THEN 'adapter' ELSE 'other' END AS kind FROM (VALUES "
    + ", ".join(f"('{k}')" for k in KEYS) + ") t(name)",
    "zipped_masks": "WITH i AS (SELECT item_id, list_transform(regexp_extract_all(text, '\\S+'), lambda w: CAST(CAST('0x' || left(md5(w), 8) AS BIGINT) % 5000 + 1 AS INTEGER)) AS x FROM benchmark) SELECT item_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS id, unnest(list_transform(x, lambda v: CAST(v % 7 <> 0 AS INTEGER))) AS mask FROM i",
    "line_skip": "WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS v FROM conversations), u AS (SELECT conv_id, turn, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS line, unnest(v) AS value FROM l) SELECT conv_id, turn, line, md5(value) AS digest FROM u WHERE length(trim(value)) > 0",
    "required_records": "SELECT event_id, props FROM events",
    "multiclass_metrics": _M + """, c AS (SELECT k, sum(g) AS g, sum(p) AS p, sum(tp) AS tp FROM (SELECT g AS k, 1.0 AS g, 0.0 AS p, CASE WHEN g = p THEN 1.0 ELSE 0 END AS tp FROM r UNION ALL SELECT p, 0, 1.0, 0 FROM r) GROUP BY k),
  f AS (SELECT *, coalesce(2 * tp / nullif(g + p, 0), 0) AS f FROM c),
  t AS (SELECT sum(g) AS n, sum(CASE WHEN k IS NULL THEN p ELSE 0 END) AS missing, sum(tp) AS hits, sum(f * g) AS w, avg(f) FILTER (g > 0) AS macro, sum(g * p) AS gp, sum(g * g) AS gg, sum(p * p) AS pp FROM f)
SELECT CAST(n AS BIGINT) AS n, CAST(missing AS BIGINT) AS missing, round(hits / n, 6) AS acc, round(sqrt(hits / n * (1 - hits / n) / (n - 1)), 6) AS acc_stderr, round(w / n, 6) AS f1, round(macro, 6) AS macro_f1,
  round((hits * n - gp) / sqrt(CAST(n * n - pp AS DOUBLE) * CAST(n * n - gg AS DOUBLE)), 6) AS mcc FROM t""",
    "avg_f1": _M + ", e AS (SELECT lang, count_if(g = 1 AND p = 1) AS tp, count_if(g = 1) AS g, count_if(p = 1) AS p FROM r GROUP BY 1) SELECT round(avg(coalesce(2.0 * tp / nullif(g + p, 0), 0)), 6) AS avg_f1 FROM e",
}
