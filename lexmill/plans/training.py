"""Token chunks, instruction pairs and what a trainer reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import instruct as I
from lexmill.operators import ordering as O
from lexmill.operators import tokens as T
from lexmill.session import spread, table

LENGTH, STRIDE, PAD, BOS, VOCABULARY = 64, 8, 0, 1, 5000
GPUS, BATCH, ACCUMULATE = 4, 8, 2
#: Valid in Spark and in DuckDB: whole and broken JSON, objects with and without a text, other values.
LINE = """CASE event_id % 13 WHEN 0 THEN left(props, 3) WHEN 1 THEN '{"k": ""}' WHEN 2 THEN '{"k": " "}' WHEN 3 THEN '{"k": "text"}' WHEN 4 THEN '[1]' WHEN 5 THEN '"k"'
  WHEN 6 THEN '{"k": null}' WHEN 7 THEN '{"j": "x"}' WHEN 8 THEN '{"k": [1]}' WHEN 9 THEN '{"k": []}' WHEN 10 THEN '{"k": false}' WHEN 11 THEN '{"k": 0}' ELSE props END"""


def _joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), " ")


def _chunked(docs: DataFrame) -> DataFrame:
    rows = T.chunk_arrays(docs.select("doc_id", T.token_ids(F.col("text"), VOCABULARY).alias("ids")), "ids", LENGTH, STRIDE, PAD)
    return rows.select("doc_id", "chunk_no", *(_joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")))


def chunk_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of every source."""
    return _chunked(spread(table(spark, sf_dir, "documents")))


def token_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every kind by status."""
    lines = table(spark, sf_dir, "events").select(F.expr(LINE).alias("line"))
    return I.status_counts(lines, "line", "k")


def max_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.count_words(F.col("text"))
    return T.max_steps(spread(table(spark, sf_dir, "documents")).select(n.alias("n")), "n", LENGTH, GPUS, BATCH, ACCUMULATE)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pairs(table(spark, sf_dir, "conversations"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", "instruction", "input", "output")


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = I.prompt(F.col("instruction"), F.col("input"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", prompt.alias("prompt"), F.concat(prompt, F.lit("\n"), F.col("output")).alias("text"))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: T.token_ids(c, VOCABULARY)
    prompt = I.prompt(F.col("instruction"), F.col("input"))
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", ids(prompt).alias("p"), ids(F.col("output")).alias("o"))
    return rows.select("conv_id", "turn", *(c.alias(k) for k, c in T.sft(F.col("p"), F.col("o"), LENGTH, PAD, BOS).items()))


def sft_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir).select("conv_id", "turn", *(_joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")))


def masked_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir).select("conv_id", "turn", T.masked(F.col("labels")).alias("masked"), T.first_response(F.col("labels")).alias("first_response"))


def max_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: T.count_words(F.col(c))
    return _pairs(spark, sf_dir).agg(F.max(n("instruction")).alias("prompt"), F.max(n("output")).alias("output"), F.max(n("instruction") + n("output")).alias("total"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per nation region: its nations as rows."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.col("n_name")))).alias("body"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.col("body"))
    return nations.select(F.col("n_regionkey").alias("region"), I.markdown(cells).alias("markdown"))


def paragraph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs (here a conversation's turns) stripped and joined with a space, in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", I.paragraphs(F.transform("t", lambda t: t["text"])).alias("text"))


def answer_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers as text; SQL agrees on numbers only, so the value of each key is what is compared."""
    return table(spark, sf_dir, "events").select("event_id", X.json_rendered(F.get_json_object("props", "$.k")).alias("answer"))


def merge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All instruction pairs and as many documents as there are benchmark items, in one seeded order."""
    first = _pairs(spark, sf_dir).select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "instruction", "output")
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.lit("Continue").alias("instruction"), F.col("text").alias("output"))
    second = O.sample(texts, "m", "id", table(spark, sf_dir, "benchmark").count())
    return O.ranked(first.unionByName(second), "m", "id").select("id", "rank", F.md5("output").alias("digest"))


QUERIES = {f.__name__: f for f in (chunk_arrays, token_status, max_steps, qa_pairs, prompt_text, sft_encode, masked_check, max_lengths, table_markdown, paragraph_join, answer_render, merge_sets)}

_ids = lambda c: f"list_transform(regexp_extract_all({c}, '\\S+'), lambda w: CAST(CAST('0x' || left(md5(w), 8) AS BIGINT) % {VOCABULARY} + 1 AS INTEGER))"
_join = lambda c: f"array_to_string({c}, ' ')"
_pad = lambda c, v: f"list_concat({c}[1:{LENGTH}], list_transform(range(greatest({LENGTH} - len({c}), 0)), lambda i: {v}))"
_P = """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS output, coalesce(max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id), '') AS input
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  q AS (SELECT conv_id, turn, text AS instruction, input, output FROM t WHERE role = 'user' AND next_role = 'assistant'),
  m AS (SELECT *, '### Instruction:' || chr(10) || instruction || CASE WHEN length(input) > 0 THEN chr(10) || chr(10) || '### Input:' || chr(10) || input ELSE '' END || chr(10) || chr(10) || '### Response:' AS prompt FROM q)"""
_E = f"""{_P}, i AS (SELECT conv_id, turn, list_concat([{BOS}], {_ids("prompt")}) AS h, {_ids("output")} AS o FROM m),
  j AS (SELECT conv_id, turn, list_concat(h, o) AS x, list_transform(list_concat(h, o), lambda v: 1) AS k, list_concat(list_transform(h, lambda v: -100), o) AS y FROM i),
  e AS (SELECT conv_id, turn, {_pad("x", PAD)} AS input_ids, {_pad("k", 0)} AS attention_mask, {_pad("y", -100)} AS labels FROM j)"""
SQL = {
    "chunk_arrays": f"""WITH d AS (SELECT doc_id, {_ids("text")} AS ids FROM documents),
  s AS (SELECT doc_id, ids, unnest(range(0, greatest(len(ids), {LENGTH}), {LENGTH - STRIDE})) AS s FROM d),
  c AS (SELECT doc_id, s, ids[s + 1:s + {LENGTH}] AS own FROM s),
  p AS (SELECT doc_id, s, {_pad("own", PAD)} AS x, {_pad("list_transform(own, lambda v: 1)", 0)} AS m FROM c)
SELECT doc_id, CAST(s / {LENGTH - STRIDE} AS INTEGER) AS chunk_no, {_join("x")} AS input_ids, {_join("m")} AS attention_mask, {_join("x")} AS labels FROM p""",
    "token_status": f"""WITH l AS (SELECT {LINE} AS line FROM events),
  j AS (SELECT line, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM l), k AS (SELECT j, j -> '$.k' AS v, json_type(j -> '$.k') AS t FROM j)
SELECT CASE WHEN j IS NULL THEN 'invalid_json' WHEN json_type(j) <> 'OBJECT' THEN 'other_error' WHEN v IS NULL OR CAST(v AS VARCHAR) IN ('""', '0', '0.0', 'false', 'null', '[]', '{{}}') THEN 'empty_filing'
  WHEN t = 'VARCHAR' THEN 'success' ELSE 'other_error' END AS status, count(*) AS n FROM k GROUP BY 1""",
    "max_steps": f"""WITH t AS (SELECT CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS tokens FROM documents), c AS (SELECT tokens, CAST(ceil(tokens / {LENGTH}.0) AS BIGINT) AS chunks FROM t)
SELECT tokens, chunks, CAST({GPUS * BATCH * ACCUMULATE} AS BIGINT) AS per_step, CAST(ceil(chunks / {GPUS * BATCH * ACCUMULATE}.0) AS BIGINT) AS steps FROM c""",
    "qa_pairs": _P + "SELECT conv_id, turn, instruction, input, output FROM q",
    "prompt_text": _P + "SELECT conv_id, turn, prompt, prompt || chr(10) || output AS text FROM m",
    "sft_encode": _E + f"SELECT conv_id, turn, {_join('input_ids')} AS input_ids, {_join('attention_mask')} AS attention_mask, {_join('labels')} AS labels FROM e",
    "masked_check": _E + "SELECT conv_id, turn, len(list_filter(labels, lambda v: v <> -100)) = 0 AS masked, nullif(list_position(list_transform(labels, lambda v: v <> -100), true), 0)::BIGINT - 1 AS first_response FROM e",
    "max_lengths": _P + "SELECT CAST(max(len(regexp_extract_all(instruction, '\\S+'))) AS INTEGER) AS prompt, CAST(max(len(regexp_extract_all(output, '\\S+'))) AS INTEGER) AS output, CAST(max(len(regexp_extract_all(instruction, '\\S+')) + len(regexp_extract_all(output, '\\S+'))) AS INTEGER) AS total FROM q",
    "table_markdown": "SELECT n_regionkey AS region, 'key | name' || chr(10) || '--- | ---' || chr(10) || string_agg(lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1",
    "paragraph_join": r"SELECT conv_id, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1",
    "answer_render": "SELECT event_id, props::JSON ->> '$.k' AS answer FROM events",
    "merge_sets": _P + """, b AS (SELECT 'd' || doc_id AS id, text AS output FROM documents ORDER BY md5('m:d' || doc_id), id LIMIT (SELECT count(*) FROM benchmark)),
  u AS (SELECT 'c' || conv_id || '-' || turn AS id, output FROM q UNION ALL SELECT id, output FROM b)
SELECT id, row_number() OVER (ORDER BY md5('m:' || id), id) AS rank, md5(output) AS digest FROM u""",
}
