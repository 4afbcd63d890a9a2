"""Question and answer records to instruction rows, prompts and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import json_rendered, strip

RECORD = "table struct<table: array<array<string>>>, paragraphs array<struct<text: string>>, questions array<struct<question: string, answer: string>>"


def pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn that an assistant turn follows: conv_id, turn, instruction, input (the system turn's text, or empty) and output."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    system = F.coalesce(F.max(F.when(F.col("role") == "system", F.col("text"))).over(Window.partitionBy("conv_id")), F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", F.col("text").alias("instruction"), system.alias("input"), F.lead("role").over(order).alias("_next"), F.lead("text").over(order).alias("output"))
    return rows.filter("role = 'user' AND _next = 'assistant'").drop("role", "_next")


def markdown(cells: Column) -> Column:
    """A header row, dashes, and body rows; cells joined with bars, rows with line feeds."""
    row = lambda r: F.array_join(r, " | ", "")
    dashes = F.array_repeat(F.lit("---"), F.size(F.get(cells, F.lit(0))))
    lines = F.concat(F.array(row(F.get(cells, F.lit(0))), F.array_join(dashes, " | ")), F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), row))
    return F.when(F.size(cells) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def paragraphs(texts: Column) -> Column:
    return F.array_join(F.transform(texts, strip), " ")


def flattened(records: DataFrame) -> DataFrame:
    """From records of ``RECORD``'s shape (answers as JSON text): instruction, input (table and paragraphs) and output, one row per question."""
    context = F.concat(markdown(F.coalesce("table.table", F.array().cast("array<array<string>>"))), F.lit("\n\n"), paragraphs(F.transform("paragraphs", lambda p: p["text"])))
    rows = records.select(context.alias("input"), F.explode("questions").alias("q"))
    return rows.select(F.col("q.question").alias("instruction"), "input", json_rendered("q.answer").alias("output"))


def prompt(instruction: Column, context: Column) -> Column:
    """The template; an input that is null or empty has no section."""
    middle = F.when(F.length(context) > 0, F.concat(F.lit("\n\n### Input:\n"), context)).otherwise(F.lit(""))
    return F.concat(F.lit("### Instruction:\n"), instruction, middle, F.lit("\n\n### Response:"))


FALSY = ('""', "0", "0.0", "false", "null", "[]", "{}")


def line_status(line: Column, field: str, tokenizer: bool = True) -> Column:
    """What becomes of a line: ``invalid_json`` if it doesn't parse; ``other_error`` if it is no object, or its field holds something other than
    text that isn't empty; ``empty_filing`` if the field is missing or empty (of any type); else ``success``, for white space too. Without a
    tokenizer every line is a ``tokenizer_error``. A null line doesn't parse."""
    if not tokenizer:
        return F.lit("tokenizer_error")
    parsed = F.try_parse_json(line)
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    empty = value.isNull() | F.to_json(value).isin(*FALSY)
    known = F.when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit("other_error")).when(empty, F.lit("empty_filing"))
    known = known.when(F.schema_of_variant(value) == "STRING", F.lit("success")).otherwise(F.lit("other_error"))
    return F.when(parsed.isNull(), F.lit("invalid_json")).otherwise(known)


def status_counts(lines: DataFrame, line: str, field: str, tokenizer: bool = True) -> DataFrame:
    """Lines by status (see ``line_status``)."""
    return lines.groupBy(line_status(F.col(line), field, tokenizer).alias("status")).agg(F.count("*").alias("n"))


def required(records: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """The records; the job fails, naming the record, where one lacks a key."""
    lacks = F.size(F.array_except(F.array(*(F.lit(k) for k in keys)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))) > 0
    checked = F.when(lacks, F.raise_error(F.concat(F.lit("keys missing: "), F.col(json)))).otherwise(F.col(json))
    return records.withColumn(json, checked)


def key_kind(name: Column, adapters: tuple[str, ...] = ("lora_A", "lora_B"), dropped: tuple[str, ...] = ("embed_tokens", "lm_head")) -> Column:
    """What a weight is by parts of its name: dropped, adapter or other."""
    holds = lambda parts: F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(name, p))
    return F.when(holds(dropped), F.lit("dropped")).when(holds(adapters), F.lit("adapter")).otherwise(F.lit("other"))
