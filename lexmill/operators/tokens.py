"""Token windows as array expressions: no UDF, no shuffle, one pass over each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Maximal runs of non-space characters."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def chunk_bounds(n_tokens: Column, length: int, stride: int) -> Column:
    """Start offsets of overlapping windows; inputs shorter than ``length`` count as padded to it,
    so there are ceil(max(n, length) / (length - stride)) of them."""
    if not 0 <= stride < length:
        raise ValueError("the overlap must be at least 0 and less than the window")
    return F.sequence(F.lit(0), F.greatest(n_tokens, F.lit(length)) - 1, F.lit(length - stride))


def count_words(text: Column) -> Column:
    """How many there are, without an array of them; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def chunks(df: DataFrame, n: str, length: int, stride: int) -> DataFrame:
    """From token counts, one row per window: chunk_no, start_tok, end_tok, n_real, n_pad."""
    total = F.greatest(F.col(n), F.lit(length))
    out = df.select("*", F.posexplode(chunk_bounds(F.col(n), length, stride)).alias("chunk_no", "start_tok"))
    end = F.least(F.col("start_tok") + length, total)
    real = F.greatest(F.least(end, F.col(n)) - F.col("start_tok"), F.lit(0))
    return out.withColumns({"end_tok": end, "n_real": real, "n_pad": F.lit(length) - real})


def padded(ids: Column, length: int, pad: Column) -> Column:
    """Cut or filled with ``pad`` to the length."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(pad, F.lit(length) - F.size(cut)))


def token_ids(text: Column, vocabulary: int = 50_000) -> Column:
    """Stand-in ids of white-space tokens, the same in every engine: a hash of each token. ``lexmill.functions.tokenizers`` has subword ids."""
    return F.transform(words(text), lambda w: (F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(vocabulary)) + 1).cast("int"))


def chunk_arrays(df: DataFrame, ids: str, length: int, stride: int, pad: int) -> DataFrame:
    """One row per window: chunk_no, input_ids, attention_mask and labels (which include padding)."""
    out = df.select("*", F.posexplode(chunk_bounds(F.size(ids), length, stride)).alias("chunk_no", "start_tok"))
    own = F.slice(ids, F.col("start_tok") + 1, length)
    out = out.withColumn("input_ids", padded(own, length, F.lit(pad)))
    mask = F.when(own.isNotNull(), padded(F.array_repeat(F.lit(1), F.size(own)), length, F.lit(0)))
    return out.withColumns({"attention_mask": mask, "labels": F.col("input_ids")})


def sft(prompt: Column, output: Column, length: int, pad: int, bos: int | None = None) -> dict[str, Column]:
    """input_ids, attention_mask and labels of a prompt and its answer; labels are -100 but for the answer's."""
    head = prompt if bos is None else F.concat(F.array(F.lit(bos)), prompt)
    ids, ones = F.concat(head, output), F.array_repeat(F.lit(1), F.size(head) + F.size(output))
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(head)), output)
    return {"input_ids": padded(ids, length, F.lit(pad)), "attention_mask": padded(ones, length, F.lit(0)), "labels": padded(labels, length, F.lit(-100))}


def masked(labels: Column) -> Column:
    """Whether no label is left to learn from."""
    return F.forall(labels, lambda x: x == -100)


def first_response(labels: Column) -> Column:
    """Position from 0 of the first label that isn't masked, null if all are."""
    at = F.array_position(F.transform(labels, lambda x: x != -100), F.lit(True))
    return F.when(at > 0, at - 1)


def max_steps(rows: DataFrame, tokens: str, length: int, gpus: int, batch: int, accumulate: int) -> DataFrame:
    """tokens, chunks of ``length``, examples per step and steps, in one aggregation; no examples per step gives no steps."""
    per_step = gpus * batch * accumulate
    total = F.coalesce(F.sum(tokens), F.lit(0)).cast("long")
    chunks = F.ceil(total / length).cast("long")
    steps = F.ceil(chunks / per_step).cast("long") if per_step > 0 else F.lit(0).cast("long")
    return rows.agg(total.alias("tokens"), chunks.alias("chunks"), F.lit(per_step).cast("long").alias("per_step"), steps.alias("steps"))
