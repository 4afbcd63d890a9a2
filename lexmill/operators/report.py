"""Reporting over metric series, logs and predictions; numeric routines as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(rows: DataFrame, series: str, order: str, value: str, before: int = 5, after: int = 4, per_range: int = 100_000) -> DataFrame:
    """Adds the centred mean of a series, null until the frame is full. A long series is cut into ranges of its order (at quantiles of a bounded
    sketch); each range's last and first rows are copied to its neighbours, so a series isn't one task."""
    width = before + after + 1
    many = min(200, max(1, rows.count() // per_range))
    if many == 1:
        frame = Window.partitionBy(series).orderBy(order).rowsBetween(-before, after)
        return rows.withColumn("rolling", F.when(F.count(value).over(frame) == width, F.avg(value).over(frame)))
    cuts = rows.groupBy(series).agg(F.approx_percentile(order, [i / many for i in range(1, many)]).alias("_cuts"))
    cut = rows.join(F.broadcast(cuts), series, "left").withColumn("_range", F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < F.col(order)))).drop("_cuts")
    span = Window.partitionBy(series, "_range")
    cut = cut.withColumns({"_first": F.row_number().over(span.orderBy(order)), "_last": F.row_number().over(span.orderBy(F.desc(order)))})
    # The nearest rows on either side of a range, which may stand in several ranges before or behind it.
    edge = cut.filter((F.col("_first") <= after) | (F.col("_last") <= before)).select(series, order, value, "_range")
    some = cut.select(series, F.col("_range").alias("_to")).distinct()
    near = edge.join(F.broadcast(some), series)
    back = near.filter("_range < _to").withColumn("_n", F.row_number().over(Window.partitionBy(series, "_to").orderBy(F.desc("_range"), F.desc(order)))).filter(F.col("_n") <= before)
    ahead = near.filter("_range > _to").withColumn("_n", F.row_number().over(Window.partitionBy(series, "_to").orderBy("_range", order))).filter(F.col("_n") <= after)
    halo = back.unionByName(ahead).select(series, order, value, F.col("_to").alias("_range"), F.lit(True).alias("_halo"))
    both = cut.drop("_first", "_last").withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    frame = Window.partitionBy(series, "_range").orderBy(order).rowsBetween(-before, after)
    out = both.withColumn("rolling", F.when(F.count(value).over(frame) == width, F.avg(value).over(frame)))
    return out.filter("NOT _halo").select(*rows.columns, "rolling")


def first_diff(rows: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Adds the difference from the row before; a series' first row goes."""
    step = Window.partitionBy(series).orderBy(order)
    return rows.withColumn("diff", F.col(value) - F.lag(value).over(step)).filter("diff IS NOT NULL")


def share(condition: Column) -> Column:
    """Per cent of rows where it holds; nulls don't count."""
    return F.avg(condition.cast("int")) * 100


def fill_down(rows: DataFrame, series: str, order: str, value: str) -> DataFrame:
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def class_metrics(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """For classes 0 and 1 (others are refused): n, missing (no prediction), acc and its standard error, F1 of class 1, macro F1, and the correlation coefficient (0 where it isn't defined), from one pass over
    the confusion counts of a binary task."""
    g, p = (F.when(F.col(c).isin(0, 1) | F.col(c).isNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} has a class other than 0 and 1"))) for c in (gold, predicted))
    cell = lambda a, b: F.count_if((g == a) & (p == b)).cast("double")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("missing"), cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    f1 = lambda t: F.coalesce(F.try_divide(2 * t, 2 * t + fp + fn), F.lit(0.0))
    acc = (tp + tn) / n
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(F.lit(0.0))
    error = F.when(n > 1, F.sqrt(acc * (1 - acc) / (n - 1)))
    return counts.select("n", "missing", F.round(acc, 6).alias("acc"), F.round(error, 6).alias("acc_stderr"), F.round(f1(tp), 6).alias("f1"), F.round((f1(tp) + f1(tn)) / 2, 6).alias("macro_f1"), F.round(mcc, 6).alias("mcc"))


def multiclass_metrics(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """n, missing (no prediction), acc and its standard error, F1 weighted by the classes' frequency, macro F1 over the classes that are there, and the
    correlation coefficient of several classes (0 where it isn't defined). A missing prediction is wrong and no class has it.
    One shuffle, of the confusion counts."""
    cells = rows.filter(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    hit = F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(F.lit(0.0))
    sides = F.array(F.struct(F.col("g").alias("k"), F.col("n").alias("is"), F.lit(0.0).alias("said"), hit.alias("tp")), F.struct(F.col("p").alias("k"), F.lit(0.0).alias("is"), F.col("n").alias("said"), F.lit(0.0).alias("tp")))
    each = cells.select(F.inline(sides)).groupBy("k").agg(*(F.sum(c).alias(c) for c in ("is", "said", "tp")))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("is") + F.col("said")), F.lit(0.0))
    there = F.col("is") > 0
    total = each.agg(
        F.sum("is").alias("n"), F.sum(F.when(F.col("k").isNull(), F.col("said")).otherwise(0.0)).alias("missing"), F.sum("tp").alias("hits"), F.sum(f1 * F.col("is")).alias("weighted"),
        F.avg(F.when(there, f1)).alias("macro"), F.sum(F.col("is") * F.col("said")).alias("both"), F.sum(F.col("is") ** 2).alias("is2"), F.sum(F.col("said") ** 2).alias("said2"),
    )
    n, acc = F.col("n"), F.col("hits") / F.col("n")
    root = F.sqrt((n * n - F.col("said2")) * (n * n - F.col("is2")))
    mcc = F.when(root > 0, (F.col("hits") * n - F.col("both")) / root).otherwise(F.lit(0.0))
    error = F.when(n > 1, F.sqrt(acc * (1 - acc) / (n - 1)))
    return total.select(n.cast("long").alias("n"), F.col("missing").cast("long").alias("missing"), F.round(acc, 6).alias("acc"), F.round(error, 6).alias("acc_stderr"), F.round(F.col("weighted") / n, 6).alias("f1"), F.round("macro", 6).alias("macro_f1"), F.round(mcc, 6).alias("mcc"))


def avg_f1(rows: DataFrame, task: str, gold: str, predicted: str) -> DataFrame:
    """The mean over tasks of the F1 of class 1; a task without that class, in truth or prediction, counts 0."""
    g, p = F.col(gold) == 1, F.coalesce(F.col(predicted) == 1, F.lit(False))
    each = rows.groupBy(task).agg(F.count_if(g & p).alias("tp"), F.count_if(g).alias("g"), F.count_if(p).alias("p"))
    return each.agg(F.round(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("g") + F.col("p")), F.lit(0.0))), 6).alias("avg_f1"))


def entity_f1(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Exact-match precision, recall and F1 of sets of entities: one semi-join on all keys."""
    gold, predicted = gold.select(*keys).distinct(), predicted.select(*keys).distinct()
    hit = predicted.join(gold, keys, "left_semi").agg(F.count("*").alias("tp"))
    counts = hit.crossJoin(gold.agg(F.count("*").alias("g"))).crossJoin(predicted.agg(F.count("*").alias("p")))  # one row each
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return counts.select(ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("g")).alias("recall"), ratio(2 * F.col("tp"), F.col("g") + F.col("p")).alias("entity_f1"))


def perplexity(nll: str) -> list[Column]:
    return [F.round(F.avg(nll), 6).alias("cross_entropy"), F.round(F.exp(F.avg(nll)), 6).alias("perplexity")]


def log_loss(y: Column, p: Column, n: Column | None = None, eps: float = 1e-15) -> Column:
    """Mean loss of rows, or of rows that stand for n each; nulls don't count."""
    loss = y * F.ln(p + eps) + (1 - y) * F.ln(1 - p + eps)
    return -F.avg(loss) if n is None else -F.sum(loss * n) / F.sum(F.when(loss.isNotNull(), n))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def activations(x: Column) -> dict[str, Column]:
    return {"sigmoid": sigmoid(x), "swish": x * sigmoid(x), "relu": F.greatest(x, F.lit(0.0)), "tanh": F.tanh(x)}


def activation_grads(x: Column) -> dict[str, Column]:
    s = sigmoid(x)
    return {"sigmoid": s * (1 - s), "swish": x * s + s * (1 - x * s), "relu": (x > 0).cast("double"), "tanh": 1 - F.tanh(x) * F.tanh(x)}


def learning_rate(k: Column, steps: int, warm: float, peak: float) -> Column:
    """Linear warm-up over ``warm`` of the steps, then half a cosine."""
    w = math.ceil(warm * steps)
    return F.when(k < w, peak * k / w).otherwise(peak * 0.5 * (1 + F.cos(math.pi * (k - w) / max(1, steps - w))))


def sinusoid(position: Column, i: Column, d: int) -> Column:
    angle = position / F.pow(F.lit(10000.0), 2 * F.floor(i / 2) / d)
    return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def log_records(lines: DataFrame, fields: list[str], column: str = "value") -> DataFrame:
    """Dict literals in log lines as columns, null where a field is missing; lines without one go."""
    number = r"(-?[0-9.]+(?:e[+-]?[0-9]+)?)"
    found = lines.filter(F.regexp_like(column, F.lit(r"^\s*\{'")))
    return found.select(*(F.expr(f"try_cast(regexp_extract({column}, \"'{f}': {number}\", 1) AS double)").alias(f) for f in fields))


def eval_table(lines: DataFrame, series: str, order: str, column: str = "value") -> DataFrame:
    """Rows of a pipe table (task, version, metric, value, stderr) with the task and version filled down; headers and rules go."""
    cells = F.transform(F.split(column, r"\|"), lambda c: F.trim(c))
    rows = lines.filter(F.regexp_like(column, F.lit(r"^\|.*\|\s*$")) & ~F.regexp_like(column, F.lit(r"^\|\s*(Task|-)"))).select(series, order, cells.alias("c"))
    cell = lambda i: F.nullif(F.get("c", F.lit(i)), F.lit(""))
    rows = rows.select(series, order, cell(1).alias("task"), cell(2).try_cast("int").alias("version"), cell(3).alias("metric"), cell(4).try_cast("double").alias("value"), cell(6).try_cast("double").alias("stderr"))
    return fill_down(fill_down(rows, series, order, "task"), series, order, "version")


def logistic_descent(data: DataFrame, x: list[str], y: str, rate: float, steps: int, start: list[float]) -> list[list[float]]:
    """Weights after each step of batch gradient descent on the logistic loss (the sum of gradients, as one aggregation a step)."""
    path = [list(start)]
    for _ in range(steps):
        error = sigmoid(sum((F.col(c) * w for c, w in zip(x, path[-1])), F.lit(0.0))) - F.col(y)
        grad = data.agg(*(F.sum(error * F.col(c)) for c in x)).first()
        path.append([w - rate * (g or 0.0) for w, g in zip(path[-1], grad)])
    return path
