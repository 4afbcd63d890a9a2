"""Reports on metric series, predictions and numeric schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import report as R
from lexmill.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rolling_mean(_events(spark, sf_dir).select("event_type", "event_id", "value"), "event_type", "event_id", "value").select("event_id", F.round("rolling", 6).alias("rolling"))


def threshold_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(R.share(v < 10), 6).alias("below"), F.round(R.share(v > 50), 6).alias("above"))


def first_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_diff(_events(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("event_id", F.round("diff", 6).alias("diff"))


def running_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, sf_dir).select("event_id", F.sum(F.lit(1)).over(so_far).alias("processed_examples"))


def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the way from each value to the next: a (1 - t) + b t at t = 0, 1/4, 1/2, 3/4."""
    step = F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = _events(spark, sf_dir).select("user_id", "event_id", "value", step.alias("next")).filter("next IS NOT NULL")
    rows = rows.select("event_id", "value", "next", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    return rows.select("event_id", "q", F.round(F.col("value") * (1 - F.col("q") / 4) + F.col("next") * F.col("q") / 4, 6).alias("point"))


def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.round(F.col("event_id") / 415, 6).alias("epoch"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_type", (F.col("value") / 100).alias("nll")).groupBy("event_type").agg(*R.perplexity("nll"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("n_chars") % 10 != 0, (F.col("n_chars") > 1000).cast("int")).alias("guess")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", guess), "doc_id")


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.class_metrics(_predictions(spark, sf_dir), "quality", "guess")


def entity_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return R.entity_f1(docs.filter("n_chars > 500").select("doc_id", "lang"), docs.filter("n_chars < 3000").select("doc_id", "lang"), ["doc_id", "lang"])


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("step"), F.min("value").alias("eval_loss"))


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 4151).select(F.col("id").alias("step"), F.round(R.learning_rate(F.col("id"), 4150, 0.05, 2e-4), 12).alias("lr"))


def _domain(spark: SparkSession) -> DataFrame:
    return spark.range(1000).select("id", (-12 + F.col("id") * 24 / 999).alias("x"))


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain(spark).select("id", *(F.round(c, 6).alias(n) for n, c in R.activations(F.col("x")).items()))


def activation_grads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain(spark).select("id", *(F.round(c, 6).alias(n) for n, c in R.activation_grads(F.col("x")).items()))


def sinusoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(100).select(F.col("id").alias("position")).crossJoin(spark.range(32).select(F.col("id").alias("dim")))
    return grid.select("position", "dim", F.round(R.sinusoid(F.col("position"), F.col("dim"), 32), 6).alias("value"))


def logloss_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of a two-weight logistic model at each of 100 x 100 points: equal rows are counted first, so that the grid (fixed size, broadcast) meets
    each combination once."""
    data = _predictions(spark, sf_dir).select(F.col("quality").alias("y"), (F.col("doc_id") % 7 / 7.0).alias("a"), (F.col("doc_id") % 3 / 3.0).alias("b"))
    points = data.filter("y IS NOT NULL").groupBy("y", "a", "b").agg(F.count("*").alias("n"))
    axis = lambda w: spark.range(100).select(((F.col("id") - 50) / 10).alias(w))
    grid = axis("w1").crossJoin(axis("w2"))
    p = R.sigmoid(F.col("a") * F.col("w1") + F.col("b") * F.col("w2"))
    return points.crossJoin(F.broadcast(grid)).groupBy("w1", "w2").agg(F.round(R.log_loss(F.col("y"), p, F.col("n")), 6).alias("loss"))


def log_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records out of log lines made from events, progress bars among them."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{'loss': "), F.round("value", 2).cast("decimal(18,2)"), F.lit(", 'grad_norm': "), (F.col("event_id") % 9).cast("string"), F.lit(", 'epoch': 1.5}"))).otherwise(F.lit("12%|#  | 3/9"))
    return R.log_records(_events(spark, sf_dir).select(line.alias("value")), ["loss", "grad_norm", "learning_rate", "epoch"])


def eval_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table per user, made from events: the task stands in the first row of each group of three."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    head = F.when(F.col("n") % 3 == 1, F.concat(F.lit("|task"), F.col("n").cast("string"), F.lit("|  1|"))).otherwise(F.lit("|   |   |"))
    line = F.concat(head, F.lit("m"), (F.col("event_id") % 4).cast("string"), F.lit("|"), F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("|±|0.01|"))
    return R.eval_table(rows.select("user_id", "event_id", line.alias("value")), "user_id", "event_id")


QUERIES = {
    f.__name__: f
    for f in (rolling_mean, threshold_pct, first_diff, running_pos, path_points, unit_conversion, perplexity, class_metrics, entity_f1, best_checkpoint, lr_schedule, activations, activation_grads, sinusoid, logloss_grid, log_scrape, eval_scrape)
}
_X = "WITH d AS (SELECT range AS id, -12 + range * 24 / 999 AS x FROM range(1000)), s AS (SELECT *, 1 / (1 + exp(-x)) AS s FROM d)"
_G = "WITH p AS (SELECT quality AS y, CASE WHEN n_chars % 10 <> 0 THEN CAST(n_chars > 1000 AS INTEGER) END AS g, doc_id % 7 / 7.0::DOUBLE AS a, doc_id % 3 / 3.0::DOUBLE AS b FROM labels JOIN documents USING (doc_id))"
SQL = {
    "rolling_mean": "SELECT event_id, CASE WHEN count(value) OVER w = 10 THEN round(avg(value) OVER w, 6) END AS rolling FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)",
    "threshold_pct": "SELECT event_type, round(avg(CAST(value < 10 AS INTEGER)) * 100, 6) AS below, round(avg(CAST(value > 50 AS INTEGER)) * 100, 6) AS above FROM events GROUP BY 1",
    "first_diff": "SELECT * FROM (SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS diff FROM events) WHERE diff IS NOT NULL",
    "running_pos": "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS processed_examples FROM events",
    "path_points": "WITH s AS (SELECT event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events), t AS (SELECT *, unnest([0, 1, 2, 3]) AS q FROM s WHERE nxt IS NOT NULL) SELECT event_id, q, round(value * (1 - q / 4) + nxt * q / 4, 6) AS point FROM t",
    "unit_conversion": "SELECT event_id, round(event_id / 415, 6) AS epoch FROM events",
    "perplexity": "SELECT event_type, round(avg(value / 100), 6) AS cross_entropy, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY 1",
    "class_metrics": _G + """, c AS (SELECT count(*) AS n, count_if(g IS NULL)::BIGINT AS missing, count_if(y = 1 AND g = 1)::DOUBLE AS tp, count_if(y = 0 AND g = 1)::DOUBLE AS fp, count_if(y = 1 AND g = 0)::DOUBLE AS fn, count_if(y = 0 AND g = 0)::DOUBLE AS tn FROM p)
SELECT n, missing, round((tp + tn) / n, 6) AS acc, round(sqrt((tp + tn) / n * (1 - (tp + tn) / n) / (n - 1)), 6) AS acc_stderr, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""",
    "entity_f1": "WITH c AS (SELECT count_if(n_chars > 500) AS g, count_if(n_chars < 3000) AS p, count_if(n_chars > 500 AND n_chars < 3000) AS tp FROM documents) SELECT round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * tp / (g + p), 6) AS entity_f1 FROM c",
    "best_checkpoint": "SELECT event_type, (list(event_id ORDER BY value, event_id))[1] AS step, min(value) AS eval_loss FROM events GROUP BY 1",
    "lr_schedule": "SELECT range AS step, round(CASE WHEN range < 208 THEN 2e-4 * range / 208 ELSE 2e-4 * 0.5 * (1 + cos(pi() * (range - 208) / (4150 - 208))) END, 12) AS lr FROM range(1, 4151)",
    "activations": _X + "SELECT id, round(s, 6) AS sigmoid, round(x * s, 6) AS swish, round(greatest(x, 0), 6) AS relu, round(tanh(x), 6) AS tanh FROM s",
    "activation_grads": _X + "SELECT id, round(s * (1 - s), 6) AS sigmoid, round(x * s + s * (1 - x * s), 6) AS swish, CAST(x > 0 AS DOUBLE) AS relu, round(1 - tanh(x) * tanh(x), 6) AS tanh FROM s",
    "sinusoid": "WITH g AS (SELECT p.range AS position, d.range AS dim, p.range / pow(10000.0, 2 * (d.range // 2) / 32) AS angle FROM range(100) p, range(32) d) SELECT position, dim, round(CASE WHEN dim % 2 = 0 THEN sin(angle) ELSE cos(angle) END, 6) AS value FROM g",
    "logloss_grid": _G + """, w AS (SELECT (i.range - 50) / 10 AS w1, (j.range - 50) / 10 AS w2 FROM range(100) i, range(100) j), l AS (SELECT w1, w2, y, 1 / (1 + exp(-(a * w1 + b * w2))) AS q FROM p, w)
SELECT w1, w2, round(-avg(y * ln(q + 1e-15) + (1 - y) * ln(1 - q + 1e-15)), 6) AS loss FROM l GROUP BY 1, 2""",
    "log_scrape": "SELECT round(value, 2) AS loss, CAST(event_id % 9 AS DOUBLE) AS grad_norm, CAST(NULL AS DOUBLE) AS learning_rate, 1.5::DOUBLE AS epoch FROM events WHERE event_id % 3 = 0",
    "eval_scrape": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, 'task' || (n - (n - 1) % 3) AS task, 1 AS version, 'm' || event_id % 4 AS metric, round(value, 2) AS value, 0.01::DOUBLE AS stderr FROM n",
}
