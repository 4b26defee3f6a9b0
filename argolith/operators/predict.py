"""Step 7: was the root's strength shifted enough? Thresholds, votes, metrics, tuning and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENSEMBLE = "ensemble"


def predict(shifts: DataFrame, thresholds: list[float]) -> DataFrame:
    """Each root shift (thread_id, mode, strategy, abs_delta, ...) against each distinct threshold, in order."""
    ts = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    x = shifts.withColumn("threshold", F.explode(ts))
    return x.withColumn("predicted", F.col("abs_delta") >= F.col("threshold"))


def label(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ground_truth (null without a label) and correct (null then)."""
    x = predictions.join(labels.select("thread_id", F.col("is_delta").alias("ground_truth")), "thread_id", "left")
    return x.withColumn("correct", F.col("predicted") == F.col("ground_truth"))


def vote(predictions: DataFrame) -> DataFrame:
    """Votes of the strategies; half of them suffice."""
    on = ["thread_id", "mode", "threshold"]
    v = predictions.groupBy(*on).agg(F.sum(F.col("predicted").cast("long")).alias("votes_persuasive"), F.count(F.lit(1)).alias("votes_total"), F.avg("abs_delta").alias("mean_abs_delta"))
    return v.withColumn("predicted", (F.col("votes_total") > 0) & (F.col("votes_persuasive") >= F.ceil(F.col("votes_total") / 2)))


def with_ensemble(predictions: DataFrame) -> DataFrame:
    """The strategies' predictions and, as one more strategy, their vote."""
    cols = ["thread_id", "mode", "threshold", "strategy", "abs_delta", "predicted"]
    e = vote(predictions).select("thread_id", "mode", "threshold", F.lit(ENSEMBLE).alias("strategy"), F.col("mean_abs_delta").alias("abs_delta"), "predicted")
    return predictions.select(*cols).unionByName(e)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(labelled: DataFrame, *by: str) -> DataFrame:
    """Counts and metrics of (predicted, ground_truth) by group; rows without a label are left out; 0 where a denominator is."""
    p, g = F.col("predicted"), F.col("ground_truth")
    n = [F.sum(c.cast("long")).alias(k) for k, c in (("tp", p & g), ("tn", ~p & ~g), ("fp", p & ~g), ("fn", ~p & g))]
    m = labelled.filter("ground_truth is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *n)
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    values = {
        "accuracy": _ratio(tp + tn, F.col("n").cast("double")), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "mcc": _ratio(tp * tn - fp * fn, under),
    }
    return m.select(*by, "n", "tp", "tn", "fp", "fn", *[F.round(v, 4).alias(k) for k, v in values.items()])


def tune(shifts: DataFrame, labels: DataFrame, metric: str = "f1", grid: list[float] | None = None) -> DataFrame:
    """The threshold of the grid with the best metric for each mode and strategy, the smallest of equals."""
    grid = grid or [round(0.01 * k, 2) for k in range(1, 51)]
    m = binary_metrics(label(predict(shifts, grid), labels), "mode", "strategy", "threshold")
    w = W.partitionBy("mode", "strategy").orderBy(F.desc(metric), "threshold")
    return m.withColumn("k", F.row_number().over(w)).filter("k = 1").select("mode", "strategy", F.col("threshold").alias("best_threshold"), F.col(metric).alias("best"))


def auc(scored: DataFrame, *by: str, score: str = "abs_delta") -> DataFrame:
    """Area under the ROC curve with tied scores as one step; null with one class only. Scores are counted first, so large groups stay small."""
    c = scored.filter("ground_truth is not null").groupBy(*by, score).agg(F.sum(F.col("ground_truth").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("wins", F.col("p") * (below + (F.col("n") - F.col("p")) / 2))
    g = c.groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    pairs = (F.col("p") * (F.col("n") - F.col("p"))).cast("double")
    return g.select(*by, F.round(F.when(pairs > 0, F.col("wins") / pairs), 4).alias("auc"))


def evaluate(shifts: DataFrame, labels: DataFrame, thresholds: list[float]) -> DataFrame:
    """Accuracy and F1 of each threshold and strategy, the vote included; the AUC of a strategy is that of its shifts."""
    x = label(with_ensemble(predict(shifts, thresholds)), labels)
    m = binary_metrics(x, "mode", "threshold", "strategy").select("mode", "threshold", "strategy", "n", "accuracy", "f1")
    first = x.filter(F.col("threshold") == float(min(thresholds)))
    return m.join(auc(first, "mode", "strategy"), ["mode", "strategy"], "left").select("mode", "threshold", "strategy", "n", "accuracy", "f1", "auc")


def pivot(metrics: DataFrame, metric: str, strategies: list[str]) -> DataFrame:
    return metrics.groupBy("mode", "threshold").pivot("strategy", strategies).agg(F.first(metric))


def compare(metrics: DataFrame, metric: str = "f1") -> DataFrame:
    """repair against no_repair."""
    a = metrics.filter("mode = 'repair'").select("threshold", "strategy", F.col(metric).alias("repair"))
    b = metrics.filter("mode = 'no_repair'").select("threshold", "strategy", F.col(metric).alias("no_repair"))
    return a.join(b, ["threshold", "strategy"]).withColumn("difference", F.round(F.col("repair") - F.col("no_repair"), 4))


def load_predictions(records: DataFrame, sentinel: str = "__eval__") -> tuple[DataFrame, DataFrame]:
    """(predictions with ground_truth, evaluation rows) of stored predictions."""
    is_eval = F.coalesce(F.col(sentinel), F.lit(False))
    rows = records.filter(~is_eval).withColumn("ground_truth", F.coalesce("ground_truth", "is_delta"))
    return rows.drop(sentinel), records.filter(is_eval)


def load_truth(lines: DataFrame, key: str = "is_delta") -> DataFrame:
    """(thread_id, label) from records (line, thread_id, key): of repeats the last line with a label counts."""
    x = lines.filter(F.col("thread_id").isNotNull() & (F.col("thread_id") != "") & F.col(key).isNotNull())
    return x.groupBy("thread_id").agg(F.max_by(F.col(key).cast("boolean"), F.col("line")).alias("label"))


def inject(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Fills labels that are missing from truth (thread_id, label), one row for each thread."""
    t = truth.filter("label is not null").select("thread_id", F.col("label").alias("__l"))
    return records.join(t, "thread_id", "left").withColumn("ground_truth", F.coalesce("ground_truth", "__l")).drop("__l")
