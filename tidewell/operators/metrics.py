"""Classification metrics and statistics of repeated cross-validation.

Predictions are (keys..., y_true, y_pred[, score]); keys may be empty. Counts
are aggregated before anything is joined, so what the joins see is labels, not
rows.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewell.functions.student import t_quantile
from tidewell.operators.summaries import value_ranges


def label_counts(predictions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, tp, fp, fn) for every label that is true or predicted somewhere under the keys."""
    cells = predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("y_true") == F.col("y_pred")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    rows = cells.select(*keys, F.inline(sides))
    return rows.groupBy(*keys, "label").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def per_class_metrics(predictions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, precision, recall, f1, support); a ratio without a denominator is 0."""
    n = label_counts(predictions, keys)
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp"), F.col("fn")
    return n.select(*keys, "label", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_f1(predictions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, macro_f1): unweighted mean over the labels that are true or predicted."""
    return per_class_metrics(predictions, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def confusion_normalized(predictions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y_true, y_pred, share) for every pair of labels; a label that is never true has zeros."""
    cells = predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    labels = label_counts(predictions, keys).groupBy(*keys).agg(F.collect_set("label").alias("_l"))
    grid = labels.select(*keys, "_l", F.explode("_l").alias("y_true")).select(*keys, "y_true", F.explode("_l").alias("y_pred"))
    joined = grid.join(cells, [*keys, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*keys, "y_true"))
    return joined.select(*keys, "y_true", "y_pred", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)).alias("share"))


def confusion_fold(predictions: DataFrame, rep: int = 0, fold: int = 0) -> DataFrame:
    """(y_true, y_pred, share): row-normalised confusion of one fold of predictions (rep, fold, y_true, y_pred)."""
    return confusion_normalized(predictions.where((F.col("rep") == rep) & (F.col("fold") == fold)).select("y_true", "y_pred"))


def roc_auc(scores: DataFrame, keys: tuple[str, ...] = (), label: str = "y_true", score: str = "score", parts: int | None = None) -> DataFrame:
    """(keys, auc) of 0/1 labels, exact, ties counted half; null if a class is absent.

    Rows are first counted by score. The running sum over distinct scores is
    cut into ranges of scores (see summaries.value_ranges), and the sums of the
    ranges before are added, so no task sees all scores.
    """
    rows = scores.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    by = rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    by, cuts = value_ranges(by, "_s", parts)
    by = by.join(F.broadcast(cuts)).withColumn("_p", F.size(F.filter("_cuts", lambda c: c <= F.col("_s")))).drop("_cuts")
    below = F.sum(F.col("n") - F.col("pos")).over(Window.partitionBy(*keys, "_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    part = by.groupBy(*keys, "_p").agg(F.sum(F.col("n") - F.col("pos")).alias("_neg"))
    before = F.sum("_neg").over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    part = part.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_p") == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    by = by.withColumn("_below", F.coalesce(below, F.lit(0))).join(part, same)
    by = by.withColumn("won", F.col("pos") * (F.col("_before") + F.col("_below") + (F.col("n") - F.col("pos")) / 2))
    total = by.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    return total.select(*keys, F.try_divide(F.col("won"), F.col("pos").cast("double") * (F.col("n") - F.col("pos"))).alias("auc"))


def roc_auc_macro(scores: DataFrame, labels: list) -> DataFrame:
    """(auc): mean over the labels of one-against-rest AUC of the columns proba_<label>; null if one is undefined."""
    long = scores.select(F.inline(F.array(*[F.struct(F.lit(str(c)).alias("label"), (F.col("y_true") == F.lit(c)).cast("int").alias("y_true"), F.col(f"proba_{c}").alias("score")) for c in labels])))
    each = roc_auc(long, ("label",))
    return each.agg(F.when(F.count("auc") == len(labels), F.avg("auc")).alias("auc"))


def bootstrap_ci(predictions: DataFrame, resamples: int = 1000, seed: int = 42, level: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lower, upper): percentiles of macro-F1 over resamples of the rows.

    A resample draws as many rows as there are with replacement; the confusion
    counts of one are a multinomial draw from the cells, so only the cells (at
    most labels squared) meet in a task.
    """
    cells = predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("y_true").cast("string").alias("t"), F.col("y_pred").cast("string").alias("p"), "n"))).alias("cells"))

    def draw(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                cells = row["cells"]
                n = np.array([c["n"] for c in cells], dtype=np.int64)
                if not len(n):
                    continue
                labels = sorted({c[k] for c in cells for k in ("t", "p")})
                t, p = (np.array([labels.index(c[k]) for c in cells]) for k in ("t", "p"))
                counts = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), resamples)
                f1 = np.full((resamples, len(labels)), np.nan)
                for k in range(len(labels)):
                    tp = counts[:, (t == k) & (p == k)].sum(axis=1)
                    either = counts[:, t == k].sum(axis=1) + counts[:, p == k].sum(axis=1)
                    f1[:, k] = np.where(either > 0, 2 * tp / np.maximum(either, 1), np.nan)
                yield pd.DataFrame({**{k: [row[k]] * resamples for k in keys}, "f1": np.nanmean(f1, axis=1)})

    drawn = packed.mapInPandas(draw, StructType([*[packed.schema[k] for k in keys], StructField("f1", DoubleType())]))
    tail = (1 - level) / 2
    return drawn.groupBy(*keys).agg(F.percentile("f1", tail).alias("lower"), F.percentile("f1", 1 - tail).alias("upper"))


def evaluate_predictions(predictions: DataFrame, seed: int = 42) -> DataFrame:
    """One row: macro_f1, its bootstrap interval, per_class and confusion as arrays, and n."""
    per = per_class_metrics(predictions).agg(F.sort_array(F.collect_list(F.struct("label", "precision", "recall", "f1", "support"))).alias("per_class"))
    cells = confusion_normalized(predictions).agg(F.sort_array(F.collect_list(F.struct("y_true", "y_pred", "share"))).alias("confusion"))
    parts = [macro_f1(predictions), bootstrap_ci(predictions, seed=seed), per, cells, predictions.agg(F.count(F.lit(1)).alias("n"))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def rep_scores(fold_scores: DataFrame) -> DataFrame:
    """(task, feature_set, rep, score): mean over the folds of each repetition."""
    return fold_scores.groupBy("task", "feature_set", "rep").agg(F.avg("macro_f1").alias("score"))


@cache
def _t(df: int) -> float:
    return t_quantile(0.975, df)


def _t_critical(n):
    """t at .975 for n-1 degrees of freedom: exact up to 60 repetitions, beyond by the first terms of its series in 1/df."""
    table = F.array(*[F.lit(None).cast("double")] * 2, *[F.lit(_t(k)) for k in range(1, 60)])
    z, df = 1.959963984540054, n - 1
    series = F.lit(z) + F.lit((z**3 + z) / 4) / df + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (df * df) + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (df * df * df)
    return F.when(n <= 60, F.get(table, n.cast("int"))).otherwise(series)


def summarize_reps(scores: DataFrame, reps: int | None = None) -> DataFrame:
    """(task, feature_set, n_reps, mean_f1, sd_f1, ci_lo_mean, ci_hi_mean): t intervals, rounded to four places."""
    found = scores.groupBy("task", "feature_set").agg(F.count(F.lit(1)).alias("n_reps"), F.avg("score").alias("m"), F.stddev_samp("score").alias("s"))
    half = _t_critical(F.col("n_reps")) * F.col("s") / F.sqrt("n_reps")
    return found.select("task", "feature_set", "n_reps", F.round("m", 4).alias("mean_f1"), F.round("s", 4).alias("sd_f1"), F.round(F.col("m") - half, 4).alias("ci_lo_mean"), F.round(F.col("m") + half, 4).alias("ci_hi_mean"))


def paired_summary(scores: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(label, n_reps, mean_diff, sd_diff, ci_lo_diff, ci_hi_diff, frac_positive) of b minus a for pairs (label, a, b).

    a and b are any two conditions, 'task/feature_set'. Raises ValueError where
    the two sides don't have the same repetitions, a repetition more than once,
    or none at all; a zero difference isn't positive.
    """
    spark = scores.sparkSession
    spec = spark.createDataFrame([(label, a, b) for label, a, b in pairs], "label string, a string, b string")
    each = scores.select(F.concat_ws("/", "task", "feature_set").alias("condition"), "rep", "score")
    side = lambda k: F.broadcast(spec).join(each, F.col(k) == F.col("condition")).groupBy("label", "rep").agg(F.first("score").alias(k), F.count(F.lit(1)).alias(f"n_{k}"))
    both = spec.select("label").join(side("a").join(side("b"), ["label", "rep"], "full"), "label", "left")
    odd = both.where(~(F.col("n_a").eqNullSafe(F.lit(1)) & F.col("n_b").eqNullSafe(F.lit(1)))).select("label").distinct().limit(5).collect()
    if odd:
        raise ValueError(f"the two sides have different repetitions: {sorted(r['label'] for r in odd)}")
    diff = F.col("b") - F.col("a")
    found = both.groupBy("label").agg(F.count(F.lit(1)).alias("n_reps"), F.avg(diff).alias("m"), F.stddev_samp(diff).alias("s"), F.avg((diff > 0).cast("double")).alias("p"))
    half = _t_critical(F.col("n_reps")) * F.col("s") / F.sqrt("n_reps")
    return found.select("label", "n_reps", F.round("m", 4).alias("mean_diff"), F.round("s", 4).alias("sd_diff"), F.round(F.col("m") - half, 4).alias("ci_lo_diff"), F.round(F.col("m") + half, 4).alias("ci_hi_diff"), F.round("p", 3).alias("frac_positive"))


def results_tables(labelled: DataFrame, pairs: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Summary and paired tables of rows (condition 'task/feature_set', rep, score)."""
    scores = labelled.select(F.split_part("condition", F.lit("/"), F.lit(1)).alias("task"), F.expr("substring(condition, instr(condition, '/') + 1)").alias("feature_set"), "rep", "score")
    return summarize_reps(scores), paired_summary(scores, pairs)


def comparison_table(summary: DataFrame) -> DataFrame:
    """(task, feature_set, height, error_low, error_high): what a bar chart of the summary shows."""
    return summary.select("task", "feature_set", F.col("mean_f1").alias("height"), F.round(F.col("mean_f1") - F.col("ci_lo_mean"), 4).alias("error_low"), F.round(F.col("ci_hi_mean") - F.col("mean_f1"), 4).alias("error_high"))
