"""The repeated cross-validation experiment: conditions, scores and tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.estimators import BalancedLogistic, FoldEstimator
from tidewell.operators.fits import Table, tested_predictions
from tidewell.operators.folds import hashed_folds
from tidewell.operators.metrics import bootstrap_ci, macro_f1, paired_summary, rep_scores, summarize_reps
from tidewell.operators.models import ESTIMATORS, fold_predictions, stratified_predictions
from tidewell.operators.prep import to_participant_level
from tidewell.sources.shared import new_path, written

TASKS = ("2class", "3class")
KINDS = ("distributional", "temporal", "combined")

# The compared conditions and what the comparisons are called.
PAIRS = [
    ("3class: combined vs dist", "3class/distributional", "3class/combined"),
    ("2class: combined vs dist", "2class/distributional", "2class/combined"),
    ("3class: temporal vs dist", "3class/distributional", "3class/temporal"),
    ("3class: combined vs dummy", "3class/dummy", "3class/combined"),
    ("2class: combined vs dummy", "2class/dummy", "2class/combined"),
]


def _labels(label: str) -> dict:
    """Expressions of the tasks' labels: control against patient, and all classes."""
    return {"2class": F.when(F.col(label) == "control", "control").otherwise("patient"), "3class": F.col(label)}


def run_experiment(data: DataFrame, folds: DataFrame, distributional: list[str], temporal: list[str], label: str = "class", pairs: list[tuple[str, str, str]] | None = None, estimator: FoldEstimator | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw scores, summary, paired): all conditions on the same folds.

    data: pid, label, feature columns without nulls. The conditions are two
    tasks by three sets of columns, all of which ``estimator`` (balanced
    logistic regression) fits in the same passes, and for each task labels
    drawn at random. Data and folds, which many passes read, and raw scores, of
    which the tables are made, are written to the shared folder once.
    """
    columns, own = [*distributional, *temporal], _labels(label)
    rows, folds = written(data.select("pid", *columns, *[own[t].alias(f"_{t}") for t in TASKS])), written(folds.select("rep", "fold", "pid"))
    sets = {"distributional": list(range(len(distributional))), "temporal": list(range(len(distributional), len(columns))), "combined": None}
    table = Table(rows, columns, [f"_{t}" for t in TASKS], folds)
    fits = table.fits([(t, sets[kind]) for t in range(len(TASKS)) for kind in KINDS])
    found = tested_predictions(table, fits, (estimator or BalancedLogistic()).fold_codes(table, fits))
    named = found.select(
        F.get(F.array(*[F.lit(t) for t in TASKS]), F.floor(F.col("condition") / len(KINDS)).cast("int")).alias("task"),
        F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("condition") % len(KINDS)).alias("feature_set"),
        *["rep", "fold", "y_true", "y_pred"],
    )
    chance = [stratified_predictions(rows, folds, f"_{t}").select(F.lit(t).alias("task"), F.lit("dummy").alias("feature_set"), "rep", "fold", "y_true", "y_pred") for t in TASKS]
    scored = macro_f1(reduce(DataFrame.union, [named, *chance]), ("task", "feature_set", "rep", "fold"))
    at = new_path(data.sparkSession)
    scored.withColumn("macro_f1", F.round("macro_f1", 5)).write.parquet(at)
    table.discard()
    raw = data.sparkSession.read.schema(scored.schema).parquet(at)
    reps = rep_scores(raw)
    return raw, summarize_reps(reps), paired_summary(reps, PAIRS if pairs is None else pairs)


def experiment_grid(features: DataFrame, columns: list[str], n_folds: int = 5, user: str = "user", label: str = "class", estimators: tuple[str | Estimator, ...] = ("dummy", "logistic", "boosted")) -> DataFrame:
    """(track, aggregation, estimator, pid, y_true, y_pred): out-of-fold predictions of the per-day feature table.

    Tracks are three classes and control against patient, aggregations days
    and participants (means, most frequent class). Folds are by participant,
    so the days of one are tested together. A day's pid is user:day. Both
    tracks are fitted in the same passes; an estimator of the caller's goes by
    its class's name. The features, participants and folds, which many passes
    read, are written to the shared folder once, and so are the predictions.
    """
    features = written(features)
    people = written(to_participant_level(features, tuple(columns)))
    tables = {"per_day": features.withColumn("pid", F.concat_ws(":", F.col(user).cast("string"), F.col("day").cast("string"))), "per_participant": people.withColumn("pid", F.col(user).cast("string"))}
    of = written(hashed_folds(people.select(F.col(user).cast("string").alias("pid")), n_folds, 1).select("rep", "fold", F.col("pid").alias("_user")))
    own = _labels(label)

    def predicted(aggregation: str) -> DataFrame:
        rows = tables[aggregation].select("pid", F.col(user).cast("string").alias("_user"), *[own[t].alias(f"_{t}") for t in TASKS], *columns).fillna(0.0, columns)
        folds = of.join(rows.select("pid", "_user"), "_user").select("rep", "fold", "pid")
        table, parts = None, []
        for e in estimators:
            made = ESTIMATORS[e]() if e in ESTIMATORS else e
            if isinstance(made, FoldEstimator):
                table = table or Table(rows, columns, [f"_{t}" for t in TASKS], folds)
                fits = table.fits([(t, None) for t in range(len(TASKS))])
                found = tested_predictions(table, fits, made.fold_codes(table, fits)).withColumn("track", F.get(F.array(*[F.lit(t) for t in TASKS]), F.col("condition")))
            else:
                found = reduce(DataFrame.union, [fold_predictions(rows, folds, columns, f"_{t}", made).withColumn("track", F.lit(t)) for t in TASKS])
            parts.append(found.select("track", F.lit(aggregation).alias("aggregation"), F.lit(e if isinstance(e, str) else type(e).__name__).alias("estimator"), "pid", "y_true", "y_pred"))
        made = written(reduce(DataFrame.union, parts))
        if table:
            table.discard()
        return made

    with ThreadPoolExecutor(len(tables)) as pool:
        return reduce(DataFrame.union, pool.map(inheritable_thread_target(features.sparkSession)(predicted), tables))


def grid_summary(predictions: DataFrame) -> DataFrame:
    """(track, aggregation, estimator, macro_f1, lower, upper) of experiment_grid's predictions."""
    keys = ("track", "aggregation", "estimator")
    return macro_f1(predictions, keys).join(bootstrap_ci(predictions, keys=keys), list(keys))
