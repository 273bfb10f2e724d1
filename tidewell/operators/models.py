"""Single fits, and repeated cross-validation of any estimator."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.params import one_of
from tidewell.operators.estimators import BalancedLogistic, BoostedTrees, FoldEstimator
from tidewell.operators.fits import MAX_CLASSES, Table, tested_predictions
from tidewell.operators.metrics import macro_f1


def combined_matrix(distributional: DataFrame, temporal: DataFrame, columns: list[str], key: str = "user") -> DataFrame:
    """(key, class, features): the two feature tables joined and assembled in the given order; a null is an error when read."""
    joined = distributional.join(temporal.drop("class"), key)
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(joined).select(key, "class", "features")


def _scaler(train: DataFrame, columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the vector _x, standardised by the training rows' mean and population deviation."""
    stats = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()

    def scale(rows: DataFrame) -> DataFrame:
        values = [((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)) for c in columns]
        return rows.withColumn("_x", array_to_vector(F.array(*values)))

    return scale


def fit_logistic(train: DataFrame, columns: list[str], label: str, c: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A function that adds y_pred and probabilities to rows: L2 logistic regression with balanced class weights on standardised columns.

    label holds codes from 0. For any number of rows; Spark ML fits it.
    """
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    weights = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, n / (len(counts) * v))])
    scale = _scaler(train, columns)
    fitted = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8, family="multinomial" if len(counts) > 2 else "binomial").fit(scale(train).withColumn("_w", weights[F.col(label)]))
    return lambda rows: fitted.transform(scale(rows)).select(*rows.columns, F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability").alias("probabilities"))


def logistic_regression(train: DataFrame, test: DataFrame, columns: list[str], label: str, c: float = 1.0) -> DataFrame:
    """test with y_pred and probabilities of fit_logistic on train."""
    return fit_logistic(train, columns, label, c)(test)


def permutation_importance(predict: Callable[[DataFrame], DataFrame], test: DataFrame, columns: list[str], label: str, seed: int = 42, bucket_rows: int = 10_000) -> DataFrame:
    """(feature, loss): fall of macro-F1 when a column is shuffled among the test rows; an approximation of attributions.

    predict adds y_pred to rows. Rows are dealt by hash into buckets of about
    bucket_rows; in each they are put in the order of another hash, and a
    column's values move on by a number of places of its own. All columns are
    scored in one job.
    """
    n = test.count()
    buckets = max(1, -(-n // bucket_rows))
    rows = test.select(F.col(label).alias("_y"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_x", "_y", F.lit(seed)), F.lit(buckets)))
    placed = rows.select("_y", "_x", "_b", (F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64("_x", "_y", F.lit(seed + 1)), "_x", "_y")) - 1).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy("_b")).alias("_n"))
    # -1 stands for the rows as they are
    asked = placed.select("_y", "_x", "_b", "_r", "_n", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))).alias("_k"))
    moved = F.when(F.col("_k") < 0, 0).otherwise(1 + F.pmod(F.xxhash64("_b", "_k", F.lit(seed)), F.greatest(F.col("_n") - 1, F.lit(1))))
    asked = asked.withColumn("_from", F.pmod(F.col("_r") + moved, F.col("_n")))
    other = placed.select(F.col("_b").alias("_ob"), F.col("_r").alias("_or"), F.col("_x").alias("_ox"))
    mixed = asked.join(other, (F.col("_b") == F.col("_ob")) & (F.col("_from") == F.col("_or")))
    mixed = mixed.select("_y", "_k", F.transform("_x", lambda v, i: F.when(i == F.col("_k"), F.get(F.col("_ox"), i)).otherwise(v)).alias("_x"))
    wide = mixed.select(F.col("_y").alias(label), "_k", *[F.col("_x")[k].alias(c) for k, c in enumerate(columns)])
    scores = macro_f1(predict(wide).select("_k", F.col(label).alias("y_true"), "y_pred"), ("_k",))
    base = scores.where("_k < 0").select(F.col("macro_f1").alias("_base"))
    names = F.array(*[F.lit(c) for c in columns])
    return scores.where("_k >= 0").join(F.broadcast(base)).select(F.get(names, F.col("_k")).alias("feature"), (F.col("_base") - F.col("macro_f1")).alias("loss"))


def stratified_predictions(data: DataFrame, folds: DataFrame, label: str = "y", seed: int = 0) -> DataFrame:
    """(rep, fold, pid, y_true, y_pred) of random labels in the proportions of each fold's training labels, for any number of rows.

    A row's draw is a hash of seed, repetition and pid; labels in their order
    share the range of the hash.
    """
    people = data.select(F.col("pid").cast("string").alias("pid"), F.col(label).alias("y_true"))
    if people.select("y_true").distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:  # their shares are one row
        raise ValueError(f"more than {MAX_CLASSES} classes")
    tested = folds.select("rep", "fold", "pid").join(people, "pid")
    every = people.groupBy("y_true").agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("y_true", "n"))).alias("every"))
    mine = tested.groupBy("rep", "fold", "y_true").agg(F.count(F.lit(1)).alias("n")).groupBy("rep", "fold").agg(F.map_from_entries(F.collect_list(F.struct("y_true", "n"))).alias("mine"))
    left = lambda x: x["n"] - F.coalesce(F.element_at("mine", x["y_true"]), F.lit(0))
    up_to = lambda k: F.aggregate(F.slice("every", F.lit(1), k + 1), F.lit(0).cast("long"), lambda a, x: a + left(x))
    shares = mine.join(F.broadcast(every)).select("rep", "fold", F.transform("every", lambda x, k: F.struct(x["y_true"].alias("label"), up_to(k).alias("to"))).alias("shares"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), "pid")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = tested.join(shares, ["rep", "fold"]).withColumn("_at", draw * F.element_at("shares", -1)["to"])
    return rows.select("rep", "fold", "pid", "y_true", F.filter("shares", lambda x: F.col("_at") < x["to"])[0]["label"].alias("y_pred"))


#: Estimators of the study; any other name is an error, and any Spark ML estimator does as well.
ESTIMATORS = {"logistic": BalancedLogistic, "boosted": BoostedTrees}


def fold_predictions(data: DataFrame, folds: DataFrame, columns: list[str], label: str = "y", estimator: str | Estimator = "logistic", at_once: int = 4) -> DataFrame:
    """(rep, fold, pid, y_true, y_pred): the test rows of every fold, each predicted by a model of the rows that aren't tested in it.

    data: pid, label, columns, any number of rows. estimator is "dummy",
    "logistic", "boosted" or a Spark ML estimator of the caller's, which gets
    the vector column "features" and class numbers "label", and whose model
    adds the class number "prediction". Where it is a FoldEstimator, as the
    library's own are, all folds are fitted in the same passes over the table;
    another is fitted fold by fold, ``at_once`` side by side.
    """
    if estimator == "dummy":
        return stratified_predictions(data, folds, label)
    if isinstance(estimator, str):
        one_of("estimator", estimator, ("dummy", *ESTIMATORS))
    made = ESTIMATORS[estimator]() if isinstance(estimator, str) else estimator
    if isinstance(made, FoldEstimator):
        table = Table(data, columns, label, folds)
        fits = table.fits()
        return tested_predictions(table, fits, made.fold_codes(table, fits)).drop("condition")
    return _one_by_one(data, folds, columns, label, made, at_once)


def _one_by_one(data: DataFrame, folds: DataFrame, columns: list[str], label: str, estimator: Estimator, at_once: int) -> DataFrame:
    kind = dict(data.dtypes)[label]
    classes = sorted(r[0] for r in data.select(label).distinct().limit(MAX_CLASSES + 1).collect())
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not classes:
        return data.sparkSession.createDataFrame([], f"rep int, fold int, pid string, y_true {kind}, y_pred {kind}")
    number = F.create_map(*[x for k, v in enumerate(classes) for x in (F.lit(v), F.lit(float(k)))])[F.col(label)]
    known = F.array(*[F.lit(v).cast(kind) for v in classes])
    rows = data.select(F.col("pid").cast("string").alias("pid"), F.col(label).alias("y_true"), number.alias("label"), array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"))
    names = sorted((r["rep"], r["fold"]) for r in folds.select("rep", "fold").distinct().collect())

    def one(name: tuple[int, int]) -> DataFrame:
        ids = folds.where((F.col("rep") == name[0]) & (F.col("fold") == name[1])).select("pid").distinct()
        predicted = estimator.fit(rows.join(ids, "pid", "left_anti")).transform(rows.join(ids, "pid", "left_semi"))
        return predicted.select(F.lit(name[0]).alias("rep"), F.lit(name[1]).alias("fold"), "pid", "y_true", F.get(known, F.col("prediction").cast("int")).alias("y_pred"))

    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.union, pool.map(inheritable_thread_target(data.sparkSession)(one), names))


def evaluate_repeated(data: DataFrame, folds: DataFrame, columns: list[str], label: str = "y", estimator: str | Estimator = "logistic") -> DataFrame:
    """(rep, fold, macro_f1) of every fold; see fold_predictions."""
    return macro_f1(fold_predictions(data, folds, columns, label, estimator), ("rep", "fold"))
