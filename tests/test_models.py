"""Classifiers, repeated cross-validation and their metrics against plain numpy."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import functions as F

from tests.plain_models import PlainBoosted, PlainLogistic, plain_shap, softmax
from tidewell.operators import boosting, estimators, fits, folds, metrics, models, prep, summaries
from tidewell.plans import experiment

COLUMNS = [f"x{k}" for k in range(6)]


def matrix(n=30, classes=3, shift=2.0, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, 6))
    x[:, 0] += shift * y
    return x, y


def frame(spark, x, y, label="y"):
    rows = [(f"p{k:03}", int(c), *map(float, v)) for k, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, f"pid string, {label} int, " + ", ".join(f"{c} double" for c in COLUMNS))


def plain_macro_f1(true, pred):
    out = []
    for c in set(true) | set(pred):
        tp = sum(t == p == c for t, p in zip(true, pred, strict=True))
        out.append(2 * tp / (sum(t == c for t in true) + sum(p == c for p in pred)))
    return sum(out) / len(out)


def without(doc):
    """(rep, fold, train, test) of a fold document over p000, p001, ..."""
    n = doc["metadata"]["n_participants"]
    for rep, one in enumerate(doc["repetitions"]):
        for fold, part in enumerate(one["folds"]):
            test = np.array([int(p[1:]) for p in part["test"]])
            yield rep, fold, np.setdiff1d(np.arange(n), test), test


@pytest.mark.parametrize(("classes", "few"), [(2, 8), (3, 8), (5, 8), (3, 0)])
def test_all_folds_have_the_coefficients_of_single_fits(spark, monkeypatch, classes, few):
    monkeypatch.setattr(fits, "FEW", few)
    x, y = matrix(150, classes, 0.8, 3)
    x[:, 1] = 7.0 + 1000 * x[:, 1]
    x[:, 2] = 5.0  # constant
    y[:40] = 0  # classes of unequal size
    doc = folds.repeated_folds([f"p{k:03}" for k in range(150)], 5, 4)
    table = fits.Table(frame(spark, x, y).repartition(3), COLUMNS, "y", folds.folds_frame(spark, doc))
    asked = table.fits([(0, None), (0, [0, 2, 5])])
    made = fits.fit_logistic(table, asked)
    for rep, fold, train, _ in without(doc):
        for condition, own in enumerate((list(range(6)), [0, 2, 5])):
            f = int(np.flatnonzero((asked.condition == condition) & (asked.fold == table.names.index((rep, fold))))[0])
            plain = PlainLogistic().fit(x[train][:, own], y[train])
            w, b = plain.weights
            scale = plain.scale  # per standard deviation, as the fits are
            np.testing.assert_allclose(made.weights[f][:, own] * scale, w * scale, atol=1e-6)
            np.testing.assert_allclose(made.intercepts[f] - made.intercepts[f].mean(), b - b.mean(), atol=1e-5)
            assert not made.weights[f][:, [c for c in range(6) if c not in own]].any()


def test_spark_and_own_fits_agree(spark):
    x, y = matrix(90, 3, 0.8, 3)
    y[:9] = 0
    plain = PlainLogistic().fit(x[:60], y[:60])
    test = frame(spark, x, y).where("pid >= 'p060'")
    found = sorted(models.logistic_regression(frame(spark, x, y).where("pid < 'p060'"), test, COLUMNS, "y").collect(), key=lambda r: r["pid"])
    w, b = plain.weights
    np.testing.assert_allclose([r["probabilities"] for r in found], softmax(x[60:] @ w.T + b), atol=2e-3)
    assert [r["y_pred"] for r in found] == plain.predict(x[60:]).tolist()


def test_folds_without_a_class_and_rows_in_no_fold(spark):
    x, y = matrix(40, 3, 2.0, 8)
    y[y == 2] = 1
    y[0] = 2  # only there
    rows = [(0, 0, "p000"), (0, 0, "p001"), (0, 1, "p002"), (0, 1, "p003"), (1, 0, "p000"), (1, 1, "p000"), (1, 1, "p009")]
    of = spark.createDataFrame(rows, "rep int, fold int, pid string")
    table = fits.Table(frame(spark, x, y), COLUMNS, "y", of)
    made = fits.fit_logistic(table)
    for f, name in enumerate(table.names):
        test = [int(p[1:]) for r, k, p in rows if (r, k) == name]
        train = np.setdiff1d(np.arange(40), test)
        plain = PlainLogistic().fit(x[train], y[train])
        w, _ = plain.weights
        np.testing.assert_allclose(made.weights[f][plain.classes], w, atol=1e-5)
        assert made.present[f].tolist() == [c in plain.classes for c in range(3)]
    found = {(r["rep"], r["fold"], r["pid"]): r["y_pred"] for r in models.fold_predictions(frame(spark, x, y), of, COLUMNS).collect()}
    assert set(found) == set(rows) and found[0, 0, "p000"] != 2
    nothing = frame(spark, x, y).where("false")
    assert models.fold_predictions(nothing, of, COLUMNS).collect() == []
    with pytest.raises(Exception, match="null"):
        models.fold_predictions(frame(spark, x, y).withColumn("x1", F.lit(None).cast("double")), of, COLUMNS)


@pytest.mark.parametrize(("classes", "few"), [(2, 8), (3, 0)])
def test_boosted_trees_are_those_of_plain_ones(spark, monkeypatch, classes, few):
    monkeypatch.setattr(fits, "FEW", few)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 6)).round(1)
    y = np.digitize(x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=160), [0.2] if classes == 2 else [-0.3, 0.3])
    doc = folds.repeated_folds([f"p{k:03}" for k in range(160)], 2, 1)
    table = fits.Table(frame(spark, x, y).repartition(3), COLUMNS, "y", folds.folds_frame(spark, doc))
    cuts = boosting.column_cuts(table, 8)
    made = boosting.fit_boosted(table, cuts, rounds=5, depth=3, rate=0.3, kept_rounds=2)
    for rep, fold, train, test in without(doc):
        f = table.names.index((rep, fold))
        plain = PlainBoosted(cuts, 5, 3, 0.3).fit([f"p{k:03}" for k in train], x[train], y[train])
        np.testing.assert_allclose(made.scores(x[test], f), plain.scores(x[test]), atol=1e-9)
    assert all(len(c) <= 7 and set(c) <= set(x[:, k]) for k, c in enumerate(cuts))


def test_boosted_trees_learn_what_lines_cannot(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    rows = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(frame(spark, x, y, "label"))
    train, test = rows.where("pid < 'p200'"), rows.where("pid >= 'p200'")
    model = estimators.BoostedTrees(rounds=12, rate=0.3, depth=3).fit(train)
    scored = model.transform(test.withColumn("prediction", F.lit("replaced")))
    assert scored.columns == [*test.columns, "prediction", "probability"]
    assert scored.where("label = prediction").count() > 85
    assert estimators.BalancedLogistic().fit(train).transform(test).where("label = prediction").count() < 70
    model.write().overwrite().save(f"{tmp_path}/trees")
    again = estimators.BoostedTreesModel.load(f"{tmp_path}/trees")
    assert sorted(map(str, again.transform(test).collect())) == sorted(map(str, model.transform(test).collect()))
    estimator = estimators.BoostedTrees(rounds=7, depth=2)
    estimator.write().overwrite().save(f"{tmp_path}/estimator")
    loaded = estimators.BoostedTrees.load(f"{tmp_path}/estimator")
    assert loaded.getOrDefault("rounds") == 7 and loaded.getOrDefault("depth") == 2 and loaded.getOrDefault("rate") == 0.05
    # along the paths, values sum to the score minus the base
    found = model.attributions(test, COLUMNS).groupBy("pid", "class").agg(F.sum("value").alias("total"), F.first("base").alias("base")).collect()
    own = model.boosted
    for r in found:
        assert r["total"] + r["base"] == pytest.approx(own.scores(x[[int(r["pid"][1:])]], 0)[0, r["class"]], abs=1e-9)
    top = {r["feature"] for r in boosting.mean_attributions(model.attributions(test, COLUMNS)).where("class = 1").orderBy(F.desc("mean_abs")).limit(2).collect()}
    assert top == {"x0", "x1"}


def test_attributions_are_those_of_all_subsets():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 4):
        for k in range(6):
            inner = (1 << depth) - 1
            columns, cuts = rng.integers(0, 4, inner), rng.normal(size=inner)
            values, cover = rng.normal(size=inner + 1), rng.integers(1, 20, inner + 1).astype(float)
            if k % 2 and depth > 1:  # a node that isn't cut
                cuts[1], below = np.inf, (inner + 1) // 4
                values[below : 2 * below], cover[below : 2 * below] = 0.0, 0.0
            x = rng.normal(size=(5, 4))
            found = boosting.tree_shap(columns, cuts, values, cover, x, 4)
            np.testing.assert_allclose(found, [plain_shap(columns, cuts, values, cover, row) for row in x], atol=1e-12)


def test_attributions_check_the_size_of_the_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TREES_MB", 0)
    x, y = matrix(20, 2)
    rows = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(frame(spark, x, y, "label"))
    with pytest.raises(ValueError, match="MB"):
        estimators.BoostedTrees(rounds=1, depth=1).fit(rows).attributions(rows, COLUMNS)


def test_evaluate_repeated(spark):
    x, y = matrix(90, 3, 6.0)
    data, ids = frame(spark, x, y), [f"p{k:03}" for k in range(90)]
    doc = folds.repeated_folds(ids, 5, 3)
    of = folds.folds_frame(spark, doc)
    scores = {(r["rep"], r["fold"]): r["macro_f1"] for r in models.evaluate_repeated(data, of, COLUMNS).collect()}
    assert set(scores) == {(r, f) for r in range(3) for f in range(5)} and sum(scores.values()) > 0.8 * 15
    for rep, fold, train, test in without(doc):
        assert scores[rep, fold] == pytest.approx(plain_macro_f1(y[test].tolist(), PlainLogistic().fit(x[train], y[train]).predict(x[test]).tolist()))
    chance = models.evaluate_repeated(data, of, COLUMNS, estimator="dummy").agg(F.avg("macro_f1")).first()[0]
    assert chance < 0.6
    assert sorted(map(str, models.evaluate_repeated(data, of, COLUMNS).collect())) == sorted(map(str, models.evaluate_repeated(data.repartition(7), of, COLUMNS).collect()))
    with pytest.raises(ValueError, match="estimator"):
        models.evaluate_repeated(data, of, COLUMNS, estimator="other")


class Nearest(Estimator, HasFeaturesCol, HasLabelCol):
    """An estimator of a caller's: the class whose first feature has the nearest mean."""

    def _fit(self, dataset):
        means = dataset.groupBy("label").agg(F.avg(vector_to_array("features")[0]).alias("m")).collect()
        return NearestModel(sorted((r["label"], r["m"]) for r in means))


class NearestModel(Model):
    def __init__(self, means=()):
        super().__init__()
        self.means = means

    def _transform(self, dataset):
        far = F.array(*[F.struct(F.abs(vector_to_array("features")[0] - m), F.lit(label).alias("label")) for label, m in self.means])
        return dataset.withColumn("prediction", F.array_min(far)["label"])


def test_estimators_of_a_caller(spark, tmp_path):
    x, y = matrix(60, 3, 6.0)
    data = frame(spark, x, y).withColumn("y", F.concat(F.lit("class "), F.col("y").cast("string")))
    of = folds.folds_frame(spark, folds.repeated_folds([f"p{k:03}" for k in range(60)], 3, 2))
    for estimator in (Nearest(), LogisticRegression(maxIter=20), estimators.BalancedLogistic(c=0.5), estimators.BoostedTrees(rounds=5, depth=2, rate=0.5)):
        made = models.fold_predictions(data, of, COLUMNS, estimator=estimator)
        assert made.count() == 120 and made.where("y_true = y_pred").count() > 100, estimator
        assert made.dtypes == [("rep", "int"), ("fold", "int"), ("pid", "string"), ("y_true", "string"), ("y_pred", "string")]
    features = data.select(F.col("pid").alias("user"), F.lit("d").alias("day"), F.when(F.col("y") == "class 0", "control").otherwise(F.col("y")).alias("class"), "x0", "x1")
    grid = experiment.experiment_grid(features, ["x0", "x1"], 3, estimators=(Nearest(),))
    assert grid.groupBy("track", "aggregation", "estimator").count().where("estimator = 'Nearest' and count = 60").count() == 4


def test_fitted_models_are_saved_and_score_other_tables(spark, tmp_path):
    x, y = matrix(80, 3, 2.0)
    rows = VectorAssembler(inputCols=COLUMNS, outputCol="v").transform(frame(spark, x, y))
    model = estimators.BalancedLogistic(featuresCol="v", labelCol="y", predictionCol="guess").fit(rows.where("pid < 'p050'"))
    model.write().overwrite().save(f"{tmp_path}/model")
    again = estimators.BalancedLogisticModel.load(f"{tmp_path}/model")
    test = rows.where("pid >= 'p050'").drop("y").withColumn("further", F.lit(1))
    found = {r["pid"]: r for r in again.transform(test).collect()}
    plain = PlainLogistic().fit(x[:50], y[:50])
    w, b = plain.weights
    for k in range(50, 80):
        np.testing.assert_allclose(found[f"p{k:03}"]["probability"], softmax(x[[k]] @ w.T + b)[0], atol=1e-6)
        assert found[f"p{k:03}"]["guess"] == plain.predict(x[[k]])[0] and found[f"p{k:03}"]["further"] == 1
    assert Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), estimators.BalancedLogistic(labelCol="y")]).fit(frame(spark, x, y)).transform(frame(spark, x, y)).where("y = prediction").count() > 60


def test_stratified_draws(spark):
    x, y = matrix(200, 3)
    y[:100] = 0
    data = frame(spark, x, y)
    of = folds.hashed_folds(data, 4, 2)
    placed = {}
    for r in of.collect():
        placed.setdefault((r["rep"], r["fold"]), []).append(r["pid"])
    label = {f"p{k:03}": int(c) for k, c in enumerate(y)}
    found = {(r["rep"], r["fold"], r["pid"]): (r["y_true"], r["y_pred"]) for r in models.stratified_predictions(data, of).collect()}
    for (rep, fold), test in placed.items():
        train = sorted(label[p] for p in label if p not in test)
        for p in test:
            u = int(hashlib.md5(f"0:{rep}:{p}".encode()).hexdigest()[:8], 16) / 2**32
            assert found[rep, fold, p] == (label[p], train[int(u * len(train))])


def test_importance_finds_the_column_that_matters(spark):
    x, y = matrix(150, 3, 3.0)
    data = frame(spark, x, y)
    predict = models.fit_logistic(data.where("pid < 'p100'"), COLUMNS, "y")
    for size in (10_000, 9):
        found = {r["feature"]: r["loss"] for r in models.permutation_importance(predict, data.where("pid >= 'p100'"), COLUMNS, "y", bucket_rows=size).collect()}
        assert set(found) == set(COLUMNS) and found["x0"] > 0.2 and all(abs(found[c]) < 0.15 for c in COLUMNS[1:])


def test_combined_matrix_refuses_nulls(spark):
    left = spark.createDataFrame([(1, "control", 1.0), (2, "depression", None)], "user long, class string, a double")
    right = spark.createDataFrame([(1, "x", 2.0), (2, "x", 3.0)], "user long, class string, b double")
    assert models.combined_matrix(left.where("user = 1"), right, ["a", "b"]).first()["features"].toArray().tolist() == [1.0, 2.0]
    with pytest.raises(Exception, match="null|NaN"):
        models.combined_matrix(left, right, ["a", "b"]).collect()


def test_experiment_has_all_conditions_on_the_same_folds(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{k:02}", ("control", "depression", "schizophrenia")[k % 3], float(rng.normal() + k % 3), float(rng.normal() + 2 * (k % 3))) for k in range(45)]
    data = spark.createDataFrame(rows, "pid string, class string, d double, t double")
    raw, summary, paired = experiment.run_experiment(data, folds.hashed_folds(data, 3, 4), ["d"], ["t"])
    assert raw.groupBy("task", "feature_set", "rep").count().where("count = 3").count() == 8 * 4
    of = {(r["task"], r["feature_set"]): r for r in summary.collect()}
    assert len(of) == 8 and of["3class", "combined"]["mean_f1"] > of["3class", "distributional"]["mean_f1"] > of["3class", "dummy"]["mean_f1"]
    assert all(r["n_reps"] == 4 and r["ci_lo_mean"] < r["mean_f1"] < r["ci_hi_mean"] for r in of.values())
    assert {r["label"] for r in paired.collect()} >= {"2class: combined vs dummy", "3class: temporal vs dist"}
    _, _, own = experiment.run_experiment(data, folds.hashed_folds(data, 3, 2), ["d"], ["t"], pairs=[("across tasks", "2class/combined", "3class/temporal")])
    assert [r["label"] for r in own.collect()] == ["across tasks"]


@pytest.mark.parametrize(("a", "b"), [(3, 5), (5, 3), (0, 3), (3, 0), (0, 0)])
def test_pairs_need_the_same_repetitions(spark, a, b):
    rows = [("t", "a", r, 0.5 + r / 100) for r in range(a)] + [("u", "b", r, 0.6) for r in range(b)]
    scores = spark.createDataFrame(rows, "task string, feature_set string, rep int, score double")
    with pytest.raises(ValueError, match="different repetitions.*mine"):
        metrics.paired_summary(scores, [("mine", "t/a", "u/b")])


def test_pairs_of_any_conditions(spark):
    rows = [("t", "a", r, 0.5 + r / 100) for r in range(4)] + [("u", "b", r, 0.52) for r in range(4)]
    scores = spark.createDataFrame(rows, "task string, feature_set string, rep int, score double")
    found = metrics.paired_summary(scores, [("mine", "t/a", "u/b"), ("same", "t/a", "t/a")]).orderBy("label").collect()
    assert [r["label"] for r in found] == ["mine", "same"]
    assert (found[0]["mean_diff"], found[0]["frac_positive"], found[0]["n_reps"]) == (0.005, 0.5, 4) and found[1]["sd_diff"] == 0.0
    with pytest.raises(ValueError, match="repetitions"):
        metrics.paired_summary(scores.union(scores), [("mine", "t/a", "u/b")])


def test_grid_has_tracks_aggregations_and_classifiers(spark, monkeypatch):
    monkeypatch.setitem(models.ESTIMATORS, "boosted", lambda: estimators.BoostedTrees(rounds=6, depth=2))
    rng = np.random.default_rng(6)
    rows = [(u, f"d{d}", ("control", "depression", "schizophrenia")[u % 3], float(rng.normal() + 3 * (u % 3)), float(rng.normal())) for u in range(30) for d in range(4)]
    features = spark.createDataFrame(rows, "user long, day string, class string, mean double, sd double")
    made = experiment.experiment_grid(features, ["mean", "sd"], 3)
    assert made.groupBy("track", "aggregation", "estimator").count().where("count = if(aggregation = 'per_day', 120, 30)").count() == 12
    score = {(r["track"], r["aggregation"], r["estimator"]): r for r in experiment.grid_summary(made).collect()}
    for track in ("2class", "3class"):
        assert score[track, "per_participant", "logistic"]["macro_f1"] > 0.8 > score[track, "per_participant", "dummy"]["macro_f1"]
    assert all(r["lower"] <= r["macro_f1"] <= r["upper"] for r in score.values())


def test_bootstrap_is_that_of_drawn_rows(spark):
    rng = random.Random(3)
    rows = [(k % 3, k % 3 if rng.random() < 0.7 else rng.randrange(3), k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "y_true int, y_pred int, part int")
    drawn = sorted(plain_macro_f1(*zip(*[(t, p) for t, p, _ in rng.choices(rows, k=len(rows))], strict=True)) for _ in range(1500))
    found = metrics.bootstrap_ci(df).first()
    assert found["lower"] == pytest.approx(drawn[37], abs=0.02) and found["upper"] == pytest.approx(drawn[1462], abs=0.02)
    assert metrics.bootstrap_ci(df, keys=("part",)).count() == 2
    whole = metrics.evaluate_predictions(df.select("y_true", "y_pred")).first()
    assert whole["macro_f1"] == pytest.approx(plain_macro_f1([r[0] for r in rows], [r[1] for r in rows])) and whole["lower"] == found["lower"] and whole["n"] == 120


@pytest.mark.parametrize("parts", [2, 7, 256])
def test_roc_auc_counts_every_pair(spark, parts):
    rng = random.Random(5)
    rows = [(g, rng.random() < 0.4, rng.randrange(40) / 7) for g in ("a", "b", None) for _ in range(150)] + [("c", True, 1.0), ("a", None, 2.0), ("a", True, None)]
    df = spark.createDataFrame([(g, None if y is None else int(y), s) for g, y, s in rows], "g string, y_true int, score double")
    found = {r["g"]: r["auc"] for r in metrics.roc_auc(df, ("g",), parts=parts).collect()}
    for g in ("a", "b", None):
        pos, neg = ([s for h, y, s in rows if h == g and y is flag and s is not None] for flag in (True, False))
        assert found[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert found["c"] is None
    both = df.where("g = 'a'").select("y_true", "score")
    assert metrics.roc_auc(both, parts=parts).first()["auc"] == pytest.approx(found["a"])


def test_confusion_of_one_fold(spark):
    df = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 1, 0), (0, 1, 0, 0)], "rep int, fold int, y_true int, y_pred int")
    assert {(r["y_true"], r["y_pred"]): r["share"] for r in metrics.confusion_fold(df).collect()} == {(1, 1): 0.5, (1, 0): 0.5, (0, 0): 0.0, (0, 1): 0.0}


@pytest.mark.parametrize(("df", "t"), [(1, 12.706205), (19, 2.093024), (59, 2.000995), (60, 2.000298), (100, 1.983972), (1000, 1.962339)])
def test_t_critical(spark, df, t):
    assert spark.range(1).select(metrics._t_critical(F.lit(df + 1)).alias("t")).first()["t"] == pytest.approx(t, abs=2e-6)


@pytest.mark.parametrize("parts", [2, 9, 256])
def test_exact_percentiles(spark, parts):
    rng = random.Random(9)
    rows = [(g, rng.choice([None, rng.randrange(30) / 7, rng.random()])) for g in ("a", "b", None) for _ in range(101)] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.93, "q10": 1.0}
    found = {r["g"]: r for r in summaries.exact_percentiles(df, "x", shares, ("g",), parts).collect()}
    assert set(found) == {"a", "b", None, "c"}
    for g, r in found.items():
        values = [x for h, x in rows if h == g and x is not None]
        assert r["n"] == len(values) and r["least"] == min(values) and r["most"] == max(values)
        for name, q in shares.items():
            assert r[name] == pytest.approx(np.quantile(values, q))
    assert summaries.exact_percentiles(df.where("g = 'd'"), "x", shares).first()["n"] is None


def test_pca_is_numpys(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 3)) @ np.array([[2.0, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "k long, a double, b double, c double")
    made, share = summaries.pca_projection(df, ["a", "b", "c"], ["k"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    np.testing.assert_allclose(share, (s**2 / (s**2).sum())[:2], atol=1e-9)
    rows = sorted(made.collect(), key=lambda r: r["k"])
    for n in range(2):
        got = np.array([r[f"pc{n + 1}"] for r in rows])
        assert min(np.abs(got - z @ v[n]).max(), np.abs(got + z @ v[n]).max()) < 1e-8


def test_fold_checks(spark):
    people = spark.createDataFrame([(f"p{k}",) for k in range(8)], "pid string")
    of = folds.hashed_folds(people, 2, 2)
    folds.validate_folds(of, people)
    with pytest.raises(ValueError, match="p9"):
        folds.validate_folds(of, people.union(spark.createDataFrame([("p9",)], "pid string")))
    with pytest.raises(ValueError, match="p7"):
        folds.validate_folds(of, people.where("pid <> 'p7'"))


def test_column_lists():
    have = ["user", "class", "mean", "sd", "q75", "stability", "pid", "variability"]
    assert prep.distributional_columns(have) == ["mean", "sd", "q75"] and prep.temporal_columns(have) == ["stability", "variability"]
