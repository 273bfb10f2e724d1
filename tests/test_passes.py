"""How often tables are read, over how many tasks, and what comes to the driver."""

import numpy as np
import pytest

from tidewell.operators import boosting, fits, folds
from tidewell.plans import experiment

COLUMNS = ["a", "b", "c"]


def rows(spark, n, parts=1):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3)).round(3)
    y = np.where(x[:, 0] + rng.normal(size=n) > 0.5, "depression", np.where(x[:, 1] > 0.7, "schizophrenia", "control"))
    return spark.createDataFrame([(str(i), *map(float, x[i]), str(y[i])) for i in range(n)], "pid string, a double, b double, c double, class string").coalesce(1).repartition(parts)


@pytest.mark.parametrize("whole", [0, 16])
def test_rows_descend_to_the_nodes_of_their_cuts(monkeypatch, whole):
    monkeypatch.setattr(boosting, "WHOLE", whole)
    rng = np.random.default_rng(5)
    columns, bins, at = rng.integers(0, 4, (6, 15)), rng.integers(0, 9, (6, 15)).astype(np.uint8), rng.integers(0, 9, (4, 50)).astype(np.uint8)
    bins[2, 1] = 255
    for levels in range(5):
        found = boosting.descend(columns, bins, at, levels)
        for t in range(6):
            for r in range(50):
                node = 0
                for _ in range(levels):
                    node = 2 * node + 1 + (at[columns[t, node], r] > bins[t, node])
                assert found[t, r] == node - ((1 << levels) - 1)


def test_only_cuts_of_nodes_come_to_the_driver(spark, monkeypatch):
    table = fits.Table(rows(spark, 900, 3), COLUMNS, "class")
    cuts = boosting.column_cuts(table, 8)
    assert table.parts == 3
    sent, summed = [], fits.Table.summed

    def seen(self, *a, **k):
        made = summed(self, *a, **k)
        sent.append(sum(np.size(v) for v in made.values()))
        return made

    monkeypatch.setattr(fits.Table, "summed", seen)
    made = boosting.fit_boosted(table, cuts, rounds=2, depth=2)
    assert sum(sent) == 3  # which classes there are; histograms stay with the tasks
    assert np.isfinite(made.cuts).any()


@pytest.mark.parametrize("few", [8, 0])
def test_trees_are_the_same_wherever_sums_are_added(spark, monkeypatch, few):
    table = fits.Table(rows(spark, 900, 3), COLUMNS, "class")
    cuts = boosting.column_cuts(table, 8)
    alone = boosting.fit_boosted(table, cuts, rounds=5, depth=3, rate=0.3, kept_rounds=2)
    monkeypatch.setattr(boosting, "WORK", 1)
    monkeypatch.setattr(fits, "FEW", few)
    spread = boosting.fit_boosted(table, cuts, rounds=5, depth=3, rate=0.3, kept_rounds=2)
    assert np.isfinite(alone.cuts).any()
    for name in ("columns", "cuts", "cover"):
        assert np.array_equal(getattr(alone, name), getattr(spread, name))
    assert np.allclose(alone.values, spread.values, atol=1e-12)


def test_cut_points_do_not_hang_on_how_blocks_are_dealt(spark, monkeypatch):
    table = fits.Table(rows(spark, 9000), COLUMNS, "class")
    before = boosting.column_cuts(table, 32, 20)
    monkeypatch.setattr(fits, "WORK", 1)
    assert table.parts == 1 and table.spread(1) == 4
    for a, b in zip(before, boosting.column_cuts(table, 32, 20), strict=True):
        assert np.array_equal(a, b)


def test_a_level_of_few_tasks_is_one_stage(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WORK", 1, raising=False)
    table = fits.Table(rows(spark, 900, 3), COLUMNS, "class")
    cuts = boosting.column_cuts(table, 8)
    spark.sparkContext.setJobGroup("levels", "levels")
    boosting.fit_boosted(table, cuts, rounds=4, depth=3)
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("levels")]
    assert 12 <= sum(stages) <= 12 + 2  # beside the levels: the classes that there are, and the bins


def test_blocks_are_dealt_to_more_tasks_when_passes_are_heavy(spark, monkeypatch):
    table = fits.Table(rows(spark, 5000), COLUMNS, "class")
    assert table.parts == 1
    alone = fits.fit_logistic(table)
    monkeypatch.setattr(fits, "WORK", 2000)
    spread = fits.fit_logistic(table)
    assert table.parts == 3
    assert np.allclose(alone.weights, spread.weights, atol=1e-6)
    table.discard()


def test_an_experiment_reads_its_data_once(spark):
    from pyspark.sql import functions as F

    count = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(pid):
        count.add(1)
        return True

    data = rows(spark, 150)
    raw, _, _ = experiment.run_experiment(data.where(counted("pid")), folds.hashed_folds(data, 3, 1), ["a", "b"], ["c"])
    assert raw.count() == 24
    assert count.value == 150


def test_ties_of_the_matrix_do_not_hang_on_the_order_of_addition(spark, monkeypatch):
    from tidewell.plans import queries

    tie = 58.0768125
    made = spark.createDataFrame([(k, "control", tie + k * 1e-14, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0) for k in range(-3, 4)], "user long, class string, mean double, sd double, pctZeros double, median double, q75 double, variability double, stability double")
    monkeypatch.setattr(queries, "study", lambda spark, sf: made)
    assert {r["features"][0] for r in queries._matrix(spark, "").collect()} == {58.076813}
