"""Rhythm and sleep measures of known minute series."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import binning, rhythm, sleep
from tidewell.plans.features import extract_features

START = pd.Timestamp("2020-01-01")
HOURLY = {
    "F1": ([0] * 8 + [100] * 12 + [20] * 4, 7),
    "F2": ([0, 100] * 12, 7),
    "F3": ([0, 0] + [100] * 19 + [0] * 3, 7),
    "F4": ([100] * 5 + [0] * 14 + [100] * 5, 7),
    "F5": ([50 + 30 * float(np.cos(2 * np.pi / 24 * (h - 14))) for h in range(24)], 7),
    "flat": ([10000] * 24, 7),
    "zero": ([0] * 24, 7),
    "short": ([0] * 8 + [100] * 12 + [20] * 4, 2),
}


def minutes(values, start=START):
    return pd.DataFrame({"ts": pd.date_range(start, periods=len(values), freq="min"), "activity": np.asarray(values, float)})


def frame(spark, series):
    parts = [x.assign(pid=name, label="control") for name, x in series.items()]
    rows = pd.concat(parts)[["pid", "label", "ts", "activity"]]
    return spark.createDataFrame(rows, "pid string, label string, ts timestamp_ntz, activity double")


@pytest.fixture(scope="module")
def activity(spark):
    return frame(spark, {name: minutes(np.tile(np.repeat(hours, 60), days)) for name, (hours, days) in HOURLY.items()}).cache()


@pytest.fixture(scope="module")
def full(activity):
    return binning.keep_full_days(binning.bin_activity(activity)).cache()


def by_pid(df):
    return {r["pid"]: r for r in df.collect()}


def near(x, want):
    assert x == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_interdaily_stability(full):
    found = by_pid(rhythm.interdaily_stability(full))
    for name in ("F1", "F2", "F3", "F4", "F5"):
        near(found[name]["interdaily_stability"], 1.0)
    for name in ("flat", "zero", "short"):
        assert found[name]["interdaily_stability"] is None
    near(by_pid(rhythm.interdaily_stability(full, 2))["short"]["interdaily_stability"], 1.0)


def test_intradaily_variability(full):
    found = by_pid(rhythm.intradaily_variability(full))
    for name, want in {"F1": 0.31580838323353294, "F2": 4.0, "F3": 0.5082886857863221, "F4": 0.3449101796407186, "F5": 0.06825396472848043}.items():
        near(found[name]["intradaily_variability"], want)
    assert found["flat"]["intradaily_variability"] is None


def test_variability_leaves_out_differences_over_a_missing_day(spark):
    days = binning.keep_full_days(binning.bin_activity(frame(spark, {"x": minutes(np.tile(np.repeat([0, 100] * 12, 60), 3))})))
    cut = days.where("day <> date'2020-01-02'")
    bins = [0.0, 6000.0] * 24
    steps = sum((b - a) ** 2 for a, b in zip(bins, bins[1:], strict=False)) - 6000.0**2
    want = len(bins) * steps / ((len(bins) - 1) * np.var(bins) * len(bins))
    near(by_pid(rhythm.intradaily_variability(cut))["x"]["intradaily_variability"], want)


def test_least_and_most_active_periods(full):
    low, high = by_pid(rhythm.least_active_period(full)), by_pid(rhythm.most_active_period(full))
    for name, (lv, lo, mv, mo) in {"F1": (0, 0, 6000, 8), "F2": (2400, 0, 3000, 0), "F3": (0, 21, 6000, 2), "F4": (0, 5, 6000, 19)}.items():
        near(low[name]["l_value"], lv)
        near(high[name]["m_value"], mv)
        assert (low[name]["l_onset_min"], high[name]["m_onset_min"]) == (60 * lo, 60 * mo)
    near(low["F5"]["l_value"], 1320.9951143470746)
    near(high["F5"]["m_value"], 4320.648312172074)


def test_cosinor(full):
    found = by_pid(rhythm.cosinor(full))
    for name, want in {
        "F1": (3200, 3654.20604551429, 13.84724794019034, 0.834576363942074),
        "F3": (4750, 2331.9512300735078, 11.0, 0.45793655068979733),
        "F4": (2500, 3700.1225955501423, 23.5, 0.7823375555486128),
        "F5": (3000, 1800, 14.0, 1.0),
    }.items():
        for column, value in zip(("mesor", "cosinor_amplitude", "acrophase_hours", "cosinor_r_squared"), want, strict=True):
            near(found[name][column], value)
    assert found["flat"]["mesor"] is None and found["zero"]["cosinor_r_squared"] is None


def test_sparse_series(spark):
    spike = np.zeros(7 * 1440)
    spike[100] = 1000
    noise = np.random.default_rng(42).exponential(50, 21 * 1440)
    days = binning.keep_full_days(binning.bin_activity(frame(spark, {"F7": minutes(noise), "F8": minutes(spike)})))
    found = by_pid(rhythm.interdaily_stability(days))
    near(found["F7"]["interdaily_stability"], 0.01766752835794649)
    near(found["F8"]["interdaily_stability"], 0.1377245508982036)


def test_sleep_metrics(spark):
    n, rng = 5 * 1440 + 700, np.random.default_rng(5)
    mod = (np.arange(n) + 500) % 1440
    night = rng.poisson(0.8, n) * rng.integers(0, 120, n)
    day = rng.poisson(3, n) * rng.integers(0, 200, n)
    f9 = minutes(np.where((mod > 1320) | (mod < 420), night, day), "2020-01-01 08:20")
    rows = frame(spark, {"F1": minutes(np.tile(np.repeat(HOURLY["F1"][0], 60), 10)), "F6": minutes(np.tile(np.repeat([0] * 7 + [1000] * 17, 60), 7)), "F9": f9, "short": minutes(np.zeros(2 * 1440))})
    found = by_pid(sleep.sleep_metrics(rows))
    for name, want in {
        "F6": (5.95952380952381, 6.892857142857142, 0, 0.9254658385093167, 29.142857142857142),
        "F1": (6.466666666666667, 11.916666666666666, 0, 1.0, 0),
        "F9": (1.6208333333333333, 2.2708333333333335, 253.25, 0.24872122762148335, 29.75),
    }.items():
        for column, value in zip(("tst_hours", "tst_24h_hours", "waso_min", "sleep_efficiency", "sol_min"), want, strict=True):
            near(found[name][column], value)
    assert found["short"]["tst_hours"] is None


def labelled(spark, labels):
    at = datetime.datetime(2020, 1, 1)
    return spark.createDataFrame([("x", at + datetime.timedelta(minutes=k), v) for k, v in enumerate(labels)], "pid string, ts timestamp_ntz, label int")


@pytest.mark.parametrize(
    ("labels", "rescued"),
    [([1] * 5 + [0] + [1] * 5, True), ([1] * 12 + [0, 0] + [1] * 12, True), ([1] * 5 + [0] * 10 + [1] * 5, False), ([0] + [1] * 30, False)],
)
def test_webster_rules(spark, labels, rescued):
    found = [r["label"] for r in sleep.webster_rules(labelled(spark, labels)).orderBy("ts").collect()]
    assert found == ([1] * len(labels) if rescued else labels)


@pytest.mark.parametrize("scorer", sleep.SCORERS)
def test_scorers_see_rest_and_activity(spark, scorer):
    rows = frame(spark, {"rest": minutes(np.zeros(200)), "busy": minutes(np.full(200, 5000.0))})
    found = {r["pid"]: r["wake"] for r in sleep.score_sleep(rows, scorer).groupBy("pid").agg(F.avg("label").alias("wake")).collect()}
    assert found["rest"] == 0 and found["busy"] > 0.9


def test_nulls_negatives_and_lone_observations(spark):
    rows = frame(spark, {"x": minutes([np.nan] * 1440), "y": minutes([1.0])})
    assert [r["pid"] for r in binning.bin_activity(rows).collect()] == ["y"]
    assert binning.keep_full_days(binning.bin_activity(rows)).count() == 0
    assert {r["pid"]: r["n_days"] for r in binning.count_full_days(binning.bin_activity(rows)).collect()} == {"y": 0}


def test_features_have_a_row_for_each_recording(activity):
    found = by_pid(extract_features(activity))
    assert set(found) == set(HOURLY)
    near(found["F1"]["cosinor_r_squared"], 0.834576363942074)


def test_parameters_are_checked_early(full):
    for wrong in (0, -5, 7, True, 60.0):
        with pytest.raises(ValueError):
            binning.bin_activity(full, wrong)
    with pytest.raises(ValueError):
        rhythm.least_active_period(full, 24)
    with pytest.raises(ValueError):
        rhythm.most_active_period(full, 5, 90)
    with pytest.raises(ValueError):
        sleep.score_sleep(full, "other")
