"""Scans over ranges of a recording: the rows of a scan over the whole, without a window over a recording."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.operators import binning, rhythm, sleep
from tidewell.plans.features import extract_features

START = datetime.datetime(2023, 12, 30, 20)


def recording(seed, n, gaps=0.0):
    """Minutes with quiet and busy stretches; some are far apart."""
    rng, at, rows, busy = random.Random(seed), START, [], False
    for _ in range(n):
        at += datetime.timedelta(minutes=1 if rng.random() >= gaps else rng.choice([0, 5, 2000, 40_000]))
        busy = busy if rng.random() < 0.93 else not busy
        rows.append((at, rng.choice([0.0, 3.0, 900.0, 2500.0]) if busy else rng.choice([0.0, 0.0, 5.0])))
    return rows


def plain_cole_kripke(a):
    padded = [0.0] * 4 + a + [0.0] * 3
    return [int(sum(w * x for w, x in zip(sleep.COLE_KRIPKE, padded[k : k + 8], strict=True)) * 1e-5 >= 1.0) for k in range(len(a))]


def plain_webster(labels):
    runs = []
    for x in labels:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    made = []
    for k, (x, size) in enumerate(runs):
        around = min(runs[k - 1][1], runs[k + 1][1]) if 0 < k < len(runs) - 1 else 0
        made += [sleep.WAKE if x == sleep.SLEEP and any(size <= most and around >= least for most, least in sleep.WEBSTER) else x] * size
    return made


@pytest.fixture(scope="module")
def recordings(spark):
    rows = {"long": recording(1, 3000), "sparse": recording(2, 400, 0.2), "tiny": recording(3, 3), "one": recording(4, 1), "busy": [(t, 2000.0) for t, _ in recording(5, 300)]}
    rows["runs"] = [(START + datetime.timedelta(minutes=k), 0.0 if k % 24 < 2 else 3000.0) for k in range(500)]
    df = spark.createDataFrame([(pid, t, a) for pid, own in rows.items() for t, a in own], "pid string, ts timestamp_ntz, activity double")
    return {pid: sorted(own) for pid, own in rows.items()}, df.repartition(5)


@pytest.mark.parametrize("size", [64, 65, 200, 8192])
def test_scores_are_those_of_the_whole_recording(recordings, size):
    plain, df = recordings
    found = {}
    for r in sleep.score_sleep(df, size=size).collect():
        found.setdefault(r["pid"], []).append((r["ts"], r["activity"], r["label"]))
    assert set(found) == set(plain)
    for pid, own in plain.items():
        labels = plain_webster(plain_cole_kripke([a for _, a in own]))
        assert sorted(found[pid]) == sorted((t, a, x) for (t, a), x in zip(own, labels, strict=True)), pid
    assert sum(map(len, found.values())) == df.count()


def test_other_scorers_too(recordings):
    _, df = recordings
    for scorer in (sleep.sadeh, sleep.cole_kripke):
        whole = sorted(map(str, scorer(df).collect()))
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(sleep._labelled, "__kwdefaults__", {"size": 70, "halo": 32})
            assert sorted(map(str, scorer(df).collect())) == whole


def test_positions_of_odd_rows(spark):
    rows = [("a", None, 1.0), ("a", START, 2.0), ("a", START, 1.0), (None, START, 5.0), (None, None, None), ("a", START + datetime.timedelta(days=400), 3.0)]
    found = sleep.in_ranges(spark.createDataFrame(rows, "pid string, ts timestamp_ntz, activity double")).where("_own")
    assert sorted(((r["pid"] or "", r["activity"] or 0.0), r["_pos"]) for r in found.collect()) == [(("", 0.0), 0), (("", 5.0), 1), (("a", 1.0), 0), (("a", 1.0), 1), (("a", 2.0), 2), (("a", 3.0), 3)]
    assert sleep.score_sleep(spark.createDataFrame([], "pid string, ts timestamp_ntz, activity double")).collect() == []


def test_a_long_recording_spreads(spark):
    day = spark.range(20_000).select(F.lit("x").alias("pid"), (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 7).cast("double").alias("activity"))
    ranges = sleep.in_ranges(day, 1000).groupBy("_range").agg(F.count("_pos").alias("count"), F.max("_own").alias("own")).where("own").collect()
    assert len(ranges) == 20 and max(r["count"] for r in ranges) == 1000 + 2 * sleep.HALO


def test_no_window_over_a_recording(spark, recordings):
    _, df = recordings
    full = binning.keep_full_days(binning.bin_activity(df))
    for made in (sleep.score_sleep(df), sleep.score_sleep(df, "sadeh"), sleep.sleep_metrics(df), rhythm.intradaily_variability(full), extract_features(df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        keys = [m[1] for m in re.finditer(r"Window \[.*\], \[([^\]]*)\], \[[^\]]*\]", plan)]
        assert keys and all("," in k for k in keys), keys


def test_variability_joins_days(spark):
    rng = random.Random(4)
    days = [0, 1, 2, 5, 6, 31, 32]
    rows = [("x", datetime.date(2020, 1, 30) + datetime.timedelta(days=d), p, rng.random()) for d in days for p in range(4)] + [("one", datetime.date(2020, 1, 1), p, float(p)) for p in range(4)]
    found = {r["pid"]: r["intradaily_variability"] for r in rhythm.intradaily_variability(spark.createDataFrame(rows, "pid string, day date, pos int, x double"), 360).collect()}
    own = {(d - datetime.date(2020, 1, 30)).days * 4 + p: x for pid, d, p, x in rows if pid == "x"}
    steps = sum((own[k] - own[k - 1]) ** 2 for k in own if k - 1 in own)
    mean = sum(own.values()) / len(own)
    assert found["x"] == pytest.approx(steps / (len(own) - 1) / (sum((v - mean) ** 2 for v in own.values()) / len(own)))
    assert found["one"] == pytest.approx(3 / 3 / 1.25)
