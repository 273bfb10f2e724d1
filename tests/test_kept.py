"""Features that are kept up to date are those of all rows at once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewell.plans.features import FEATURES, extract_features
from tidewell.plans.kept import KeptFeatures

SCHEMA = "pid string, label string, ts timestamp_ntz, activity double"
START = datetime.datetime(2024, 3, 1)


def day_rows(pid, day, rng, every=4):
    """A day of every fourth minute, quiet by night, with a null and some zeros."""
    for m in range(0, 1440, every):
        h = m / 60
        busy = 7 + day % 2 <= h < 22 and rng.random() < 0.9
        yield (pid, "control", START + datetime.timedelta(days=day, minutes=m), rng.choice([0.0, 40.0, 900.0, 2500.0]) if busy else rng.choice([0.0, 0.0, 0.0, 30.0, None]))


@pytest.fixture(scope="module")
def days():
    """Rows by day: one pid with all days, one with a gap, one that starts late, one with parts of days only."""
    rng, made = random.Random(3), []
    for day in range(9):
        rows = [*day_rows("all", day, rng)]
        if day not in (3, 4):
            rows += day_rows("gap", day, rng)
        if day >= 6:
            rows += day_rows("late", day, rng)
        rows += [r for r in day_rows("part", day, rng) if r[2].hour < 12]
        made.append(rows)
    return made


def same(found, want):
    found, want = ({r["pid"]: r.asDict() for r in df.collect()} for df in (found, want))
    assert set(found) == set(want)
    for pid, row in want.items():
        assert found[pid]["label"] == row["label"]
        for c in FEATURES:
            assert (found[pid][c] is None) == (row[c] is None) and (row[c] is None or found[pid][c] == pytest.approx(row[c], abs=1e-9, rel=1e-9)), (pid, c)


def test_days_added_one_by_one(spark, days, tmp_path):
    kept = KeptFeatures(spark, f"{tmp_path}/kept")
    with pytest.raises(ValueError, match="no recordings"):
        kept.features()
    for batch, part in enumerate((days[:2], *[[d] for d in days[2:]])):
        kept.add(spark.createDataFrame([r for d in part for r in d], SCHEMA), batch)
        if batch in (0, 3):
            same(kept.features(), extract_features(spark.createDataFrame([r for d in days[: batch + 2] for r in d], SCHEMA)))
    whole = extract_features(spark.createDataFrame([r for d in days for r in d], SCHEMA))
    same(kept.features(), whole)
    # a repeated batch changes nothing, and an earlier one is refused
    kept.add(spark.createDataFrame(days[8], SCHEMA), 7)
    same(kept.features(), whole)
    tail = spark.read.parquet(f"{tmp_path}/kept/7/tail")
    assert tail.where("pid = 'all'").select(F.to_date("ts")).distinct().count() == 3
    read = {p.name for p in (tmp_path / "kept").iterdir()}
    assert read == {"6", "7", "done"}


def test_a_stream_of_days(spark, days, tmp_path):
    for k, rows in enumerate(days[:4]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    kept = KeptFeatures(spark, f"{tmp_path}/kept")
    for k in range(4):
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{{{','.join(map(str, range(k + 1)))}}}")
        query = kept.add_stream(source, f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(300) and query.exception() is None
    same(kept.features(), extract_features(spark.createDataFrame([r for d in days[:4] for r in d], SCHEMA)))
