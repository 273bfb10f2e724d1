"""Sleep scores of a stream are those of the batch, in any batching."""

import datetime
import random

import numpy as np
import pytest

from tests.test_ranges import START, plain_cole_kripke, plain_webster, recording
from tidewell.operators import sleep
from tidewell.streaming import sleep as streaming

SCHEMA = "pid string, ts timestamp, activity double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, streaming.PROVIDER)
    yield spark
    spark.conf.set(PROVIDER, before)


def replay(spark, batches, at, late="2 hours", quiet="60 days"):
    """What the stream gives for lists of rows that come one after another."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{at}/in/{k:03}")
    query = None
    for k in range(len(batches)):  # a file at a time, in order
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/{{{','.join(f'{j:03}' for j in range(k + 1))}}}")
        made = streaming.stream_sleep(source, late, quiet)
        query = made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    return [tuple(r) for r in spark.read.parquet(f"{at}/out").where("pid <> 'end'").collect()]


END = ("end", START + datetime.timedelta(days=4000), 0.0)


@pytest.mark.parametrize("batches", [1, 4])
def test_replayed_labels_are_those_of_the_batch(rocks, tmp_path, batches):
    own = {"a": recording(1, 900), "b": recording(2, 150, 0.1), "c": recording(3, 5), "runs": [(START + datetime.timedelta(minutes=k), 0.0 if k % 24 < 2 else 3000.0) for k in range(400)]}
    rows = sorted(((pid, t, a) for pid, r in own.items() for t, a in r), key=lambda r: r[1])
    rng = random.Random(batches)
    near = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.randint(0, 90)))  # out of order, within the watermark
    parts = [list(p) for p in np.array_split(np.array(near, dtype=object), batches)]
    found = replay(rocks, [*[[tuple(r) for r in p] for p in parts], [END], [END]], tmp_path)
    want = sorted(tuple(r) for r in sleep.score_sleep(rocks.createDataFrame(rows, SCHEMA)).select("pid", "ts", "activity", "label").collect())
    assert sorted(found) == want


def test_a_quiet_recording_is_over_and_another_begins(rocks, tmp_path):
    first = [("a", START + datetime.timedelta(minutes=k), 900.0 * (k % 5 == 0)) for k in range(50)]
    second = [("a", START + datetime.timedelta(days=9, minutes=k), 900.0 * (k % 3 == 0)) for k in range(40)]
    found = replay(rocks, [first, [("end", START + datetime.timedelta(days=8), 0.0)], second, [END], [END]], tmp_path, quiet="2 days")
    want = []
    for part in (first, second):
        labels = plain_webster(plain_cole_kripke([a for *_, a in part]))
        want += [(*r, x) for r, x in zip(part, labels, strict=True)]
    assert sorted(found) == sorted(want)


def test_state_of_a_long_recording_is_bounded():
    class Held:
        def __init__(self):
            self.value, self.timers = None, []

        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        listTimers = lambda self: self.timers
        deleteTimer = lambda self, t: None
        registerTimer = lambda self, t: None

    scorer = streaming.SleepScorer(10**12)
    scorer.epochs = scorer.handle = held = Held()
    sizes, out = [], []
    values = np.array([a for _, a in recording(7, 5000)])
    for k in range(0, 5000, 50):
        at = np.arange(k, k + 50, dtype=np.int64) * 60_000_000
        out += [df["label"].tolist() for df in scorer._step("a", at, values[k : k + 50], int(at[-1]) // 1000 - 600_000)]
        sizes.append(len(held.value[0]))
    assert max(sizes) < 5000 and sizes[-1] <= max(sizes[:5])
    labels = [x for part in out for x in part]
    assert labels == streaming.scored(values)[: len(labels)].tolist() and len(labels) > 4900


def test_scored_is_the_plain_one_and_the_store_is_checked(spark):
    for n in (0, 1, 2, 40, 500):
        values = [a for _, a in recording(n, n)]
        assert streaming.scored(np.array(values, float)).tolist() == plain_webster(plain_cole_kripke(values))
    if spark.conf.get(PROVIDER) != streaming.PROVIDER:
        with pytest.raises(ValueError, match="providerClass"):
            streaming.stream_sleep(spark.createDataFrame([], SCHEMA))
