"""Files of recordings, metadata, folds, configuration and the streaming bins."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.params import SchemaError
from tidewell.operators import binning, folds, metrics, prep
from tidewell.plans import study
from tidewell.sources import files
from tidewell.sources.settings import SettingsError, read_settings
from tidewell.streaming.bins import stream_bins, stream_full_days

META = {
    "control": "number,days,gender,age,acc_time\n1,9,1,30,2.5\n2,5,2,40,\n",
    "depression": "number,days,gender,age,madrs1,madrs2,afftype\n3,12,1,30,20,18,1\n",
    "schizophrenia": "number,days,gender,age,bprs,schtype\n4,13,2,50,40,1\n",
    "adhd": "number,days,gender,age,adhd,asrs\n5,7,1,20,1,50\n",
    "clinical": "number,days,gender,age,adhd\n6,,1,20,0\n",
}


@pytest.fixture
def root(tmp_path):
    for cohort, text in META.items():
        (tmp_path / f"{cohort}info.csv").write_text(text)
    (tmp_path / "features.csv").write_text("user,mean,sd,pctZeros,median,q25,q75,class\n1,1,2,.1,3,0,4,control\n1,3,2,.1,3,0,4,control\n2,1,1,.1,1,0,1,control\n3,1,1,.1,1,0,1,depression\n5,1,1,.1,1,0,1,control\n")
    for cohort, name, text in (("control", "control_1", "timestamp,date,activity\n2020-01-01 12:03:00,2020-01-01,10\n2020-01-01 12:01:00,2020-01-01,30\n"), ("depression", "d 2", "timestamp,activity\n2020-01-01 00:00:00,5\n2020-01-01 00:00:00,7\n")):
        (tmp_path / "raw" / cohort).mkdir(parents=True)
        (tmp_path / "raw" / cohort / f"{name}.csv").write_text(text)
    return tmp_path


def test_metadata_and_features(spark, root):
    parts, features = files.load_all(spark, str(root))
    meta = files.all_metadata(parts)
    assert meta.count() == 6 and meta.where("cohort = 'depression'").first()["madrs1"] == 20
    assert {r["number"] for r in prep.min_days_filter(meta, 7).collect()} == {1, 3, 4, 5}
    kept, cut = prep.preprocess(meta, features)
    assert "q25" not in cut.columns and {r["user"] for r in cut.collect()} == {1, 3}
    level = {r["user"]: r for r in prep.to_participant_level(cut).collect()}
    assert level[1]["mean"] == 2.0 and level[3]["class"] == "depression"


def test_missing_columns_and_unknown_classes(spark, root):
    (root / "adhdinfo.csv").write_text("number,days\n1,2\n")
    with pytest.raises(SchemaError, match="adhd"):
        files.scan_metadata(spark, str(root))
    (root / "features.csv").write_text("user,mean,sd,pctZeros,median,q25,q75,class\n1,1,2,.1,3,0,4,other\n")
    with pytest.raises(SchemaError, match="other"):
        files.scan_features(spark, str(root))


def test_recordings(spark, root):
    rows = files.scan_all_recordings(spark, f"{root}/raw", ("control", "depression"))
    found = sorted((r["pid"], r["label"], r["ts"].isoformat(), r["activity"]) for r in rows.collect())
    assert found[0] == ("control_1", "control", "2020-01-01T12:01:00", 30.0)
    assert [r[0] for r in found] == ["control_1", "control_1", "d 2", "d 2"]  # repeated times stay
    assert files.scan_recordings(spark, f"{root}/raw/control", "mine").first()["label"] == "mine"


def test_each_recording_is_read_by_its_own_header(spark, root):
    (root / "raw/control/other.csv").write_text('"activity","timestamp"\n"8","2020-01-01 00:00:00"\n,2020-01-01 00:01:00\n')
    found = {(r["pid"], r["activity"]) for r in files.scan_recordings(spark, f"{root}/raw").collect()}
    assert found == {("control_1", 10.0), ("control_1", 30.0), ("d 2", 5.0), ("d 2", 7.0), ("other", 8.0), ("other", None)}
    (root / "raw/control/bare.csv").write_text("time,activity\n2020-01-01 00:00:00,1\n")
    with pytest.raises(SchemaError, match="bare"):
        files.scan_recordings(spark, f"{root}/raw")


def test_each_file_is_read_once(spark, root):
    rows = files.scan_recordings(spark, f"{root}/raw")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "binaryFile" not in plan  # the checked rows, as written
    lazy = files.scan_recordings(spark, f"{root}/raw", validate=False)._jdf.queryExecution().optimizedPlan().toString()
    assert lazy.count("Relation") == 1


def test_a_stream_takes_up_new_files(spark, root, tmp_path):
    def run():
        made = files.stream_recordings(spark, f"{root}/raw").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert made.awaitTermination(120)
        return sorted((r["pid"], r["label"], r["ts"].isoformat(), r["activity"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = run()
    assert len(first) == 4 and first[0] == ("control_1", "control", "2020-01-01T12:01:00", 30.0)
    (root / "raw/depression/late+1 50%.csv").write_text("\ufeffactivity,timestamp\n 4 ,2021-01-01 00:00:00\n\n,2021-01-01 00:01:00\n")
    again = run()
    assert set(again) - set(first) == {("late+1 50%", "depression", "2021-01-01T00:00:00", 4.0), ("late+1 50%", "depression", "2021-01-01T00:01:00", None)} and len(again) == 6


@pytest.mark.parametrize("row", ["2020-01-01 00:00:00,-5", "yesterday,5", "2020-01-01 00:00:00,many"])
def test_bad_recordings(spark, root, row):
    (root / "raw/control/bad.csv").write_text(f"timestamp,activity\n{row}\n")
    with pytest.raises(SchemaError, match="bad"):
        files.scan_recordings(spark, f"{root}/raw/control")


def test_folds(spark, tmp_path):
    ids = [f"p{k:02}" for k in range(10)]
    made = folds.repeated_folds(ids, 5, 3)
    assert made == folds.repeated_folds(ids[::-1], 5, 3) | {"metadata": made["metadata"]}
    files.write_folds(spark, made, f"{tmp_path}/deep/folds.json")
    rows = files.read_folds(spark, f"{tmp_path}/deep/folds.json")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, folds.folds_frame(spark, made).collect()))
    assert folds.fold_invariants(rows, 3).count() == 0
    for wrong in ((ids[:3], 5, 3), (ids + ids[:1], 5, 3)):
        with pytest.raises(ValueError):
            folds.repeated_folds(*wrong)
    with pytest.raises(ValueError):
        folds.repeated_folds(ids, 5, 3, [1])


CONFIG = """
data:
  root: "data/raw"
preprocessing:
  min_days_per_participant: 7
  excluded_features: ["q25"]
split: {seed: 42, n_folds: 5}
output: {results_dir: results, eda_dir: results/eda, further: 1}
cv:
  n_reps: 3
"""


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text(CONFIG)
    found = read_settings(f"{tmp_path}/a.yaml")
    assert found.section("preprocessing") == {"min_days_per_participant": 7, "excluded_features": ("q25",)} and found["split.seed"] == 42
    assert found["data.actigraphy_root"] == "data/raw/actigraphy" and found.section("cv") == {"n_splits": 5, "n_reps": 3, "fixture_dir": "config/folds_repeated"}
    assert "output.further" not in found and len(found) == 11
    good = {"data": {"root": "x"}, "preprocessing": {"min_days_per_participant": 3, "excluded_features": []}, "split": {"seed": 1, "n_folds": 2}, "output": {"results_dir": "r", "eda_dir": "e"}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert read_settings(f"{tmp_path}/a.json")["cv.n_reps"] == 20
    for bad, missing in (({k: v for k, v in good.items() if k != "split"}, "split, split.seed, split.n_folds"), (good | {"split": {"seed": 1}}, "split.n_folds"), ({}, "data")):
        (tmp_path / "b.json").write_text(json.dumps(bad))
        with pytest.raises(SettingsError, match=missing):
            read_settings(f"{tmp_path}/b.json")
    with pytest.raises(FileNotFoundError):
        read_settings(f"{tmp_path}/none.json")


def test_study_from_files_to_result_files(spark, tmp_path):
    rng = random.Random(1)
    people = [(f"{cohort}_{k}", cohort) for cohort in files.FEATURE_COHORTS for k in range(5)]
    for cohort, name in files.METADATA_FILES.items():
        columns = files.METADATA_COLUMNS[cohort]
        own = [pid for pid, c in people if c == cohort] or [f"{cohort}_0"]
        (tmp_path / name).write_text(",".join(columns) + "\n" + "".join(",".join([pid, "9"] + ["1"] * (len(columns) - 2)) + "\n" for pid in own))
    rows = [f"{pid},{rng.random()},{rng.random()},0.1,{rng.random()},0,4,{c}" for pid, c in people for _ in range(3)]
    (tmp_path / "features.csv").write_text("\n".join(["user,mean,sd,pctZeros,median,q25,q75,class", *rows]) + "\n")
    start = datetime.datetime(2024, 1, 1)
    for k, (pid, cohort) in enumerate(people):
        (tmp_path / "raw" / cohort).mkdir(parents=True, exist_ok=True)
        lines = [f"{start + datetime.timedelta(minutes=10 * m)},{rng.randint(0, 900) if 7 + k % 3 <= m // 6 % 24 < 22 else rng.choice([0, 0, 20])}" for m in range(8 * 144)]
        (tmp_path / "raw" / cohort / f"{pid}.csv").write_text("timestamp,activity\n" + "\n".join(lines) + "\n")
    (tmp_path / "study.yaml").write_text(f"data: {{root: {tmp_path}, actigraphy_root: {tmp_path}/raw}}\npreprocessing: {{min_days_per_participant: 7, excluded_features: [q25]}}\nsplit: {{seed: 1, n_folds: 3}}\noutput: {{results_dir: r, eda_dir: e}}\ncv: {{n_splits: 3, n_reps: 2, fixture_dir: {tmp_path}/folds}}\n")
    study.main(["folds", "--settings", f"{tmp_path}/study.yaml"])
    assert json.loads((tmp_path / "folds/folds_n3_r2.json").read_text())["metadata"]["participant_ids"] == sorted(pid for pid, _ in people)
    with pytest.raises(FileExistsError):
        study.main(["folds", "--settings", f"{tmp_path}/study.yaml"])
    study.main(["run", "--settings", f"{tmp_path}/study.yaml", "--output", f"{tmp_path}/out"])
    found = {name: (tmp_path / "out" / f"{name}.csv").read_text().splitlines() for name in ("raw_scores", "summary", "paired")}
    assert [len(v) for v in found.values()] == [1 + 8 * 2 * 3, 1 + 8, 1 + 5]
    assert found["summary"][0] == "task,feature_set,n_reps,mean_f1,sd_f1,ci_lo_mean,ci_hi_mean" and found["paired"][0].startswith("label,n_reps,mean_diff")
    doc = json.loads((tmp_path / "folds/folds_n3_r2.json").read_text())
    doc["repetitions"][0]["folds"][0]["test"][0] = "nobody"
    (tmp_path / "odd.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="nobody"):
        study.run(spark, read_settings(f"{tmp_path}/study.yaml"), f"{tmp_path}/out", f"{tmp_path}/odd.json")


def test_quoted_cells_and_recordings_written_back(spark, root, tmp_path):
    (root / "raw/control/quoted.csv").write_text('note,timestamp,activity\n"a, b",2020-01-01 00:00:00,8\n"two\nlines",2020-01-01 00:01:00,9\n')
    rows = files.scan_recordings(spark, f"{root}/raw/control")
    assert {(r["pid"], r["activity"]) for r in rows.collect()} >= {("quoted", 8.0), ("quoted", 9.0)}
    all_rows = files.scan_recordings(spark, f"{root}/raw")
    files.write_recordings(all_rows, f"{tmp_path}/copy")
    again = files.scan_recordings(spark, f"{tmp_path}/copy")
    assert sorted(map(str, again.collect())) == sorted(map(str, all_rows.collect()))


def test_predictions_with_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, 0.9), (2, 1, 0, 0.6), (3, 1, 1, 0.2)], "user long, y_true int, y_pred int, proba_0 double")
    files.write_predictions(rows, metrics.evaluate_predictions(rows.select("y_true", "y_pred")), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out/predictions", header=True, inferSchema=True).count() == 3
    assert spark.read.json(f"{tmp_path}/out/metrics").first()["macro_f1"] == pytest.approx(2 / 3)


def test_fold_file_is_kept_unless_forced(spark, tmp_path):
    at = f"{tmp_path}/folds.json"
    ids = [f"p{k:02}" for k in range(10)]
    made = folds.write_fold_file(spark, at, ids, 5, 2)
    assert json.loads(open(at).read()) == made and made["metadata"]["n_participants"] == 10
    with pytest.raises(FileExistsError):
        folds.write_fold_file(spark, at, ids[:6], 3, 1)
    assert folds.write_fold_file(spark, at, ids[:6], 3, 1, force=True)["metadata"]["n_splits"] == 3


def test_group_folds_are_balanced():
    sizes = {"a": 9, "b": 5, "c": 4, "d": 3, "e": 3}
    found = folds.group_kfold(sizes, 3)
    load = [sum(n for g, n in sizes.items() if found[g] == k) for k in range(3)]
    assert found["a"] == 0 and sorted(load) == [7, 8, 9]
    with pytest.raises(ValueError):
        folds.group_kfold({"a": 1}, 2)


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_tables_are_overwritten(spark, tmp_path, kind):
    for n in (3, 2):
        files.write_table(spark.range(n), f"{tmp_path}/t", kind)
    reader = spark.read.option("header", True).schema("id long")
    assert getattr(reader, kind)(f"{tmp_path}/t").count() == 2


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 0)] * 3 + [(0, 1), (1, 1), (2, 1)], "y_true int, y_pred int")
    assert metrics.macro_f1(rows).first()["macro_f1"] == pytest.approx(0.4523809523809524)
    perfect = spark.createDataFrame([(k % 3, k % 3) for k in range(30)], "y_true int, y_pred int")
    assert metrics.macro_f1(perfect).first()["macro_f1"] == 1.0


def test_streamed_bins_are_those_of_the_batch(spark, tmp_path):
    rows = spark.range(3 * 1440).select(F.lit("x").alias("pid"), (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("ts"), (F.col("id") % 7).cast("double").alias("activity"))
    end = spark.createDataFrame([("x", "2020-01-10 00:00:00", 0.0)], "pid string, ts string, activity double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    end.coalesce(1).write.parquet(f"{tmp_path}/in/2")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for name, made in (("bins", stream_bins(source)), ("days", stream_full_days(source))):
        query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    batch = binning.bin_activity(rows)
    assert sorted(map(str, spark.table("bins").collect())) == sorted(map(str, batch.select("pid", "day", "pos", "x").collect()))
    assert spark.table("days").count() == 3
