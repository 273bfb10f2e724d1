"""The study as two commands: fold files, and the experiment from files to result files.

    python -m tidewell.plans.study folds --settings study.yaml
    python -m tidewell.plans.study run --settings study.yaml --output results/repeated_cv
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import folds, prep
from tidewell.plans import experiment
from tidewell.plans.features import FEATURES, extract_features
from tidewell.sources import files
from tidewell.sources.settings import Settings, read_settings


def participants(spark: SparkSession, settings: Settings) -> DataFrame:
    """(user, distributional features, class) after the day filter and the exclusion."""
    parts, features = files.load_all(spark, settings["data.root"])
    _, kept = prep.preprocess(files.all_metadata(parts), features, settings["preprocessing.min_days_per_participant"], settings["preprocessing.excluded_features"])
    return prep.to_participant_level(kept)


def table(spark: SparkSession, settings: Settings) -> DataFrame:
    """(pid, class, distributional and temporal features) of the participants that have recordings."""
    temporal = extract_features(files.scan_all_recordings(spark, settings["data.actigraphy_root"])).drop("label").withColumnRenamed("pid", "user")
    own = participants(spark, settings).withColumn("user", F.col("user").cast("string"))
    return prep.join_features(own, temporal).withColumnRenamed("user", "pid")


def fold_path(settings: Settings) -> str:
    """The fold file that the settings name."""
    return f"{settings['cv.fixture_dir']}/folds_n{settings['cv.n_splits']}_r{settings['cv.n_reps']}.json"


def write_fold_file(spark: SparkSession, settings: Settings, force: bool = False) -> str:
    """Make the fold file of a study's participants, seeds 0, 1, ...; an existing file is an error unless force is given."""
    ids = [r["pid"] for r in participants(spark, settings).select(F.col("user").cast("string").alias("pid")).collect()]
    folds.write_fold_file(spark, fold_path(settings), ids, settings["cv.n_splits"], settings["cv.n_reps"], force)
    return fold_path(settings)


def run(spark: SparkSession, settings: Settings, output: str, fold_file: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw scores, summary, paired), also written as output/raw_scores.csv, summary.csv and paired.csv.

    Folds and participants must be the same people. A feature that a
    participant lacks is an error: no value is made up.
    """
    data = table(spark, settings)
    people = folds.membership_checked(files.read_folds(spark, fold_file or fold_path(settings)), data)
    distributional = [c for c in prep.DISTRIBUTIONAL if c in data.columns]
    made = experiment.run_experiment(data, people, distributional, list(FEATURES))
    for df, name in zip(made, ("raw_scores", "summary", "paired"), strict=True):
        files.write_one(df, f"{output}/{name}.csv")
    return made


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("folds", "run"))
    parser.add_argument("--settings", required=True)
    parser.add_argument("--output", default="results/repeated_cv")
    parser.add_argument("--folds", help="fold file, where it isn't the settings' own")
    parser.add_argument("--force", action="store_true", help="replace an existing fold file")
    given = parser.parse_args(args)
    spark, settings = SparkSession.builder.getOrCreate(), read_settings(given.settings)
    if given.command == "folds":
        print(write_fold_file(spark, settings, given.force))
    else:
        for df in run(spark, settings, given.output, given.folds)[1:]:
            df.show(truncate=False)


if __name__ == "__main__":
    main()
