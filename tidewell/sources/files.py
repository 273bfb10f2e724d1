"""Files of recordings, cohort metadata, features, folds and results.

A recording is <root>/<cohort>/<id>.csv with a header and the columns timestamp
(yyyy-MM-dd HH:mm:ss) and activity; further columns are ignored. One scan reads
all recordings, each file once, and the file's path gives the id and the label.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.params import SchemaError, require_columns
from tidewell.sources.shared import move, names, new_path, read_text, remove, write_text, written

# Cohorts, file names and required columns of the file layout.
COHORTS = ("control", "depression", "schizophrenia", "adhd", "clinical")
FEATURE_COHORTS = ("control", "depression", "schizophrenia")
METADATA_FILES = {c: f"{c}info.csv" for c in COHORTS}
FEATURES_FILE = "features.csv"
METADATA_COLUMNS = {
    "control": ("number", "days", "gender", "age", "acc_time"),
    "depression": ("number", "days", "gender", "age", "madrs1", "madrs2", "afftype"),
    "schizophrenia": ("number", "days", "gender", "age", "bprs", "schtype"),
    "adhd": ("number", "days", "gender", "age", "adhd", "asrs"),
    "clinical": ("number", "days", "gender", "age", "adhd"),
}
FEATURE_COLUMNS = ("user", "mean", "sd", "pctZeros", "median", "q25", "q75", "class")
RECORDING_COLUMNS = ("timestamp", "activity")
FOLDS_SCHEMA = (
    "metadata struct<n_splits:int,n_reps:int,seeds:array<bigint>,n_participants:int,participant_ids:array<string>,generated_at:string,platform:string>,"
    "repetitions array<struct<seed:bigint,folds:array<struct<test:array<string>>>>>"
)


def _csv(spark: SparkSession, path: str, required: tuple[str, ...], name: str) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True)
    require_columns(df.columns, required, name)
    return df


def scan_cohort(spark: SparkSession, path: str, cohort: str) -> DataFrame:
    """One cohort's metadata with its name in the column cohort; columns beyond the required ones stay."""
    return _csv(spark, path, METADATA_COLUMNS[cohort], f"{cohort} metadata").withColumn("cohort", F.lit(cohort))


def scan_metadata(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Metadata by cohort."""
    return {c: scan_cohort(spark, f"{root}/{name}", c) for c, name in METADATA_FILES.items()}


def all_metadata(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of all cohorts; columns that a cohort lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())


def scan_features(spark: SparkSession, root: str) -> DataFrame:
    """The per-day feature table; raises SchemaError for a class outside the cohorts with features."""
    df = _csv(spark, f"{root}/{FEATURES_FILE}", FEATURE_COLUMNS, "features")
    if odd := sorted(str(r["class"]) for r in df.where(F.col("class").isNull() | ~F.col("class").isin(*FEATURE_COHORTS)).select("class").distinct().limit(5).collect()):
        raise SchemaError(f"features: unknown classes {odd}")
    return df


def load_all(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Metadata by cohort, and features."""
    return scan_metadata(spark, root), scan_features(spark, root)


def validate_recordings(rows: DataFrame) -> None:
    """One aggregate over rows (source, headed, timestamp, ts, value, activity): every file has a header, every time and activity parses, and no activity is negative."""
    unread = F.col("value").isNotNull() & (F.col("value") != "") & F.col("activity").isNull()
    bad = rows.groupBy("source").agg(F.count_if(~F.col("headed")).alias("lost"), F.count_if(F.col("timestamp").isNotNull() & F.col("ts").isNull()).alias("times"), F.count_if(unread).alias("values"), F.min("activity").alias("least"))
    for r in bad.where("lost > 0 or times > 0 or values > 0 or least < 0").orderBy("source").limit(1).collect():
        if r["lost"]:
            raise SchemaError(f"{r['source']}: no header with the columns {sorted(RECORDING_COLUMNS)}")
        if r["times"] or r["values"]:
            raise SchemaError(f"{r['source']}: {r['times']} times and {r['values']} activities can't be read")
        raise SchemaError(f"{r['source']}: negative activity, {r['least']} the least")


#: Rows of a file that are handed on at once.
CELL_ROWS = 100_000


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, headed, timestamp, value) of the rows of whole files; a file's own header says where its columns are."""
    for batch in batches:
        for source, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            reader = csv.reader(io.StringIO(content.as_py().decode("utf-8-sig"), newline=""))
            first = next((row for row in reader if row), [])
            names = [x.strip() for x in first]
            headed = set(RECORDING_COLUMNS) <= set(names)
            at = [names.index(c) for c in RECORDING_COLUMNS] if headed else []
            rows = (row for row in reader if row) if headed else iter([first] if first else [])
            while part := list(islice(rows, CELL_ROWS)):
                columns = [[row[k].strip() if k < len(row) else None for row in part] for k in at] or [[None] * len(part)] * len(RECORDING_COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(part), pa.string()), pa.array([headed] * len(part)), *[pa.array(c, pa.string()) for c in columns]], ["source", "headed", "timestamp", "value"])


def _recordings(found: DataFrame, label: str | None) -> DataFrame:
    """(source, headed, pid, label, timestamp, ts, value, activity) of files as Spark's reader of whole files gives them."""
    rows = found.select("path", "content").mapInArrow(_cells, "source string, headed boolean, timestamp string, value string")
    part = lambda n: F.regexp_extract("source", r"([^/]+)/([^/]+)\.csv$", n)
    ts = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return rows.select("source", "headed", part(2).alias("pid"), (F.lit(label) if label else part(1)).alias("label"), "timestamp", ts.alias("ts"), "value", F.col("value").try_cast("double").alias("activity"))


def scan_recordings(spark: SparkSession, paths: str | list[str], label: str | None = None, validate: bool = True) -> DataFrame:
    """(pid, label, ts, activity) of all recordings under the paths (globs, folders or files).

    pid is the file's name without .csv, label its folder's unless given. A
    file is read once, whole, in the task that parses it, and only its two
    columns go on; files may differ in their further columns and in the order
    of columns. A null or empty activity is null. Nothing is sorted: order
    belongs to the operators that need it. Repeated times stay.

    With ``validate`` the rows are written to the shared folder and checked
    there; a file without a header, with times or activities that can't be
    read, or with a negative activity raises SchemaError.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else paths)
    rows = _recordings(found, label)
    if validate:
        rows = written(rows)
        validate_recordings(rows)
    return rows.select("pid", "label", "ts", "activity")


def stream_recordings(spark: SparkSession, path: str, label: str | None = None, files_at_once: int = 1000) -> DataFrame:
    """(pid, label, ts, activity) as a stream that takes up the files of a folder as they come; each is read once.

    Rows that can't be read are null in ts or activity, and files without a
    header give rows of nulls: a stream checks nothing as a whole.
    """
    found = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once)
    return _recordings(found.schema("path string, modificationTime timestamp, length long, content binary").load(path), label).select("pid", "label", "ts", "activity")


def write_recordings(activity: DataFrame, root: str) -> None:
    """Write (pid, label, ts, activity) as <root>/<label>/<pid>.csv, one file a recording; a study's recordings are named by the driver."""
    spark = activity.sparkSession
    at = new_path(spark)
    rows = activity.select("label", "pid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "activity")
    rows.repartition("label", "pid").sortWithinPartitions("label", "pid", "timestamp").write.partitionBy("label", "pid").csv(at, header=True)
    files = spark.read.option("basePath", at).option("inferSchema", False).csv(at, header=True).select(F.col("_metadata.file_path").alias("f")).distinct()
    for (file,) in files.collect():
        label, pid = re.search(r"/label=([^/]*)/pid=([^/]*)/[^/]*$", file).groups()
        move(spark, unquote(file), f"{root}/{unquote(unquote(label))}/{unquote(unquote(pid))}.csv")


def scan_all_recordings(spark: SparkSession, root: str, cohorts: tuple[str, ...] = FEATURE_COHORTS) -> DataFrame:
    """Recordings of several cohorts, each a folder of root."""
    return scan_recordings(spark, [f"{root}/{c}" for c in cohorts])


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(rep, fold, pid) of a fold file: who is tested where."""
    doc = spark.read.option("multiLine", True).schema(FOLDS_SCHEMA).json(path)
    reps = doc.select(F.posexplode("repetitions").alias("rep", "r"))
    folds = reps.select("rep", F.posexplode("r.folds").alias("fold", "f"))
    return folds.select("rep", "fold", F.explode("f.test").alias("pid"))


def write_folds(spark: SparkSession, folds: dict, path: str) -> None:
    """Write a fold document (see operators.folds) to whatever store the path belongs to; it is as small as the participant list."""
    write_text(spark, path, json.dumps(folds, indent=2))
    if json.loads(read_text(spark, path))["metadata"]["n_reps"] != folds["metadata"]["n_reps"]:
        raise OSError(f"{path}: not what was written")


def write_fold_rows(folds: DataFrame, path: str) -> None:
    """Write folds (rep, fold, pid) of any number of people as a table; read_fold_rows reads it back."""
    folds.select(F.col("rep").cast("int").alias("rep"), F.col("fold").cast("int").alias("fold"), F.col("pid").cast("string").alias("pid")).write.mode("overwrite").parquet(path)


def read_fold_rows(spark: SparkSession, path: str) -> DataFrame:
    """(rep, fold, pid) as written by write_fold_rows."""
    return spark.read.schema("rep int, fold int, pid string").parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrite path with df as parquet, csv (with a header) or json."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).csv(p), "json": writer.json}[kind](path)


def write_one(df: DataFrame, path: str) -> None:
    """Write a table of results as one CSV file with a header, in place of an older one."""
    spark, at = df.sparkSession, new_path(df.sparkSession)
    df.coalesce(1).write.option("header", True).csv(at)
    remove(spark, path)
    move(spark, next(f for f in names(spark, at) if f.endswith(".csv")), path)


def write_predictions(predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    """Write predictions as CSV to path/predictions and their metrics (see evaluate_predictions) as JSON to path/metrics."""
    write_table(predictions, f"{path}/predictions", "csv")
    write_table(metrics, f"{path}/metrics", "json")
