"""What the operators share: reading tables, materialising, and text in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.sources.shared import new_path

#: A word is a maximal run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bounds of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 2_000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, and a lost executor loses nothing.

    Spark may then drop the shuffles that led there, and is told so for this one write.
    """
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._tw_path = path
    return made


def discard(*frames: DataFrame) -> None:
    """Delete what materialise wrote for these frames, once all that reads them is written itself."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._tw_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words(text):
    """Array column of the words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def strings(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def by_whole_text(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches kept to BATCH_BYTES: rows of whole texts are large, and a worker holds a batch several times."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", most)
    return df


def append_columns(df: DataFrame, read: list[str], added: str | StructType, per_batch) -> DataFrame:
    """df with columns that per_batch makes from Arrow batches.

    per_batch(task state is built lazily inside) maps the ``read`` columns of a
    batch to a list of arrays, one for each column of ``added`` (a DDL string or
    a schema). Columns of df with the same names are replaced.
    """
    new = StructType.fromDDL(added) if isinstance(added, str) else added
    rest = df.select(*read, *[c for c in df.columns if c not in read]).drop(*new.names)
    if missing := [c for c in read if c not in rest.columns]:
        raise ValueError(f"columns {missing} are both read and added")
    schema = StructType(rest.schema.fields + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = per_batch(*[batch.column(k) for k in range(len(read))])
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return by_whole_text(rest).mapInArrow(run, schema)
