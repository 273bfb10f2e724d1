"""The feature frame kept up to date as days of recordings come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.params import bins_per_day
from tidewell.operators import rhythm, sleep
from tidewell.operators.binning import bin_activity, keep_full_days
from tidewell.plans.features import frame_of
from tidewell.sources.shared import exists, names, read_text, remove, write_text, written

#: Recorded days of a pid whose rows are kept: scores of a day's last epochs, and its night, wait for the next day.
KEPT_DAYS = 3


class KeptFeatures:
    """Mergeable state of all recordings in a folder: one version for each batch that was taken in.

    ``add`` takes whole days of rows (pid, label, ts, activity), the days of a
    pid in order, and reads nothing older but the state: sums by (pid,
    position), one row for each whole day, one for each night, minutes asleep
    by day, and the rows of a pid's last KEPT_DAYS days. A version is written
    beside the last and then named as the current one, so a batch that is
    repeated, or breaks off, changes nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, bin_minutes: int = 60, l_hours: int = 5):
        bins_per_day(bin_minutes)
        self.spark, self.path, self.bin_minutes, self.l_hours = spark, path.rstrip("/"), bin_minutes, l_hours

    def _current(self, below: int | None = None) -> int | None:
        """The latest finished version, under a number if one is given."""
        if not exists(self.spark, f"{self.path}/done"):
            return None
        found = [int(n.rpartition("/")[2]) for n in names(self.spark, f"{self.path}/done") if n.rpartition("/")[2].isdigit()]
        return max((v for v in found if below is None or v < below), default=None)

    def _read(self, version: int | None, name: str) -> DataFrame | None:
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}/{name}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take in a batch of whole days. A batch that is finished already is left alone; an unfinished one is made anew."""
        if exists(self.spark, f"{self.path}/done/{batch}"):
            return
        before = self._current(batch)
        if batch < (self._current() or 0):
            raise ValueError(f"batch {batch} comes after a later one")
        has = "label" in rows.columns
        rows = written(rows.select("pid", (F.col("label") if has else F.lit(None).cast("string")).alias("label"), "ts", "activity"))
        roster = rows.groupBy("pid").agg(F.min("label").alias("label"))
        full = keep_full_days(bin_activity(rows, self.bin_minutes), self.bin_minutes)
        tail = self._read(before, "tail")
        near = sleep.usable(rows).select("pid", "ts", "activity")
        near = near if tail is None else near.unionByName(tail)
        near_full = keep_full_days(bin_activity(near, self.bin_minutes), self.bin_minutes)
        # of the kept days, all but the first have their neighbours: those and the new ones are scored anew
        known = near.select("pid", F.to_date("ts").alias("day")).distinct()
        first = Window.partitionBy("pid").orderBy("day")
        fresh = known if tail is None else known.join(tail.groupBy("pid").agg(F.min(F.to_date("ts")).alias("_first"), F.countDistinct(F.to_date("ts")).alias("_days")), "pid", "left").where(f"_days is null or _days < {KEPT_DAYS} or day > _first").select("pid", "day")
        labels = written(sleep.score_sleep(near).select("pid", "ts", "label"))
        windows = sleep.rest_windows(sleep.rest_onsets(near_full, self.l_hours, self.bin_minutes), self.l_hours)
        nights = sleep.night_metrics(sleep.epochs_of_nights(labels, windows))
        asleep = labels.groupBy("pid", F.to_date("ts").alias("day")).agg(F.count_if(F.col("label") == sleep.SLEEP).alias("asleep"))
        fresh = written(fresh)

        def kept(name: str, new: DataFrame) -> DataFrame:
            """The old rows of the days that aren't made anew, and the new rows of those that are."""
            old, new = self._read(before, name), new.join(fresh, ["pid", "day"], "left_semi")
            return new if old is None else old.join(fresh, ["pid", "day"], "left_anti").unionByName(new)

        old = self._read(before, "positions")
        positions = rhythm.position_sums(full) if old is None else rhythm.merged_sums(old, rhythm.position_sums(full))
        old = self._read(before, "days")
        days = rhythm.day_sums(full) if old is None else old.unionByName(rhythm.day_sums(full))
        old = self._read(before, "roster")
        roster = roster if old is None else old.unionByName(roster).groupBy("pid").agg(F.min("label").alias("label"))
        last = known.withColumn("_k", F.row_number().over(first.orderBy(F.desc("day")))).where(F.col("_k") <= KEPT_DAYS).select(F.col("pid").alias("_p"), "day")
        rest = near.join(last, (F.col("pid") == F.col("_p")) & (F.to_date("ts") == F.col("day"))).select("pid", "ts", "activity")
        for name, df in {"positions": positions, "days": days, "roster": roster, "nights": kept("nights", nights), "asleep": kept("asleep", asleep), "tail": rest}.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{batch}/{name}")
        write_text(self.spark, f"{self.path}/done/{batch}", "first" if before is None else str(before))
        if before is not None and (older := read_text(self.spark, f"{self.path}/done/{before}")) != "first":
            remove(self.spark, f"{self.path}/{older}")  # two versions stay: readers of the last one may still run

    def add_stream(self, days: DataFrame, checkpoint: str):
        """A writer that takes in every micro-batch of a stream of whole days; start() runs it."""
        return days.writeStream.foreachBatch(lambda df, batch: self.add(df, batch)).option("checkpointLocation", checkpoint)

    def features(self, m_hours: int = 10, is_days: int = 7, sleep_days: int = 3) -> DataFrame:
        """The 17 features of what has been taken in, as extract_features gives them for all rows at once."""
        if (version := self._current()) is None:
            raise ValueError(f"{self.path} holds no recordings yet")
        read = lambda name: self._read(version, name)
        whole = read("positions").groupBy("pid").agg(F.max("n").cast("double").alias("n_days"))
        asleep = read("asleep").groupBy("pid").agg(F.sum("asleep").alias("asleep"))
        profile = rhythm.measures_of(read("positions"), self.bin_minutes, self.l_hours, m_hours, is_days)
        return frame_of(read("roster"), profile, rhythm.variability_of(read("days"), self.bin_minutes), sleep.sleep_means(asleep, whole, read("nights"), sleep_days))

