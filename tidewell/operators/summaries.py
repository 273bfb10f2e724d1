"""Exploratory summaries; each returns the numbers that a figure would show."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.shared import written

#: Ranges of values that a percentile or an AUC is counted in, and distinct values of a range beyond which there are more.
RANGES, RANGE_VALUES = 256, 1_000_000

EDA_COLUMNS = ("mean", "sd", "pctZeros", "median", "q25", "q75")


def value_ranges(counted: DataFrame, value: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counted as written, cuts): distinct values are cut into ranges that hold about as many of them each.

    counted is written to the shared folder, so what it was made of is read
    once. There are RANGES ranges, and more where one would hold over
    RANGE_VALUES values.
    """
    counted = written(counted)
    parts = parts or max(RANGES, -(-counted.count() // RANGE_VALUES))
    quantiles = F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10 * parts))
    return counted, counted.agg(F.coalesce(quantiles, F.array().cast("array<double>")).alias("_cuts"))


def exact_percentiles(rows: DataFrame, value: str, shares: dict[str, float], keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(keys, n, least, most, mean, and a column for each share): interpolated percentiles of the values, nulls left out.

    Rows are first counted by value; distinct values are dealt into ranges
    (see value_ranges) and counted up within each, so no task holds all values
    of a group.
    """
    by = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    by, cuts = value_ranges(by, "_v", parts)
    by = by.join(F.broadcast(cuts)).withColumn("_p", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
    up_to = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    of_keys = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    part = by.groupBy(*keys, "_p").agg(F.sum("_n").alias("_s"))
    before = F.sum("_s").over(of_keys.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    part = part.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_s").over(of_keys).alias("_all"))
    same = F.col("_p") == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = by.withColumn("_to", up_to).join(part, same).withColumn("_to", F.col("_to") + F.col("_before"))
    covers = lambda at: (F.col("_to") - F.col("_n") <= at) & (at < F.col("_to"))

    def percentile(share: float):
        at = (F.col("_all") - 1) * F.lit(share)
        rest = at - F.floor(at)
        return F.sum(F.when(covers(F.floor(at)), F.col("_v") * (1 - rest)).otherwise(0.0) + F.when(covers(F.floor(at) + 1) & (rest > 0), F.col("_v") * rest).otherwise(0.0))

    return placed.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), *[percentile(q).alias(name) for name, q in shares.items()])


def class_balance(metadata: DataFrame, features: DataFrame) -> DataFrame:
    """(cohort, participants, feature_rows): distinct participants and feature rows of each cohort."""
    people = metadata.groupBy("cohort").agg(F.countDistinct("number").alias("participants"))
    rows = features.groupBy(F.col("class").alias("cohort")).agg(F.count(F.lit(1)).alias("feature_rows"))
    return people.join(rows, "cohort", "full").select("cohort", F.coalesce("participants", F.lit(0)).alias("participants"), F.coalesce("feature_rows", F.lit(0)).alias("feature_rows"))


def days_distribution(metadata: DataFrame) -> DataFrame:
    """(cohort, n, least, q25, median, q75, most) of days per participant."""
    found = exact_percentiles(metadata, "days", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ("cohort",))
    cohorts = metadata.select("cohort").distinct().join(found, "cohort", "left")
    kind = dict(metadata.dtypes)["days"]
    return cohorts.select("cohort", F.coalesce("n", F.lit(0)).alias("n"), F.col("least").cast(kind).alias("least"), "q25", "median", "q75", F.col("most").cast(kind).alias("most"))


def feature_distributions(features: DataFrame, columns: tuple[str, ...] = EDA_COLUMNS) -> DataFrame:
    """(class, feature, n, least, median, most) of each feature's values by class; nulls are left out."""
    long = features.unpivot(["class"], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
    return exact_percentiles(long, "value", {"median": 0.5}, ("class", "feature")).select("class", "feature", "n", "least", "median", "most")


def feature_correlation(features: DataFrame, columns: tuple[str, ...] = EDA_COLUMNS) -> DataFrame:
    """(a, b, r): Pearson correlation of each two columns over the rows that have both, in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = features.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    both = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs for x, y in dict.fromkeys([(a, b), (b, a)])])
    return one.select(F.inline(both))


def pca_projection(df: DataFrame, columns: list[str], keys: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Rows without nulls on the first k principal components of the standardised columns, and the explained shares.

    Standardised by the population deviation; a component's sign is arbitrary.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = rows.select(*keys, *[((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0)).alias(c) for c in columns])
    wide = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(scaled)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(wide)
    made = model.transform(wide).withColumn("_pc", vector_to_array("_pc"))
    return made.select(*keys, *[F.col("_pc")[n].alias(f"pc{n + 1}") for n in range(k)]), [float(v) for v in model.explainedVariance]


def acrophase_summary(frame: DataFrame, by: tuple[str, ...] = ("class",)) -> DataFrame:
    """(by, n, median, mean, least, most) of acrophase hours; nulls are left out."""
    found = exact_percentiles(frame, "acrophase_hours", {"median": 0.5}, by)
    return found.select(*by, "n", "median", "mean", "least", "most")


def load_summary(features: DataFrame) -> DataFrame:
    """(class, n_rows, n_users) for each class, and for all under a null class."""
    return features.rollup("class").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user").alias("n_users"))


def minute_profiles(activity: DataFrame) -> DataFrame:
    """(pid, label, minute, x): mean by minute of the day over all days, 0 for a minute without observation."""
    means = activity.groupBy("pid", "label", (F.hour("ts") * 60 + F.minute("ts")).alias("minute")).agg(F.avg("activity").alias("x"))
    people = activity.select("pid", "label").distinct()
    grid = people.select("pid", "label", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("minute"))
    return grid.join(means, ["pid", "label", "minute"], "left").select("pid", "label", "minute", F.coalesce("x", F.lit(0.0)).alias("x"))


def cohort_profile(profiles: DataFrame) -> DataFrame:
    """(label, minute, n, mean, sem): the standard error from the population deviation."""
    return profiles.groupBy("label", "minute").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.stddev_pop("x") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def circular_smooth(profile: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("label",), size: int = 21, period: int = 1440) -> DataFrame:
    """Centred moving average around the clock, of an odd number of minutes."""
    if size % 2 == 0 or not 0 < size < period:
        raise ValueError("size must be odd and less than the period")
    half = size // 2
    wrapped = F.array("minute", F.when(F.col("minute") >= period - half, F.col("minute") - period), F.when(F.col("minute") < half, F.col("minute") + period))
    rows = profile.select(*keys, F.explode(F.array_compact(wrapped)).alias("minute"), *columns)
    frame = Window.partitionBy(*keys).orderBy("minute").rowsBetween(-half, half)
    return rows.select(*keys, "minute", *[F.avg(c).over(frame).alias(c) for c in columns]).where(f"minute between 0 and {period - 1}")
