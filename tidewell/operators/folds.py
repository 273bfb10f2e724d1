"""Fold assignments: who is tested in which fold of which repetition."""

from __future__ import annotations

import datetime
import platform

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets that a hash's range is cut into for ranks; folds of all repetitions; sizes that groups have.
BUCKETS, MAX_FOLDS, MAX_SIZES = 4096, 10_000, 1_000_000


def repeated_folds(ids: list[str], n_splits: int = 5, n_reps: int = 20, seeds: list[int] | None = None) -> dict:
    """A fold document: every id is tested once in each repetition.

    Ids are sorted, shuffled by each repetition's seed and cut into n_splits
    consecutive parts, the first of which take the remainder. The list of
    participants of a study fits the driver.
    """
    seeds = list(range(n_reps)) if seeds is None else list(seeds)
    if len(seeds) != n_reps:
        raise ValueError(f"{n_reps} repetitions need as many seeds, not {len(seeds)}")
    if len(set(ids)) != len(ids):
        raise ValueError("repeated ids")
    if len(ids) < n_splits:
        raise ValueError(f"{n_splits} folds need as many ids, not {len(ids)}")
    ordered = sorted(ids)
    reps = []
    for seed in seeds:
        places = np.arange(len(ordered))
        np.random.RandomState(seed).shuffle(places)
        reps.append({"seed": seed, "folds": [{"test": sorted(ordered[k] for k in part)} for part in np.array_split(places, n_splits)]})
    meta = {"n_splits": n_splits, "n_reps": n_reps, "seeds": seeds, "n_participants": len(ordered), "participant_ids": ordered, "generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "platform": platform.platform()}
    return {"metadata": meta, "repetitions": reps}


def folds_frame(spark: SparkSession, folds: dict) -> DataFrame:
    """(rep, fold, pid) of a fold document."""
    rows = [(r, f, pid) for r, rep in enumerate(folds["repetitions"]) for f, fold in enumerate(rep["folds"]) for pid in fold["test"]]
    return spark.createDataFrame(rows, "rep int, fold int, pid string")


def hashed_folds(people: DataFrame, n_splits: int = 5, n_reps: int = 20) -> DataFrame:
    """(rep, fold, pid) for any number of people, without the driver.

    A repetition orders people by a hash of id and repetition; folds are made
    by the hash alone, so sizes are equal only in expectation.
    """
    reps = people.select(F.col("pid").cast("string").alias("pid")).distinct().select("pid", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1))).alias("rep"))
    fold = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), "pid")), 1, 8), 16, 10).cast("long") % n_splits
    return reps.select("rep", fold.cast("int").alias("fold"), "pid")


def _ranked(rows: DataFrame, keys: list[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with _rank, from 0 within the keys, by the hash in the column ``order`` (32 hex digits), then pid.

    Rows are counted in buckets of the hash's first digits, whose counts are
    summed up; within a bucket they are ranked by a window. A bucket has one in
    ``buckets`` of a key's rows.
    """
    bucket = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order, "pid")) - 1
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    made = rows.withColumn("_place", place).join(starts, same)
    return made.select(*[c for c in rows.columns if c != "_bucket"], (F.col("_start") + F.col("_place")).alias("_rank"))


def ranked_folds(people: DataFrame, n_splits: int = 5, n_reps: int = 20) -> DataFrame:
    """(rep, fold, pid) for any number of people, with folds that are equal within one in every repetition.

    A repetition orders people by a hash of itself and the id, and folds are
    consecutive parts of that order, the first of which take the remainder.
    Ranks are counted by Spark; ids that occur several times are tested once.
    Fewer people than folds are an error when a row is read.
    """
    ids = people.select(F.col("pid").cast("string").alias("pid")).where("pid is not null").distinct()
    rows = ids.select("pid", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1))).alias("rep"))
    rows = _ranked(rows.withColumn("_h", F.md5(F.concat_ws(":", F.col("rep").cast("string"), "pid"))), ["rep"], "_h")
    n = ids.agg(F.count(F.lit(1)).alias("_all"))
    size, more = F.floor(F.col("_all") / n_splits), F.col("_all") % n_splits
    head = more * (size + 1)
    fold = F.when(F.col("_rank") < head, F.floor(F.col("_rank") / (size + 1))).otherwise(more + F.floor((F.col("_rank") - head) / F.greatest(size, F.lit(1))))
    checked = F.when(F.col("_all") >= n_splits, fold).otherwise(F.raise_error(F.lit(f"{n_splits} folds need as many ids")).cast("bigint"))
    return rows.join(F.broadcast(n)).select("rep", checked.cast("int").alias("fold"), "pid")


def fold_invariants(folds: DataFrame, n_reps: int) -> DataFrame:
    """(pid, n): ids that aren't tested exactly once in each repetition; empty if all is well."""
    return folds.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rep").alias("reps")).where((F.col("n") != n_reps) | (F.col("reps") != n_reps)).select("pid", "n")


def compare_folds(folds: DataFrame, people: DataFrame) -> DataFrame:
    """(pid, side): ids only in the folds ('extra') or only among the people ('missing')."""
    a, b = folds.select("pid").distinct(), people.select(F.col("pid").cast("string").alias("pid")).distinct()
    return a.join(b, "pid", "left_anti").withColumn("side", F.lit("extra")).union(b.join(a, "pid", "left_anti").withColumn("side", F.lit("missing")))


def validate_folds(folds: DataFrame, people: DataFrame) -> None:
    """Raise ValueError, naming up to five ids of each side, unless folds and people have the same ids."""
    odd = compare_folds(folds, people)
    found = {side: [r["pid"] for r in odd.where(F.col("side") == side).orderBy("pid").limit(5).collect()] for side in ("extra", "missing")}
    if found["extra"] or found["missing"]:
        raise ValueError(f"folds and data differ: {found}")


def fold_membership(folds: DataFrame, people: DataFrame) -> DataFrame:
    """(rep, fold, pid, is_test) of every person in every fold; those not tested are trained on.

    A person's folds are gathered (one a repetition), and its rows made from
    the list of all folds, of which there may be MAX_FOLDS. Models don't need
    these rows: fits.Table keeps each row's test folds instead.
    """
    grid = sorted((r["rep"], r["fold"]) for r in folds.select("rep", "fold").distinct().limit(MAX_FOLDS + 1).collect())
    if len(grid) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    everyone = people.select(F.col("pid").cast("string").alias("pid")).distinct()
    tested = folds.groupBy(F.col("pid").alias("_p")).agg(F.collect_set(F.struct("rep", "fold")).alias("tested"))
    every = F.array(*[F.struct(F.lit(rep).cast(dict(folds.dtypes)["rep"]).alias("rep"), F.lit(fold).cast(dict(folds.dtypes)["fold"]).alias("fold")) for rep, fold in grid]) if grid else F.array().cast("array<struct<rep:int,fold:int>>")
    rows = everyone.join(tested, F.col("pid") == F.col("_p"), "left").select("pid", "tested", F.explode(every).alias("f"))
    return rows.select("f.rep", "f.fold", "pid", F.coalesce(F.array_contains("tested", F.col("f")), F.lit(False)).alias("is_test"))


def group_kfold(sizes: dict[str, int], n_folds: int) -> dict[str, int]:
    """Fold of each group: the largest group left goes to the lightest fold."""
    if len(sizes) < n_folds:
        raise ValueError(f"{n_folds} folds need as many groups, not {len(sizes)}")
    load, fold = [0] * n_folds, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = min(range(n_folds), key=lambda f: (load[f], f))
        fold[name], load[k] = k, load[k] + n
    return fold


def _turns(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """(first, folds): from the group numbered ``first`` on, groups of one size are dealt to these folds in turn; loads are brought up to date.

    Each group goes to the lightest fold. The lightest is filled up to the
    second, then both in turn up to the third, and so on: as many stretches as
    folds at most, however many groups.
    """
    order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    made, done = [], 0
    for n in range(1, len(order) + 1):
        active = sorted(order[:n], key=lambda f: (loads[f], f))
        if n < len(order):
            top = order[n]
            # groups that go to an active fold while it is lighter than the next one
            left = sum(max(0, -(-(loads[top] - loads[f]) // size) + (f < top and (loads[top] - loads[f]) % size == 0)) for f in active)
        else:
            left = count - done
        take = min(left, count - done)
        if take > 0:
            made.append((done, active))
            for k, f in enumerate(active):
                loads[f] += size * (take // n + (k < take % n))
            done += take
    return made


def balanced_groups(groups: DataFrame, n_folds: int) -> DataFrame:
    """(group, n, fold) for any number of groups (group, n): the largest group left goes to the lightest fold.

    Groups of one size are alike, so the dealing needs only how many there are
    of each size: that histogram comes to the driver (MAX_SIZES sizes at most),
    which says by which turns the groups of a size go round. A group's place
    among those of its size is its rank by a hash of the name. Loads are those
    of the greedy assignment one by one, and within one largest group of each
    other. Null groups are left out.
    """
    spark = groups.sparkSession
    rows = groups.select(F.col("group").cast("string").alias("pid"), F.col("n").cast("long").alias("n")).where("pid is not null")
    sizes = [(r["n"], r["count"]) for r in rows.groupBy("n").count().limit(MAX_SIZES + 1).collect()]
    if len(sizes) > MAX_SIZES:
        raise ValueError(f"groups of more than {MAX_SIZES} sizes")
    if sum(c for _, c in sizes) < n_folds:
        raise ValueError(f"{n_folds} folds need as many groups, not {sum(c for _, c in sizes)}")
    loads, turns = [0] * n_folds, []
    for size, count in sorted(sizes, reverse=True):
        if size <= 0:
            raise ValueError("a group has no rows")
        made = _turns(loads, size, count)
        turns += [(size, first, made[k + 1][0] if k + 1 < len(made) else count, order) for k, (first, order) in enumerate(made)]
    spec = spark.createDataFrame(turns, "_size long, _first long, _end long, _order array<int>")
    ranked = _ranked(rows.withColumn("_h", F.md5("pid")), ["n"], "_h")
    dealt = ranked.join(spec, (F.col("n") == F.col("_size")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    return dealt.select(F.col("pid").alias("group"), "n", F.get("_order", ((F.col("_rank") - F.col("_first")) % F.size("_order")).cast("int")).alias("fold"))


def fixture_rows(folds: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, fold, idx): the last row (by idx) of each tested id; ids without a row are left out."""
    last = rows.groupBy(F.col("pid").cast("string").alias("pid")).agg(F.max("idx").alias("idx"))
    return folds.join(last, "pid").select("rep", "fold", "idx")


def membership_checked(folds: DataFrame, data: DataFrame) -> DataFrame:
    """folds, once validate_folds has found the people of data in them."""
    validate_folds(folds, data)
    return folds


def write_fold_file(spark: SparkSession, path: str, ids: list[str], n_splits: int = 5, n_reps: int = 20, force: bool = False) -> dict:
    """Make and write a fold document; an existing file is kept unless force is given."""
    from tidewell.sources.files import write_folds
    from tidewell.sources.shared import exists

    if not force and exists(spark, path):
        raise FileExistsError(path)
    made = repeated_folds(ids, n_splits, n_reps)
    write_folds(spark, made, path)
    return made
