"""Folds of any number of people and groups."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import folds


@pytest.mark.parametrize(("n", "splits"), [(5, 5), (7, 5), (23, 4), (500, 7)])
def test_ranked_folds_are_equal_within_one(spark, n, splits):
    people = spark.createDataFrame([(f"p{k}",) for k in range(n)] + [("p1",), (None,)], "pid string").repartition(3)
    found = sorted(map(tuple, folds.ranked_folds(people, splits, 3).collect()))
    want = []
    for rep in range(3):
        order = sorted((f"p{k}" for k in range(n)), key=lambda p: (hashlib.md5(f"{rep}:{p}".encode()).hexdigest(), p))
        want += [(rep, fold, p) for fold, part in enumerate(np.array_split(np.array(order), splits)) for p in part]
    assert found == sorted(want)
    assert folds.fold_invariants(folds.ranked_folds(people, splits, 3), 3).count() == 0


def test_ranks_go_on_over_buckets(spark, monkeypatch):
    people = spark.createDataFrame([(f"p{k}",) for k in range(300)], "pid string")
    whole = sorted(map(tuple, folds.ranked_folds(people, 4, 2).collect()))
    for buckets in (1, 7):
        monkeypatch.setattr(folds._ranked, "__defaults__", (buckets,))
        assert sorted(map(tuple, folds.ranked_folds(people, 4, 2).collect())) == whole


def test_too_few_people(spark):
    with pytest.raises(Exception, match="need as many"):
        folds.ranked_folds(spark.createDataFrame([("a",)], "pid string"), 3, 1).collect()
    assert folds.ranked_folds(spark.createDataFrame([], "pid string"), 3, 1).collect() == []


def test_membership_has_every_person_in_every_fold(spark):
    people = spark.createDataFrame([(k,) for k in range(20)], "pid long")
    of = folds.hashed_folds(people, 3, 2).where("pid <> '4'")
    found = {(r["rep"], r["fold"], r["pid"]): r["is_test"] for r in folds.fold_membership(of, people).collect()}
    tested = {tuple(r) for r in of.collect()}
    grid = {(r, f) for r, f, _ in tested}
    assert found == {(r, f, str(k)): (r, f, str(k)) in tested for r, f in grid for k in range(20)}


def greedy(sizes, n):
    loads, groups = [0] * n, [0] * n
    for size in sorted(sizes, reverse=True):
        k = min(range(n), key=lambda f: (loads[f], f))
        loads[k] += size
        groups[k] += 1
    return loads, groups


@pytest.mark.parametrize("seed", range(6))
def test_turns_are_the_greedy_ones(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n = rng.randint(1, 6)
        sizes = [rng.choice([1, 2, 3, 7, 20, 100]) if seed % 2 else rng.randint(1, 9) for _ in range(rng.randint(n, 60))]
        loads, each = [0] * n, [[] for _ in range(n)]
        for size, count in sorted(Counter(sizes).items(), reverse=True):
            for first, order in (turns := folds._turns(loads, size, count)):
                end = next((f for f, _ in turns if f > first), count)
                for k in range(first, end):
                    each[order[(k - first) % len(order)]].append(size)
        assert [sum(e) for e in each] == loads and (loads, [len(e) for e in each]) == greedy(sizes, n)


def test_groups_are_dealt_without_a_list_of_them(spark):
    rng = random.Random(2)
    sizes = {f"g{k}": rng.choice([1, 1, 1, 2, 5, 30, 200]) for k in range(2000)} | {"huge": 5000}
    rows = spark.createDataFrame([*sizes.items(), (None, 7)], "group string, n long").repartition(4)
    found = folds.balanced_groups(rows, 4).collect()
    assert {r["group"]: r["n"] for r in found} == sizes and len(found) == len(sizes)
    loads = Counter()
    for r in found:
        loads[r["fold"]] += r["n"]
    assert [loads[k] for k in range(4)] == greedy(sizes.values(), 4)[0]
    assert sorted(map(str, folds.balanced_groups(rows.repartition(2), 4).collect())) == sorted(map(str, found))
    with pytest.raises(ValueError, match="need as many"):
        folds.balanced_groups(rows.limit(2), 3)
    small = {"a": 9, "b": 5, "c": 4, "d": 3, "e": 3}
    made = {r["group"]: r["fold"] for r in folds.balanced_groups(spark.createDataFrame([*small.items()], "group string, n long"), 3).collect()}
    plain = folds.group_kfold(small, 3)
    assert sorted(sum(n for g, n in small.items() if made[g] == k) for k in range(3)) == sorted(sum(n for g, n in small.items() if plain[g] == k) for k in range(3))


def test_fold_rows_are_read_back(spark, tmp_path):
    from tidewell.sources import files

    made = folds.ranked_folds(spark.range(40).select(F.col("id").alias("pid")), 4, 2)
    files.write_fold_rows(made, f"{tmp_path}/folds")
    assert sorted(map(tuple, files.read_fold_rows(spark, f"{tmp_path}/folds").collect())) == sorted(map(tuple, made.collect()))
