import numpy as np
import pytest

from tests.llm.test_simhash import groups
from tidewell.llm import vector_links as vl

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.9):
    """Rows (vec_id, n_links, component_id, kept) by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, *_ in rows]
    x = [np.array(np.float32(v), float) / np.linalg.norm(np.array(np.float32(v), float)) if g else None for (_, v, *_), g in zip(rows, ok, strict=True)]
    near = lambda i, j: ok[i] and ok[j] and x[i] @ x[j] >= cosine
    roots = groups(len(rows), near)
    least = {}
    for (key, *_), r in zip(rows, roots, strict=True):
        least[r] = min((k for k in (least.get(r), key) if k is not None), default=None)
    return sorted(str((k, sum(bool(near(i, j)) for j in range(len(rows)) if j != i), least[roots[i]], k == least[roots[i]])) for i, (k, *_) in enumerate(rows))


def vectors(n, size, seed):
    """Random directions, a group of near copies at all cosines about 0.9, chains and copies."""
    rng = np.random.default_rng(seed)
    unit = lambda: (v := rng.normal(size=size)) / np.linalg.norm(v)
    made = [unit() for _ in range(n // 2)]
    centre = unit()
    for _ in range(n // 4):
        made.append(centre + rng.uniform(0.05, 0.5) * unit())
    while len(made) < n - 5:
        step = made[-1] / np.linalg.norm(made[-1])
        side = unit()
        side -= (side @ step) * step
        cosine = rng.choice([0.8995, 0.9005, 0.905, 0.92])
        made.append(3.0 * (cosine * step + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)))
    made += [made[3], made[3], made[3] * 2, made[n // 2 + 1], np.zeros(size)]
    order = rng.permutation(len(made))
    return [(int(k), [float(np.float32(c)) for c in made[o]], int(k % 3)) for k, o in enumerate(order)]


def found(df, **settings):
    made = vl.vector_links(df, **settings)
    assert made.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(str(tuple(r)) for r in made.collect())


@pytest.mark.parametrize(("size", "width", "cell"), [(64, 16, 40), (64, 16, 8192), (24, 5, 25), (3, 16, 60), (2, 16, 60)])
def test_links_are_those_of_all_pairs(spark, size, width, cell):
    rows = vectors(420, size, size + cell)
    assert found(spark.createDataFrame(rows, SCHEMA), width=width, cell=cell) == plain(rows)


def test_other_cosines(spark):
    rows = vectors(200, 32, 5)
    for cosine in (0.3, 0.99):
        assert found(spark.createDataFrame(rows, SCHEMA), cosine=cosine, cell=30) == plain(rows, cosine)


def test_odd_rows(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, -0.0, 0.0], 0), (4, [1.0, None, 0.0], 0), (5, [float("nan"), 1.0, 0.0], 0), (6, [float("inf"), 1.0, 0.0], 0)]
    rows += [(9, v, 0), (9, v, 0), (8, [2.0, 4.0, -0.0], None), (None, v, 0), (None, [0.0, 0.0, 7.0], 0), (7, [0.0, 0.0, 1e-30], 0), (11, [-1.0, -2.0, 0.0], 0), (12, [1e30, 2e30, 0.0], 0), (1, [3.0, -9.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", rep string, n_links int")
    assert found(df) == plain(rows)
    assert found(df.where("false")) == []
    assert found(df.where("vec_id < 7 and embedding is null")) == [str((1, 0, 1, True))]
    with pytest.raises(Exception, match="different lengths"):
        found(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA))


def test_a_group_of_copies_is_cut_into_pieces(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(k, [float(np.float32(c)) for c in centre + 0.02 * rng.normal(size=16)], 0) for k in range(300)] + [(900 + k, [1.0] + [0.0] * 15, 0) for k in range(200)]
    assert found(spark.createDataFrame(rows, SCHEMA), cell=20) == plain(rows)


def test_query_reads_all_embeddings(spark, tmp_path):
    rows = vectors(300, 64, 2)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(str(tuple(r)) for r in vl.op13_vector_links(spark, str(tmp_path)).collect()) == plain(rows)
