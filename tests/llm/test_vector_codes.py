import hashlib
import random

import numpy as np
import pytest

from tidewell.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """Codes by scanning everything in every round, in Python integers."""
    good = [(k, [int(np.floor(1024 * float(x))) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, [x for x in r[1]]))
    width = len(order[0][1]) // parts if order else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in good:
                of.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, own in of.items():
                books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    made = []
    for k, v, label in good:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        made.append((k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    total = {}
    for _, _, d, label in made:
        total[label] = total.get(label, 0) + d
    return sorted(str((k, code, d, total[label], digest)) for k, code, d, label in made)


def vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size)) * spread
    return [(int(k), [float(np.float32(x)) for x in centres[k % 12] + 0.3 * rng.normal(size=size)], int(k % 5)) for k in range(n)]


def op12(spark, rows, at):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/embeddings.parquet")
    found = vc.op12_vector_codes(spark, str(at))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(str(tuple(r)) for r in found.collect())


def test_query_is_the_plain_one(spark, tmp_path):
    rows = vectors(700, 16, 1)
    rng = random.Random(2)
    rng.shuffle(rows)
    rows += [(5000, None, 1), (5001, [1.0] * 15 + [None], 1), (5002, [float("nan")] + [0.0] * 15, None), (5003, [float("inf")] * 16, 2)]
    rows += [(5004, rows[3][1], None), (5005, rows[3][1], None), rows[7], rows[7], (None, rows[9][1], 3)]
    rows += [(6000 + k, [0.25] * 16, None) for k in range(60)]  # copies, with ties
    assert op12(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 255])
def test_few_rows(spark, tmp_path, n):
    rows = vectors(n, 8, 4) if n > 1 else [(7, [0.5] * 8, None)] * n
    assert op12(spark, rows, tmp_path) == plain(rows)


def test_other_sizes_and_settings(spark):
    rows = vectors(400, 12, 9, spread=200.0)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", codes string")
    for parts, entries, rounds in ((2, 20, 6), (3, 300, 2), (1, 5, 0)):
        found = vc.vector_codes(df, parts=parts, entries=entries, rounds=rounds)
        got = sorted((r["vec_id"], r["error"], r["codebooks_sha256"]) for r in found.collect())
        want = sorted((eval(r)[0], eval(r)[2], eval(r)[4]) for r in plain(rows, parts, entries, rounds))
        assert got == want


def test_errors(spark):
    make = lambda *v: spark.createDataFrame([(k, x, 0) for k, x in enumerate(v)], SCHEMA)
    with pytest.raises(ValueError, match="don't divide"):
        vc.vector_codes(make([1.0] * 6))
    for bad in (make([1.0] * 8, [1.0] * 4), make([1.0] * 8, [1e9] * 8)):
        with pytest.raises(Exception, match="different lengths|in size"):
            vc.vector_codes(bad).collect()


def test_heaps_skip_what_the_bounds_hold(monkeypatch):
    rng = np.random.default_rng(0)
    x = np.floor(1024 * (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] * 3 + 0.2 * rng.normal(size=(3000, 16)))).astype(np.int64)
    books = vc.Codebooks(x[None, :64].copy(), np.zeros((1, 64, 16), np.int64), np.zeros((1, 64), np.int64))
    code, _, slack = vc.scan(x, books.entries[0])
    heaps, scanned = vc._Heaps.of(slack, code, 64), []
    sums = lambda c: (np.array([[x[c == e].sum(axis=0) for e in range(64)]]), np.array([[(c == e).sum() for e in range(64)]]))
    before = (np.zeros((1, 64, 16), np.int64), np.zeros((1, 64), np.int64))
    for _ in range(8):
        now = sums(code)
        books = books.changed(now[0] - before[0], now[1] - before[1])
        before, reach = now, (books.drift + books.others)[0]
        heaps = vc._Heaps.unpacked(heaps.packed(), 64)
        popped, touched = heaps.failed(reach + vc.MARGIN)
        rows = np.array(popped, np.int64)
        scanned.append(len(rows))
        found, _, far = vc.scan(x[rows], books.entries[0])
        code[rows] = found
        heaps = heaps.pushed(touched, far + reach[found], rows, found)
        assert (code == vc.scan(x, books.entries[0])[0]).all()
        assert sorted(heaps.rows.tolist()) == list(range(len(x)))
    assert scanned[-1] < len(x) / 2
