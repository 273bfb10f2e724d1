import hashlib
import random
import re
import zlib

import pytest

from tests.llm.conftest import SCHEMA
from tidewell.llm import periodic


def plain_runs(w, least=periodic.LEAST):
    """Every run by trying every period on every stretch."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            part = w[i : i + size]
            if size >= max(least, 2 * q) and not any(part[k:] == part[:-k] for k in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(3)
    for k in range(600):
        size = rng.choice([1, 2, 2, 3, 5])
        yield [rng.randrange(size) for _ in range(rng.randint(0, 70))]
        part = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        yield [rng.randrange(9, 99) for _ in range(rng.randint(0, 9))] + [part[i % len(part)] for i in range(rng.randint(5, 60))] + [rng.randrange(9, 99)] * (k % 3)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_those_of_all_periods(least):
    for w in sequences():
        assert periodic.runs_of(w, least) == plain_runs(w, least)
        assert periodic.text_runs([b"%d" % x for x in w], least) == plain_runs(w, least)


def test_long_repetitions_take_little_time():
    assert periodic.text_runs([b"word"] * 100_000) == [(0, 100_000, 1)]
    own = [b"%d" % k for k in range(30_000)]
    assert periodic.text_runs(own * 3) == [(0, 90_000, 30_000)]
    assert periodic.text_runs(own) == []


def test_large_sets_stay_in_order():
    rng = random.Random(1)
    places = list(range(6 * periodic.CHUNK))
    rng.shuffle(places)
    ends = periodic._Ends(places[0])
    for x in places[1:]:
        ends.add(x)
    assert [x for c in ends.chunks for x in c] == sorted(places) and ends.size == len(places) and len(ends.chunks) > 1
    assert all(ends.around(x) == (x - 1, x + 1 if x + 1 < len(places) else -1) for x in places)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    # equal stretches of one word are many periods to try; the plain search is kept to what it can do
    runs = plain_runs(w) if len(set(w)) > 1 or len(w) < 200 else [(0, len(w), 1)]
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4), digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_is_the_plain_one(spark, docs, corpus, tmp_path):
    repeated = [(1000 + k, "start " + " ".join(f"w{j}" for j in range(k)) + " end" + " again and" * (k // 2), None, None, None) for k in range(60)]
    docs.union(spark.createDataFrame(repeated, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [kind for _, kind in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
    want = [plain_row(r[0], r[1]) for r in [*corpus, *repeated]]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 20


def test_operator_keeps_columns_and_texts(spark, none):
    rows = spark.createDataFrame([("a b " * 7 + "c", "mine", 5), (None, None, None), (" \t", "", 1)], "text string, runs string, own int")
    found = [r.asDict(recursive=True) for r in periodic.periodic_runs(rows).orderBy("own").collect()]
    assert [(r["n_words"], r["collapsed_text"], r["own"]) for r in found] == [(0, "", None), (0, "", 1), (15, "a b c", 5)]
    assert found[2]["runs"] == [{"start": 0, "length": 14, "period": 2}]
    assert periodic.periodic_runs(none).collect() == []
