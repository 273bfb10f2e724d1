import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import suffix_dedup


def brute(rows):
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if key is not None:
            earlier = {o[k : k + 50] for i, t in rows if i is not None and i < key for o in [(t or "").encode()] for k in range(len(o) - 49)}
            for k in range(len(data) - 49):
                if data[k : k + 50] in earlier:
                    gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((str(key), len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in suffix_dedup.remove_repeats(df).collect())


def small(corpus):
    return [(k, t[:4000] if t else t) for k, t, *_ in corpus]


def test_matches_brute_force(spark, corpus):
    rows = small(corpus)
    rows += [(500, "ab" * 200), (501, "ba" * 150), (502, "a" * 49), (503, "a" * 50), (504, "ü" * 60), (505, "xü" + "ü" * 40)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_many_blocks_and_shards_give_the_same(spark, corpus, monkeypatch):
    rows = small(corpus)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 9000)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_grams_give_the_same(spark, corpus, monkeypatch, hot):
    shared = "a passage that very many of the documents share, word for word, "
    rows = small(corpus)[:40] + [(600 + k, f"{k} before it comes {k * k} {shared}and after it {k * 7} goes on") for k in range(30)] + [(700, "ab" * 200), (701, "ba" * 150)]
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 9000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_other_keys_are_refused(docs):
    with pytest.raises(ValueError, match="integer"):
        suffix_dedup.remove_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (5000, 4)).astype(np.uint64) << np.uint64(62)
    order = suffix_dedup.multikey_quicksort(words)
    assert (words[order] == words[np.lexsort(words.T[::-1])]).all() and sorted(order.tolist()) == list(range(5000))
    assert suffix_dedup.multikey_quicksort(words[:0]).tolist() == []


@pytest.mark.parametrize("text", [b"", b"a" * 49, b"a" * 50, b"abc" * 100, bytes(range(256)) * 3])
def test_every_string_has_one_anchor(text):
    a = suffix_dedup.Anchors(np.frombuffer(text, np.uint8), np.array([len(text)]))
    covered = [k for f, e in zip(a.first, a.last, strict=True) for k in range(f, e + 1)]
    assert covered == list(range(max(0, len(text) - 49)))
    assert all(0 <= p - e and p - f <= 34 for p, f, e in zip(a.at, a.first, a.last, strict=True))


def test_empty_and_clashing(none, docs):
    assert suffix_dedup.remove_repeats(none).collect() == []
    clash = docs.limit(20).select("doc_id", "text", F.lit(1).alias("n_bytes"), F.lit(2).alias("block"), F.lit(3).alias("keys"))
    assert suffix_dedup.remove_repeats(clash).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
