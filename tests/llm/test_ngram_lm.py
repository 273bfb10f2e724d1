import functools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import ngram_lm
from tidewell.llm.language_id import held_out


def brute(train, rows, spec):
    """Scores of rows (key, text, held) under the model of the texts of train, with plain dictionaries."""
    words = lambda text: [*(text or "").encode().lower().split(), b"\n"]
    grams = [Counter() for _ in range(spec.order)]
    for text in train:
        padded = [b"\n", *words(text)]
        for n in range(1, spec.order + 1):
            for k in range(max(1, n - 1), len(padded)):
                grams[n - 1][tuple(padded[k - n + 1 : k + 1])] += 1
    under = [Counter() for _ in range(spec.order)]
    for n in range(2, spec.order + 1):
        for gram, c in grams[n - 1].items():
            under[n - 1][gram[:-1]] += c
    total = sum(grams[0].values())
    mass = total + spec.add * (len(grams[0]) + 1)
    least = math.floor(math.log10(spec.add / mass)) - 1.0
    step = least / (spec.levels - 1)
    level = lambda p: min(spec.levels - 1, max(0, round(math.log10(p) / step))) * step

    @functools.cache
    def smoothed(gram):
        if len(gram) == 1:
            return level((grams[0][gram] + spec.add) / mass)
        n, prior = len(gram), spec.prior[len(gram) - 2]
        shorter, seen = smoothed(gram[1:]), under[n - 1][gram[:-1]]
        if not seen:
            return shorter
        if grams[n - 1][gram]:
            return level((grams[n - 1][gram] + prior * 10**shorter) / (seen + prior))
        return shorter + level(prior / (seen + prior))

    out = []
    for key, text, held in rows:
        w = words(text)
        padded = [b"\n", *w]
        base = sum(math.log10((grams[0][(x,)] + spec.add) / mass) for x in w)
        score = sum(smoothed(tuple(padded[max(0, k - spec.order + 1) : k + 1])) for k in range(1, len(padded)))
        out.append((str(key), held, len(w), sum(grams[0][(x,)] > 0 for x in w), total, base, score))
    return sorted(out)


def rows_of(corpus):
    rows = [(k, t[:3000] if t else t) for k, t, *_ in corpus]
    return [(k, t, k is not None and zlib.crc32(str(k).encode()) % 10 == 0) for k, t in rows]


def same(found, want):
    found = sorted((str(r[0]), *r[1:]) for r in found.collect())
    assert [r[:5] for r in found] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in found], [r[5:] for r in want], rtol=5e-4, atol=0.02)


@pytest.mark.parametrize(("order", "block", "shard"), [(2, 5_000_000, 700_000), (2, 4000, 900), (3, 6000, 1500), (3, 5000, 100), (4, 9000, 300)])
def test_scores_match_brute_force(spark, corpus, order, block, shard):
    rows = rows_of(corpus)
    spec = ngram_lm.Settings(order=order, block_chars=block, shard_tokens=shard)
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    same(ngram_lm.score(df, spec), brute([t for _, t, held in rows if not held], rows, spec))


@pytest.mark.parametrize(("order", "shard"), [(2, 900), (3, 300)])
def test_a_saved_model_scores_another_table(spark, corpus, tmp_path, order, shard):
    rows = rows_of(corpus)
    train, other = [r for r in rows if not r[2]], [r for r in rows if r[2]] + [(900, "words that no text of the corpus has", True), (901, "the", False)]
    spec = ngram_lm.Settings(order=order, block_chars=5000, shard_tokens=shard)
    ngram_lm.fit(spark.createDataFrame(train, "doc_id long, text string, held_out boolean"), spec).save(f"{tmp_path}/model")
    model = ngram_lm.Model.load(spark, f"{tmp_path}/model")
    df = spark.createDataFrame(other, "doc_id long, text string, held_out boolean")
    same(ngram_lm.score(df, ngram_lm.Settings(block_chars=900), model=model), brute([t for _, t, _ in train], other, spec))


def test_elias_fano_gets_and_finds():
    rng = np.random.default_rng(2)
    for values in (np.sort(rng.integers(0, 1 << 40, 4000)), np.sort(rng.integers(0, 500, 4000)), np.array([0]), np.arange(700), np.array([5, 5, 5, 1 << 33])):
        ef = ngram_lm.EliasFano(ngram_lm.EliasFano.build(values))
        assert (ef.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, values + 1, np.maximum(values - 1, 0), [0, 1 << 45]])
        zero = np.zeros(len(asked), np.int64)
        found, hit = ef.successor(asked, zero, zero + len(values))
        assert (found == np.searchsorted(values, asked)).all() and (hit == np.isin(asked, values)).all()


def test_level_finds_only_what_it_holds():
    rng = random.Random(4)
    grams = sorted({(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(3000)})
    c, w = np.array(grams).T
    names, starts = np.unique(c, return_index=True)
    level = ngram_lm.Level(ngram_lm.Level.build(names, starts, w, np.zeros(len(w), np.uint8), np.zeros(0, np.uint8)))
    assert (level.find(level.context(c), w) == np.arange(len(c))).all()
    held = set(grams)
    asked = np.array(sorted((rng.randint(0, 320), rng.randint(0, 320)) for _ in range(5000)))
    assert ((level.find(level.context(asked[:, 0]), asked[:, 1]) >= 0) == np.array([tuple(x) in held for x in asked.tolist()])).all()
    packed = ngram_lm.EliasFano.build(c * 301 + w)
    assert 8 * sum(packed[k].nbytes for k in ("low", "high")) < 10 * len(c) + 256  # 2 + log2(301 * 301 / 3000) bits each, and the ends


def test_messages_round_trip():
    arrays = {"f": np.array([250, 3], np.uint8), "a": np.array([5, 3, -9, 1 << 40]), "b": np.zeros(0, np.int64), "c": np.array([1, 2], np.uint32), "d": np.array([1 << 63], np.uint64), "e": np.array(7)}
    back = ngram_lm._unpack(ngram_lm._pack(**arrays))
    assert all((back[k] == v).all() for k, v in arrays.items())


def test_unknown_words_score_lower(spark):
    rows = [(k, "the cat sat on the mat") for k in range(1, 40)]
    df = spark.createDataFrame([*rows, (1000, "the cat sat on the mat"), (1001, "mat the on zebra quux cat")], "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 1000)
    found = {r["doc_id"]: r for r in ngram_lm.score(df).collect()}
    assert found[1000]["score"] > found[1001]["score"] and found[1001]["n_known"] == 5


def test_empty_and_clashing(none, docs):
    assert ngram_lm.score(none.withColumn("held_out", F.lit(False))).count() == 0
    clash = docs.limit(10).select("doc_id", "text", F.lit(1).alias("key"), F.lit(2).alias("block"), F.lit(False).alias("held_out"), F.lit(3).alias("score"))
    assert ngram_lm.score(clash).count() == 10


def test_query_scores_trigrams(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(str, ngram_lm.op6_language_model(spark, str(tmp_path)).collect()))
    df = docs.select("doc_id", "text", held_out("doc_id", 10).alias("held_out"))
    scored = ngram_lm.score(df, ngram_lm.Settings(order=3)).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
    assert found == sorted(map(str, scored.collect()))


def test_document_openings_spread():
    shape = ngram_lm.Shape(10**6, 10**5, 64, 64, 1000, 3, (8.0, 4.0), 0.1, 256)
    words = np.arange(2, 1002)
    grams = {"context": np.c_[np.ones(1000, np.int64), np.zeros(1000, np.int64)], "word": words, "total": np.full(1000, 10**6)}
    assert len(set(shape.owner(grams).tolist())) > 50
    rare = grams | {"total": np.full(1000, 900)}
    assert len(set(shape.owner(rare).tolist())) == 1


def test_openings_are_scored_by_brute_force(spark):
    rows = [(k, f"w{k % 50} then w{k % 7}", k % 9 == 0) for k in range(400)]
    spec = ngram_lm.Settings(order=3, block_chars=900, shard_tokens=60)
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    same(ngram_lm.score(df, spec), brute([t for _, t, held in rows if not held], rows, spec))


def test_counts_and_numbers_beyond_32_bits(spark):
    rows = [(k, "the cat sat on the mat again " + "x y z"[k % 5 :], False) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    model = ngram_lm.fit(df, ngram_lm.Settings(order=2))
    times, further = 5_000_000_000, 1 << 33

    def grown(row):
        body = ngram_lm._unpack(row["body"])
        return (row["shard"], row["block"], ngram_lm._pack(**body | {"count": body["count"] * times}))

    large = ngram_lm.Model(ngram_lm.Shape(**vars(model.shape) | {"trained": model.shape.trained * times}), spark.createDataFrame([grown(r) for r in model.words.collect()], ngram_lm._MESSAGE), model.tries)
    counts = Counter(w for _, t, _ in rows for w in [*t.split(), "\n"])
    mass = sum(counts.values()) * times + 0.1 * (len(counts) + 1)
    for r in ngram_lm.score(df, ngram_lm.Settings(order=2), model=large).collect():
        words = [*rows[r["doc_id"]][1].split(), "\n"]
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] * times + 0.1) / mass) for w in words)) and r["n_known"] == len(words)
    rng = np.random.default_rng(3)
    near, word = (rng.integers(0, 40, 500) * further + 5 for _ in range(2))
    held = dict.fromkeys(zip(near[:300].tolist(), word[:300].tolist(), strict=True))
    place = ngram_lm._places((near, word), tuple(np.array(x) for x in zip(*held, strict=True)))
    assert [(p >= 0) for p in place] == [pair in held for pair in zip(near.tolist(), word.tolist(), strict=True)]
    assert all([*held][p] == pair for p, pair in zip(place.tolist(), zip(near.tolist(), word.tolist(), strict=True), strict=True) if p >= 0)
    wide = {"id": near, "count": word}
    assert all((v == wide[k]).all() for k, v in ngram_lm._unpack(ngram_lm._pack(**{k: ngram_lm._plain(v) for k, v in wide.items()})).items())
