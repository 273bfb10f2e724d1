import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidewell.llm import language_id as lid


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, lang := ("en", "de", "fr")[k % 3], rng.randint(15, 80)), lang) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.fit(df.where(~lid.held_out("doc_id", 5)), sample_docs=30)
    found = lid.language_id(df.where(lid.held_out("doc_id", 5)), model)
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    assert all(0 <= r["score"] <= 1 for r in found.collect())


def test_columns_stay_and_odd_texts_are_undetermined(docs, corpus):
    model = lid.fit(docs, sample_docs=20)
    found = lid.language_id(docs.withColumn("score", F.lit("mine")), model)
    assert found.columns == ["text", "doc_id", "lang", "source", "n_chars", "lang_pred", "score", "margin", "rejected"]
    rows = found.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == none and (not none or (r["score"] == 0 and r["rejected"]))


def test_text_and_label_decide_alone(docs):
    model = lid.fit(docs, sample_docs=20)
    a = lid.language_id(docs, model).select("text", "lang_pred").distinct()
    b = lid.language_id(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model).select("text", "lang_pred").distinct()
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_no_labels_reject_all(docs, none):
    model = lid.fit(none)
    assert model.dictionaries == () and lid.language_id(docs, model).where("not rejected").count() == 0
    assert lid.language_id(none, model).count() == 0
    assert lid.fit(docs.withColumn("lang", F.lit(None).cast("string"))).dictionaries == ()


def test_sample_holds_whole_distinct_texts(spark):
    rng = random.Random(3)
    texts = [prose(rng, "en", 40) for _ in range(300)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(1000 + k, texts[0], "en") for k in range(400)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=20)
    ((_, data),) = model.dictionaries
    plain = [lid.letters_only(t) for t in texts]
    held = [t for t in plain if t in data.decode()]
    assert 5 <= len(held) <= 60 and len(data.decode()) == sum(map(len, held)) + len(held) - 1
    with pytest.raises(ValueError):
        lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang", F.col("doc_id").cast("string")), max_languages=10)


def test_predictions_are_those_of_plain_compression(docs, corpus):
    model = lid.fit(docs, sample_docs=20)
    found = {r["text"]: (r["lang_pred"], r["margin"]) for r in lid.language_id(docs, model).collect()}
    for text in {t for _, t, *_ in corpus if t and any(c.isalpha() for c in t)}:
        data = lid.letters_only(text).encode()
        sizes = []
        for name, sample in model.dictionaries:
            total = 0
            for k in range(0, len(data), model.block_bytes):
                one = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
                total += len(one.compress(data[k : k + model.block_bytes]))
            sizes.append((total, name))
        sizes.sort(key=lambda x: x[0])
        name, margin = found[text]
        assert min(t for t, n in sizes if n == name) <= 1.02 * sizes[0][0]
        if (sizes[1][0] - sizes[0][0]) / sizes[1][0] > 0.05:
            assert name == sizes[0][1] and abs(margin - (sizes[1][0] - sizes[0][0]) / sizes[1][0]) < 0.03


def test_ties_go_to_the_frequent_language_and_are_rejected(spark):
    model = lid.CompressionModel((("often", b"some text of a language"), ("seldom", b"some text of a language")))
    row = lid.language_id(spark.createDataFrame([(1, "some text", 2.5)], "doc_id long, text string, score double"), model).first()
    assert row["lang_pred"] == "often" and row["margin"] == 0 and row["rejected"]


def test_own_columns_stay(docs):
    model = lid.fit(docs, sample_docs=20)
    mine = docs.withColumns({c: F.lit("mine") for c in ("score", "margin", "lang_pred", "rejected")})
    kept = lid.of_known_language(mine, model)
    assert kept.columns == mine.columns and all(r["score"] == r["rejected"] == "mine" for r in kept.collect())


def test_long_texts_are_no_samples(spark, docs):
    rows = spark.createDataFrame([(k, ("le la que " * (30_000 if k < 5 else 40)).strip(), "fr", "s", 0) for k in range(9)], docs.schema)
    model = lid.fit(rows, sample_bytes=1000)
    assert [(name, len(d)) for name, d in model.dictionaries] == [("fr", 399)]
    assert lid.language_id(rows, model).where("lang_pred = 'fr'").count() == 9
