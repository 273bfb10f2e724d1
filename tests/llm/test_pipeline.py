"""The corpus pipeline's stages on the small corpus."""

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    item = docs.where("doc_id = 5").first()["text"][:200]
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_in_turn(spark, docs, sf_dir):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = {r["doc_id"] for r in kept.collect()}, stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns, name
        after = {r["doc_id"] for r in kept.collect()}
        assert after <= before
        if name == "language_id":
            assert not after & {78, 79, 80}  # null, empty and blank texts
        if name == "line_dedup":
            assert after == before
        if name == "near_dedup":
            assert not after & set(range(60, 66)) and set(range(12, 60)) & before <= after
        if name == "decontamination":
            assert 5 in before and 5 not in after and len(before - after) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}


def test_run_is_the_stages_together(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    piece = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert found and sorted(map(piece, found), key=str) == sorted(map(piece, docs.collect()), key=str)
    used = {}
    for r in found:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_documents(spark, none, sf_dir):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
