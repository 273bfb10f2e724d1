import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(None)


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: library.encode(text, add_special_tokens=False).ids


def check(pieces, texts, reference, capacity):
    by = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
    assert {k for k, _ in texts} == set(by)
    for key, text in texts:
        ids = np.append(reference(text or ""), 1).astype("<u4")
        rows = sorted(by[key], key=lambda r: r["start"])
        at = 0
        for r in rows:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
        padding += 0 if not end & (end - 1) else capacity - end
    return padding, len(sequences)


def test_pieces_are_whole_and_gapless(docs, corpus, reference):
    seen, texts = set(), []
    for k, t, *_ in corpus:
        if k is not None and k not in seen:
            seen.add(k)
            texts.append((k, t))
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    padding, n = check(rows, texts, reference, 2048)
    assert padding < 0.03 * n * 2048


@pytest.mark.parametrize(("capacity", "shortest"), [(64, 8), (64, 1), (16, 16)])
def test_other_capacities(docs, corpus, reference, capacity, shortest):
    texts = [(k, t) for k, t, *_ in corpus[:40]]
    rows = packing.pack(docs.where("doc_id < 40").dropDuplicates(["doc_id"]), packing.Packing(capacity, shortest)).collect()
    padding, n = check(rows, texts, reference, capacity)
    assert padding < 0.1 * n * capacity


def test_repeated_and_null_rows_are_packed(docs, corpus):
    rows = packing.pack(docs).where("start = 0").collect()
    assert len(rows) == len(corpus) and sum(r["doc_id"] is None for r in rows) == 2


def test_cuts_add_up():
    for n in range(0, 700):
        parts = packing.cut(n, 128, 16)
        assert sum(parts) == n and all(0 < p <= 128 and (p < 16 or not p & (p - 1)) for p in parts)


@pytest.mark.parametrize("text", ["", " ", "\n" * 3000, " " * 3000, "a" * 3000, "日本語 text", "é́", "don't  stop\t\n", "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>", "end <|endoftext|>", "<|endoftext |>", "\U0001f600" * 50, "1234567 89"])
def test_ids_are_the_librarys(encoder, reference, text):
    assert encoder(text).tolist() == reference(text)


def test_ids_on_prose(encoder, reference, corpus):
    for _, text, *_ in corpus:
        assert encoder(text or "").tolist() == reference(text or "")


def test_an_added_token_has_its_own_id(spark, reference):
    text = "a <|endoftext|> b"
    assert 50256 in reference(text)
    row = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["length"], row["ids_crc32"]) == (len(reference(text)) + 1, zlib.crc32(np.array([*reference(text), 1], "<u4").tobytes()))


def test_bins_hold_as_many_pieces_as_their_class(spark):
    pieces = spark.createDataFrame([(k, 0, 1 + k % 64, 0) for k in range(4000)], "doc_id long, start long, length long, ids_crc32 long")
    of = {}
    for r in packing.place(pieces, 64).collect():
        of.setdefault(r["sequence_id"], []).append(r["length"])
    for name, lengths in of.items():
        assert sum(lengths) <= 64
        if name % 128:  # not one of the bins of what is left
            assert {64 // x for x in lengths} == {len(lengths)}


def test_empty_and_clashing(none, docs):
    assert packing.pack(none).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("start"), F.lit(2).alias("share"), F.lit(3).alias("one"))
    assert packing.pack(clash).where("start = 0").count() == docs.count()


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        packing.Packing(capacity=1000)
