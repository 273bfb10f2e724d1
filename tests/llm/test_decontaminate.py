import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import decontaminate as d
from tests.llm.conftest import prose


def distance(item, text):
    """Least edit distance of item to any stretch of text, row by row of the whole table."""
    codes, at = np.array([ord(x) for x in text], np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item, 1):
        new = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))]
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=20), st.text("abc ", max_size=40))
def test_myers_is_the_edit_distance(item, text):
    assert d.myers(item, text)[0] == distance(item, text)


def test_pieces_make_up_the_item():
    for n in range(1, 60):
        for k in range(min(n, 8)):
            cuts = d.pieces("x" * n, k)
            assert len(cuts) == k + 1 and sum(len(p) for _, p in cuts) == n and all(p for _, p in cuts)


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(1, len(text) - 1)
        text = text[:k] + rng.choice(["", "z", text[k] + "q"]) + text[k + 1 :]
    return text


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, "en", rng.randint(12, 30))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "short one"), (103, "no"), (104, "?!"), (None, "a null id"), (3, items[3][1])]
    rows = []
    for k in range(60):
        text = prose(rng, "en", 60)
        if k % 2:
            item = items[k % 25][1]
            text = text + "\n" + edited(rng, item, k % 12).upper() + "  \n" + prose(rng, "en", 10)
        rows.append((k, text))
    rows += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (None, items[1][1]), (63, " ".join(t for _, t in items[:20]) * 3), (64, "A Short one, nothing"), (65, "say no: ?!"), (66, "not a short onex"), (67, "A null  ID")]
    return rows, items


def wanted(rows, items, spec):
    out = set()
    known = {(i, d.normal(t)) for i, t in items if d.normal(t)}
    for key, text in rows:
        doc = d.normal(text)
        for i, item in known:
            if not int(spec.error_rate * len(item)):
                left, right = (r"(?<![^\W_])" if item[0].isalnum() else ""), (r"(?![^\W_])" if item[-1].isalnum() else "")
                if re.search(left + re.escape(item) + right, doc):
                    out.add((str(key), i, 0))
            elif doc and (n := distance(item, doc)) <= int(spec.error_rate * len(item)):
                out.add((str(key), i, n))
    return out


@pytest.mark.parametrize("block_chars", [4_000_000, 900])
def test_leaks_match_brute_force(spark, planted, block_chars):
    rows, items = planted
    spec = d.Matching(block_chars=block_chars)
    found = d.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), spec)
    assert {(str(r["doc_id"]), r["item_id"], r["distance"]) for r in found.collect()} == wanted(rows, items, spec)


def test_decontaminate_keeps_the_rest(spark, planted):
    rows, items = planted
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1))
    kept = d.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    bad = {k for k, *_ in wanted(rows, items, d.Matching())}
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k, _ in rows if str(k) not in bad)


@pytest.mark.parametrize(("kind", "name"), [("string", "x7"), ("long", 7)])
def test_item_ids_keep_their_type(spark, kind, name):
    items = spark.createDataFrame([(name, "one thing to find"), (None, "another thing")], f"item_id {kind}, text string")
    found = d.leaks(spark.createDataFrame([(1, "one thing to find"), (2, "another thing")], "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, name), (2, None)}


def test_short_items_have_their_edit(spark):
    items = spark.createDataFrame([(1, "an item of thirty characters")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "xan item of thirty charactersx"), (2, "an item of thirt characters"), (3, "an item o thirt characters")], "doc_id long, text string")
    assert {(r["doc_id"], r["distance"]) for r in d.leaks(docs, items).collect()} == {(1, 0), (2, 1)}


def test_items_with_the_key_of_documents(spark):
    items = spark.createDataFrame([(5, "one thing to find")], "doc_id long, text string")
    found = d.leaks(spark.createDataFrame([(1, "one thing to find")], "doc_id long, text string"), items, item="doc_id").collect()
    assert [(r["doc_id"], r["benchmark_doc_id"]) for r in found] == [(1, 5)]


def test_empty_tables(spark, none, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(docs, items).count() == 0 and d.decontaminate(docs, items).count() == docs.count()
    assert d.leaks(none, spark.createDataFrame([(1, "some text " * 9)], "item_id long, text string")).count() == 0
