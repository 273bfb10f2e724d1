"""Queries on the smallest given tables: against their SQL, or brute force where SQL can't say them."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_pii import base
from tests.llm.test_quality import plain
from tidewell.llm import pii, quality, registry

TABLES = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("set TimeZone='UTC'")
    for name in os.listdir(TABLES):
        made.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{TABLES}/{name}')")
    return made


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    found = registry.queries()[name](spark, TABLES).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    key = found.columns[0]
    found, want = (df[sorted(df.columns)].sort_values(key, kind="stable").reset_index(drop=True) for df in (found, want))
    for c in found.columns:
        if found[c].dtype == float:
            np.testing.assert_allclose(found[c], want[c], atol=2e-6)
        else:
            assert found[c].astype(str).replace("NaT", "None").tolist() == want[c].astype(str).replace("NaT", "None").tolist(), c


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def test_base_statistics_of_all_documents(spark, documents):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.statistics(documents).collect()}
    assert found == {r["doc_id"]: plain(r["text"]) for r in documents.select("doc_id", "text").collect()}


def test_base_spans_of_all_documents(spark, documents):
    rows = pii.op3_personal_data(spark, TABLES).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_added_spans_are_those_of_codes_the_classifier_takes(spark, documents):
    found = pii.candidates(documents).cache()
    good = set(pii.accepted(found))
    want = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"] if x["base"] or (x["kind"], x["code"]) in good] for r in found.collect()}
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in pii.personal_data(documents).select("doc_id", F.col("spans")).collect()}
    assert got == want
