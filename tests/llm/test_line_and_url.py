"""Site-relative line dedup and the temporal URL list join."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import line_dedup, url_filter


def brute(pages, ratio, least, once):
    """Kept lines of rows (id, host, lines)."""
    content = {}
    for _, host, lines in pages:
        content.setdefault(host or "", []).append(tuple(lines or ()))
    if once:
        content = {host: set(of) for host, of in content.items()}
    kept = []
    for k, host, lines in pages:
        of = content[host or ""]
        gone = {x for x in set(lines or ()) if x.strip() and (n := sum(x in c for c in of)) >= least and n > ratio * len(of)}
        kept.append((k, [x for x in lines or () if x not in gone]))
    return sorted(kept, key=str)


def pages():
    rows = [(k, "a", ["Home", f"text {k}", "", "About" if k % 2 else "Other"]) for k in range(20)]
    rows += [(k, "b", ["Home", f"text {k}"]) for k in range(20, 23)]
    rows += [(k, "c", ["same page", "twice"]) for k in range(23, 40)]  # copies of one page
    rows += [(40, None, None), (41, None, [""]), (None, "a", ["Home"]), (3, "a", ["Home", "text 3", "", "About"]), (42, "a", ["long " * 20000, "Home", "Home"])]
    return rows


@pytest.mark.parametrize(("ratio", "least", "once"), [(0.1, 1, False), (0.6, 2, False), (0.07, 2, False), (line_dedup.RATIO, line_dedup.MIN_PAGES, False), (0.1, 5, True), (0.07, 2, True)])
def test_lines_against_brute_force(spark, ratio, least, once):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, host string, lines array<string>, kept_lines string")
    found = line_dedup.line_dedup(df, F.col("host"), "lines", ratio=ratio, min_pages=least, copies_once=once)
    assert sorted(((r["page_id"], list(r["kept_lines"])) for r in found.collect()), key=str) == brute(rows, ratio, least, once)


def test_documents_keep_their_columns_and_rows(spark, docs, none):
    found = line_dedup.documents_without_boilerplate(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert found.where("text is null").count() == docs.where("text is null").count()
    assert line_dedup.documents_without_boilerplate(none).count() == 0
    shared = spark.createDataFrame([(k, f"Cookie notice\nbody {k}", "en", "s", 20) for k in range(20)], docs.schema)
    assert {r["text"] for r in line_dedup.documents_without_boilerplate(shared).collect()} == {f"body {k}" for k in range(20)}


def test_documents_own_columns_stay(spark, docs):
    mine = docs.select("*", F.lit(111).alias("n_lines"), F.lit(2.5).alias("n_dropped"), F.lit("k").alias("kept_lines"), F.lit(7).alias("line"))
    found = line_dedup.documents_without_boilerplate(mine)
    assert found.dtypes == mine.dtypes
    assert found.where("n_lines = 111 and n_dropped = 2.5 and kept_lines = 'k' and line = 7").count() == docs.count()


def test_copies_of_a_document_keep_their_text(spark, docs):
    rows = [(k, "the very same\ntext in all", "en", "s", 20) for k in range(30)] + [(100 + k, f"another {k}", "en", "s", 20) for k in range(40)]
    found = line_dedup.documents_without_boilerplate(spark.createDataFrame(rows, docs.schema)).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {k: t for k, t, *_ in rows}


def test_pages_of_small_hosts_keep_their_own_lines(spark, tmp_path):
    rows = [(k, f"http://h{k // 3}.org/{k}", f"<p>Menu</p><p>own {k}</p>") for k in range(7)]  # the last host has one page
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"].replace(" ", "")) for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {k: (2, 1, f"own{k}") if k < 6 else (2, 0, f"Menu\nown{k}") for k in range(7)}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[3] for r in con.execute(line_dedup.ORACLE_SQL).fetchall()} == {k: v[1] for k, v in found.items()}


def test_visible_lines(spark):
    html = "<html><!-- no --><script>x()</script><body><p>One &amp; <b>two</b></p><div>Three<br>four</div></body></html>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(line_dedup.html_lines(F.col("html")).alias("x"))
    assert [[s.strip() for s in r["x"]] for r in df.collect()] == [["One & two", "Three", "four"], [], []]


def test_unclosed_markup_takes_no_time(spark):
    df = spark.createDataFrame([("<script" * 60_000,), ("a" + "<" * 400_000,), ("<!--" * 90_000,), ("<p>x</p><script>never closed",)], "html string")
    assert [r["x"] for r in df.select(line_dedup.html_lines(F.col("html")).alias("x")).collect()][3] == ["x"]


def day(text):
    return datetime.date.fromisoformat(text)


ENTRIES = [
    ("bad.org", day("2024-01-10"), "block"),
    ("bad.org", day("2024-03-01"), "remove"),
    ("bad.org", day("2024-05-01"), "block"),
    ("ok.bad.org", day("2024-02-01"), "allow"),
    ("tie.org", day("2024-01-01"), "allow"),
    ("tie.org", day("2024-01-01"), "block"),
    (None, day("2024-01-01"), "block"),
    ("0.1", day("2024-01-01"), "block"),
    ("TOP.", day("2024-01-01"), "block"),
    ("null.org", None, "block"),
    ("warned.org", day("2024-01-01"), "block"),
    ("warned.org", day("2024-01-01"), "warn"),
    ("warned.org", day("2024-02-01"), "warn"),
    ("stronger.org", day("2024-01-01"), "remove"),
    ("stronger.org", day("2024-01-01"), "block"),
    ("[2001:db8::1]", day("2024-01-01"), "block"),
]


@pytest.mark.parametrize(
    ("url", "at", "action"),
    [
        ("http://bad.org/x", "2024-01-09", None),
        ("http://bad.org/x", "2024-01-10", "block"),
        ("http://WWW.bad.org:80/x", "2024-02-29", "block"),
        ("http://bad.org/x", "2024-03-01", None),
        ("http://bad.org/x", "2024-06-01", "block"),
        ("https://ok.bad.org", "2024-02-15", "allow"),
        ("https://ok.bad.org", "2024-01-15", "block"),
        ("https://notbad.org", "2024-01-15", None),
        ("http://tie.org", "2024-01-01", "block"),
        ("http://null.org", "2024-01-01", None),
        ("http://bad.org./x", "2024-01-10", "block"),
        ("http://10.0.0.1/x", "2024-01-10", None),
        ("http://x.any.top/y", "2024-01-10", "block"),
        ("http://x.any.top/y", "2023-01-10", None),
        ("http://warned.org", "2024-03-01", "block"),
        ("http://stronger.org", "2024-03-01", None),
        ("http://u@[2001:DB8::1]:80/x.org", "2024-03-01", "block"),
        ("http://[2001:db8::2]/", "2024-03-01", None),
        ("http://[2001", "2024-03-01", None),
        ("no address", "2024-02-01", None),
        (None, "2024-02-01", None),
        ("http://bad.org", None, None),
    ],
)
def test_entries_as_of_the_fetch_day(spark, url, at, action):
    captures = spark.createDataFrame([(url, day(at) if at else None, "x")] * 2, "url string, fetch_date date, action string")
    entries = spark.createDataFrame(ENTRIES, "domain string, listed_on date, action string")
    found = url_filter.url_filter(captures, entries).collect()
    assert [(r["action"], r["blocked"]) for r in found] == [(action, action == "block")] * 2


@pytest.mark.parametrize(("url", "host"), [("http://[2001:db8::1]/", "[2001:db8::1]"), ("http://[2001:db8::1]:8080", "[2001:db8::1]"), ("http://a.b:80/x", "a.b"), ("http://a.b./", "a.b"), ("http://[", ""), ("http:///x", "")])
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(line_dedup.host_of(F.col("u")).alias("h")).first()["h"] == host


def test_url_filter_of_empty_tables(spark):
    captures = spark.createDataFrame([], "url string, fetch_date date")
    entries = spark.createDataFrame([], "domain string, listed_on date, action string")
    assert url_filter.url_filter(captures, entries).count() == 0
    assert not url_filter.url_filter(spark.createDataFrame([("http://a.b", day("2024-01-01"))], captures.schema), entries).first()["blocked"]
