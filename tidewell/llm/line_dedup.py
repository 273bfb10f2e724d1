"""Site-relative line dedup: a line found on too large a share of a host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, table

#: Share of a host's pages above which a line is boilerplate. A line on a single page is none: of a host of few pages every line is on a large share.
RATIO, MIN_PAGES = 0.07, 2

#: Steps from markup to lines: (pattern, replacement). What is never closed reaches to the end, so no part is scanned again and again.
MARKUP = (
    (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)", " "),
    (r"[ \t\r\n\f]+", " "),
    (r"(?i)</?(?:html|head|title|body|nav|header|footer|main|article|section|aside|div|p|h[1-6]|ul|ol|li|table|tr|td|th|br|hr|pre|blockquote|form)\b[^<>]*>", "\n"),
    (r"<[^<>]*>", ""),
    (r"&(?:nbsp|#160);", " "),
    (r"&(?:apos|#39);", "'"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r" *\n *", "\n"),
)
#: The host of a URL: an address in brackets, or up to the port; without trailing dots.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*[^/?#:.\[])"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without a trailing dot; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def text_lines(text: Column) -> Column:
    """The \\n-separated lines, blank ones too."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def html_lines(html: Column) -> Column:
    """Lines of visible text, one for each block of the markup."""
    text = F.coalesce(html, F.lit(""))
    for pattern, replacement in MARKUP:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")


def line_dedup(pages: DataFrame, host: Column, lines: str, *, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """pages with kept_lines, n_lines and n_dropped in place of the array column named ``lines``.

    Columns of pages with those names are replaced.
    A line is dropped from all pages of a host if it is on more than ``ratio``
    of them, and on at least ``min_pages``. Every row is a page; with
    ``copies_once`` the pages of a host with the same lines count as one, so
    that the text of a page with very many copies isn't boilerplate. Blank
    lines are neither counted nor dropped. A null host is a host of its own,
    the empty one; a null array of lines has no lines. Every row of pages is
    returned, repeated rows too.

    Lines are counted by hash after a map-side combine. The joins are on
    (host, line) and on (host, page content), and Spark may split any hot key.
    pages is written to the shared folder once, lines and all; leave out columns
    that the lines replace.
    """
    own = ["_tw_host", "_tw_lines", "_tw_page", "_tw_page2"]
    base = pages.withColumn("_tw_host", F.coalesce(host, F.lit(""))).withColumnRenamed(lines, "_tw_lines").drop("kept_lines", "n_lines", "n_dropped")
    base = materialise(base).withColumn("_tw_lines", F.coalesce("_tw_lines", F.array().cast("array<string>")))
    base = base.withColumns({"_tw_page": F.xxhash64("_tw_lines"), "_tw_page2": F.hash("_tw_lines")})
    page, line = ["_tw_host", "_tw_page", "_tw_page2"], ["line", "line2"]

    at = base.select(*page, F.posexplode("_tw_lines").alias("pos", "text")).where(F.trim("text") != "")
    at = materialise(at.select(*page, "pos", F.xxhash64("text").alias("line"), F.hash("text").alias("line2")).distinct())
    if copies_once:
        each, of = base.select(*page).distinct(), at.select(*page, *line).distinct()
    else:
        hashes = F.transform(F.filter("_tw_lines", lambda x: F.trim(x) != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.hash(x).alias("line2")))
        each, of = base, base.select("_tw_host", F.inline(F.array_distinct(hashes)))
    counts = of.groupBy("_tw_host", *line).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = each.groupBy("_tw_host").agg(F.count(F.lit(1)).alias("total"))
    boilerplate = materialise(counts.join(totals, "_tw_host").where(F.col("n") > ratio * F.col("total")).select("_tw_host", *line))

    dropped = at.join(boilerplate, ["_tw_host", *line]).groupBy(*page).agg(F.collect_set("pos").alias("_tw_dropped"))
    # a merge join whatever the size, so that the plan is the same at every scale
    joined = base.join(materialise(dropped).hint("merge"), page, "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_tw_lines") - 1), "_tw_dropped")
    return joined.select(
        *[c for c in base.columns if c not in own],
        F.when(F.col("_tw_dropped").isNull(), F.col("_tw_lines")).otherwise(F.transform(kept, lambda k: F.col("_tw_lines")[k])).alias("kept_lines"),
        F.size("_tw_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_tw_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def documents_without_boilerplate(docs: DataFrame, *, ratio: float = RATIO) -> DataFrame:
    """docs (text, source, n_chars, ...) without the lines that are boilerplate within their source.

    Rows all stay, in the columns of docs; texts without a dropped line, null
    ones too, are unchanged. Copies of a document count once: which of them
    stays is for near-dedup to say, not for the share of their lines.
    """
    mine = {c: f"_tw_own_{c}" for c in ("n_lines", "n_dropped", "kept_lines") if c in docs.columns}
    cut = docs.withColumnsRenamed(mine).withColumns({"_tw_null": F.col("text").isNull(), "_tw_text": text_lines(F.col("text"))}).drop("text")
    found = line_dedup(cut, F.col("source"), "_tw_text", ratio=ratio, copies_once=True)
    made = {"text": F.when(~F.col("_tw_null"), F.array_join("kept_lines", "\n"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length(F.array_join("kept_lines", "\n")).cast("long"))
    return found.select(*[made.get(c, F.col(mine.get(c, c))).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text without its host's boilerplate."""
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    found = line_dedup(pages, F.col("host"), "lines")
    return found.select("page_id", "host", "n_lines", "n_dropped", F.array_join("kept_lines", "\n").alias("kept_text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _html_sql() -> str:
    text = "coalesce(html, '')"
    for pattern, replacement in MARKUP:
        to = "chr(10)" if replacement == "\n" else _quoted(replacement)
        text = f"regexp_replace({text}, {_quoted(pattern)}, {to}, 'g')"
    return text


ORACLE_SQL = f"""
WITH base AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), {_quoted(HOST)}, 1), '') AS host,
         list_filter(string_split({_html_sql()}, chr(10)), lambda x: trim(x) <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS total FROM base GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM base) GROUP BY host, line),
boilerplate AS (
  SELECT c.host, c.line FROM counts c JOIN totals t ON c.host = t.host
  WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.total),
bad AS (SELECT host, list(line) AS bad FROM boilerplate GROUP BY host)
SELECT b.page_id, b.host, CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(list_filter(lines, lambda x: list_contains(coalesce(bad, []), x))) AS BIGINT) AS n_dropped,
       array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)), chr(10)) AS kept_text
FROM base b LEFT JOIN bad ON b.host = bad.host
"""
