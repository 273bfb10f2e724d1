"""URL filtering against dated lists, as of each capture's fetch time.

A list is a history of entries (domain, listed_on, action). Each entry holds
from its date to the domain's next entry; the as-of join finds, for every
capture, the entries in force on its day, and the most specific domain decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, table
from tidewell.llm.line_dedup import HOST, _quoted, host_of


#: What an entry says, the stronger later.
ACTIONS = ("allow", "block", "remove")


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to): valid_to is exclusive, null while in force.

    entries: domain, listed_on date, action ('block', 'allow' or 'remove').
    Several entries of a domain on one day count as one, of which 'remove' wins
    over 'block' over 'allow'. Rows with another action, or a null in any of
    the three columns, say nothing and are ignored. The window of a domain has
    at most one row a day.
    """
    clean = entries.select(F.regexp_replace(F.lower("domain"), r"\.+$", "").alias("domain"), F.col("listed_on").cast("date").alias("valid_from"), F.lower("action").alias("action")).dropna()
    clean = clean.where(F.col("action").isin(*ACTIONS))
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    daily = clean.groupBy("domain", "valid_from").agg(F.max_by("action", rank).alias("action"))
    after = F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from"))
    return daily.withColumn("valid_to", after).where("action <> 'remove'").select("domain", "action", "valid_from", "valid_to")


def domains_of(host: Column) -> Column:
    """host and its parent domains, longest first; an address has no parents."""
    parents = F.transform(F.sequence(F.lit(0), F.size(F.split(host, r"\.")) - 1), lambda k: F.concat_ws(".", F.slice(F.split(host, r"\."), k + 1, 1 << 20)))
    return F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\["), F.array(host)).otherwise(parents)


def url_filter(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetch_date") -> DataFrame:
    """captures with host, domain, action, listed_on and blocked (columns of those names are replaced).

    domain, action and listed_on are those of the deciding entry, null if none
    is in force; blocked is true where its action is 'block'. A URL without a
    host, or a null fetch day, meets no entry. Every row is returned.

    Hosts and listed domains are compared without a trailing dot.

    Captures are first reduced to their distinct (host, day), so a host with
    very many captures is looked up once a day of the calendar. The join on the
    domain and the one back on (host, day) may be split by Spark at hot keys.
    """
    rest = captures.drop("host", "domain", "action", "listed_on", "blocked")
    rest = rest.withColumn("host", host_of(F.col(url))).withColumn("_tw_day", F.col(fetched).cast("date"))
    asked = rest.select("host", "_tw_day").where("host <> '' and _tw_day is not null").distinct()
    listed = materialise(intervals(entries))
    asked = asked.select("host", "_tw_day", F.posexplode(domains_of(F.col("host"))).alias("depth", "domain"))
    # nearly every host ends in one of a few top-level domains: those no list has are dropped where they arise
    top = (F.col("depth") > 0) & ~F.contains("domain", F.lit("."))
    tops = listed.where(~F.contains("domain", F.lit("."))).select("domain").distinct()
    asked = materialise(asked.where(~top).union(asked.where(top).join(tops, "domain", "left_semi").select(asked.columns)))
    active = asked.join(listed, "domain").where("valid_from <= _tw_day and (valid_to is null or _tw_day < valid_to)")
    answers = active.groupBy("host", "_tw_day").agg(F.min(F.struct("depth", "domain", "action", "valid_from")).alias("hit"))
    answers = materialise(answers.select("host", "_tw_day", "hit.domain", "hit.action", F.col("hit.valid_from").alias("listed_on")))
    return rest.join(answers, ["host", "_tw_day"], "left").select(*[c for c in rest.columns if c != "_tw_day"], "domain", "action", "listed_on", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))


# The tables hold neither fetch days nor lists. The query derives both by these rules.
_DAY = "page_id * 7919 % 366"
_DRAW = "('0x' || substr(md5(domain), 1, 7))"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page evaluated as of its (derived) fetch day against a list history with entries for about half of the hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_date", F.date_add(F.lit("2024-01-01").cast("date"), F.expr(f"cast({_DAY} as int)")))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    # sites under a subdomain are listed by their parent
    sites = hosts.select(F.regexp_replace("host", r"^(?:m|www|blog)\.", "").alias("domain")).distinct()
    draws = sites.withColumn("x", F.conv(F.substring(F.md5("domain"), 1, 7), 16, 10).cast("long"))
    first = draws.where("x % 2 = 0").selectExpr("domain", "x % 300 as day", "'block' as action")
    then = draws.where("x % 4 = 0").selectExpr("domain", "x % 300 + 1 + x % 60 as day", "case when x % 8 = 0 then 'allow' else 'remove' end as action")
    mobile = hosts.where("host like 'm.%'").withColumn("x", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")).where("x % 3 = 0").selectExpr("host as domain", "x % 365 as day", "case when x % 2 = 0 then 'allow' else 'block' end as action")
    entries = first.union(then).union(mobile).select("domain", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int")).alias("listed_on"), "action")
    return url_filter(captures, entries).select("page_id", "url", "fetch_date", "host", "domain", "action", "listed_on", "blocked")


ORACLE_SQL = f"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST({_DAY} AS INTEGER) AS fetch_date,
         coalesce(regexp_extract(lower(url), {_quoted(HOST)}, 1), '') AS host FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
draws AS (
  SELECT domain, CAST({_DRAW} AS BIGINT) AS x
  FROM (SELECT DISTINCT regexp_replace(host, '^(?:m|www|blog)\\.', '') AS domain FROM hosts)),
mobile AS (SELECT host AS domain, CAST(('0x' || substr(md5(host), 1, 7)) AS BIGINT) AS x FROM hosts WHERE host LIKE 'm.%'),
entries AS (
  SELECT domain, x % 300 AS d, 'block' AS action FROM draws WHERE x % 2 = 0
  UNION ALL SELECT domain, x % 300 + 1 + x % 60, CASE WHEN x % 8 = 0 THEN 'allow' ELSE 'remove' END FROM draws WHERE x % 4 = 0
  UNION ALL SELECT domain, x % 365, CASE WHEN x % 2 = 0 THEN 'allow' ELSE 'block' END FROM mobile WHERE x % 3 = 0),
daily AS (SELECT domain, DATE '2024-01-01' + CAST(d AS INTEGER) AS valid_from, max(action) AS action FROM entries GROUP BY 1, 2),
listed AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY domain ORDER BY valid_from) AS valid_to FROM daily),
hits AS (
  SELECT c.page_id, l.domain, l.action, l.valid_from,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(l.domain) DESC) AS r
  FROM captures c JOIN listed l
    ON (c.host = l.domain OR ends_with(c.host, '.' || l.domain))
   AND l.action <> 'remove' AND l.valid_from <= c.fetch_date AND (l.valid_to IS NULL OR c.fetch_date < l.valid_to))
SELECT c.page_id, c.url, c.fetch_date, c.host, h.domain, h.action, h.valid_from AS listed_on, coalesce(h.action = 'block', false) AS blocked
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""
