"""URL filtering by a temporal list join.

A list is a history: dated entries, each giving a pattern an action from its date on.  Entries become
validity intervals (an entry ends where the next one of its pattern begins; the action ``remove`` ends
a listing and starts none), and every capture is judged by the entries in force when it was fetched.
A pattern is a domain, which covers its subdomains, or a domain with the first segment of a path.
The longest pattern in force decides, of one pattern the interval that holds the time.

DataFrame functions only.  Patterns are joined to the distinct (host, first segment) pairs, of which
there are far fewer than captures; each pair gets its intervals as one array, captures meet it in one
equi-join that cannot multiply them, and the as-of search is inside the row.  A host with a third of
all captures is a hot key on the capture side alone, which AQE splits.

Defined cases: a null or hostless URL, a null time, or no entry in force gives the default action with
null pattern; several entries of one pattern and date keep the last by action name; null patterns or
dates are no entries; repeated captures are judged each; empty tables give empty results or the
default; the operator's columns ``url_action``, ``url_pattern``, ``url_since`` replace columns of
those names and all others stay; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

OWN = ("url_action", "url_pattern", "url_since")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, final dot and leading www."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.regexp_replace(host, r"^www\.|\.$", "")


def segment_of(url: Column) -> Column:
    """The first segment of the path, empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) of a list of (pattern, action, listed)."""
    usable = entries.where(F.col("pattern").isNotNull() & F.col("listed").isNotNull())
    last = usable.groupBy("pattern", "listed").agg(F.max("action").alias("action"))
    ends = F.lead("listed").over(W.Window.partitionBy("pattern").orderBy("listed"))
    return last.select("pattern", "action", F.col("listed").alias("since"), ends.alias("until")).where(F.col("action") != "remove")


def _candidates(host: Column, segment: Column) -> Column:
    """Every pattern that can cover a host and a first segment."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(segment == "", suffixes).otherwise(F.concat(suffixes, F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), segment))))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", default: str = "allow") -> DataFrame:
    """``captures`` with url_action, url_pattern and url_since as of each one's time."""
    kept = [c for c in captures.columns if c not in OWN]
    keyed = captures.select(*kept, host_of(F.col(url_col)).alias("__host"), segment_of(F.col(url_col)).alias("__segment"))
    pairs = keyed.where(F.col("__host") != "").select("__host", "__segment").distinct()
    wanted = pairs.select("__host", "__segment", F.explode(_candidates(F.col("__host"), F.col("__segment"))).alias("pattern"))
    one = F.struct(F.length("pattern").alias("n"), "pattern", "since", "until", "action")
    rules = wanted.join(intervals(entries), "pattern").groupBy("__host", "__segment").agg(F.collect_list(one).alias("__rules"))
    # Two salts: the join then has an exchange of its own on either side, whose skewed parts AQE splits.
    rules = rules.withColumn("__salt", F.explode(F.array(F.lit(0), F.lit(1))))
    keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64(url_col, time_col), F.lit(2)).cast("int"))
    at = F.col(time_col)
    live = F.filter("__rules", lambda r: (r["since"] <= at) & (r["until"].isNull() | (at < r["until"])))
    found = keyed.join(rules, ["__host", "__segment", "__salt"], "left").withColumn("__best", F.array_max(live))
    best = F.col("__best")
    return found.select(*kept, F.coalesce(best["action"], F.lit(default)).alias("url_action"), best["pattern"].alias("url_pattern"), best["since"].alias("url_since"))


#: The query's list and times, for want of such columns in the tables: every registered domain has a
#: history of four entries, and its German section one of its own; a page was fetched on a day of 2024.
DOMAIN = r"([^.]+\.[^.]+\.[^.]+)$"


def sample_list(captures: DataFrame, url_col: str = "url") -> DataFrame:
    domains = captures.select(F.regexp_extract(host_of(F.col(url_col)), DOMAIN, 1).alias("domain")).where("domain <> ''").distinct()
    day = (F.length("domain") * 31 + F.ascii("domain")) % 60
    dated = lambda suffix, action, offset: F.struct(F.concat("domain", F.lit(suffix)).alias("pattern"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), (day + offset).cast("int")).alias("listed"))
    history = F.array(dated("", "block", 10), dated("", "allow", 90), dated("", "block", 170), dated("", "remove", 250), dated("/de", "block", 60), dated("/de", "remove", 140))
    return domains.select(F.inline(history))


def sample_time(id_col: str) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col(id_col), F.lit(366)).cast("int"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id % 366 + 366) % 366)::INTEGER AS fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.|\.$', '', 'g') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM pages),
dom AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS d FROM p),
e AS (
  SELECT d || s AS pattern, a AS action, DATE '2024-01-01' + ((length(d) * 31 + ascii(d)) % 60 + o)::INTEGER AS listed
  FROM dom, (VALUES ('', 'block', 10), ('', 'allow', 90), ('', 'block', 170), ('', 'remove', 250), ('/de', 'block', 60), ('/de', 'remove', 140)) v(s, a, o) WHERE d <> ''),
iv AS (SELECT pattern, action, listed AS since, lead(listed) OVER (PARTITION BY pattern ORDER BY listed) AS until FROM e),
m AS (
  SELECT p.page_id, p.url, iv.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(pattern) DESC) AS k
  FROM p JOIN iv ON iv.action <> 'remove' AND since <= fetched AND (until IS NULL OR fetched < until)
    AND ((seg <> '' AND contains(pattern, '/') AND split_part(pattern, '/', 2) = seg AND ('.' || host) LIKE ('%.' || split_part(pattern, '/', 1))) OR (NOT contains(pattern, '/') AND ('.' || host) LIKE ('%.' || pattern))))
SELECT p.page_id, p.url, p.fetched, coalesce(m.action, 'allow') AS url_action, m.pattern AS url_pattern, m.since AS url_since, coalesce(m.action, 'allow') <> 'block' AS kept
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1"""
