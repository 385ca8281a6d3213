"""URL filters as a temporal join with dated lists.

List events (pattern, kind, action, date) become validity intervals: the last
event of a pattern on a date counts, equal actions in a row are one interval,
and an ``add`` holds until the next ``remove``.  A capture asks for its exact
URL, its host with the first path segment and every parent domain of its host;
an equi-join on the pattern with the interval around the fetch time finds what
was active.  The most specific active entry decides.

A pattern has at most one event a date after the first aggregation, which
combines map-side, so no window holds more rows than dates.  Captures are
reduced to distinct (url, fetch time) first; a hot host is split by the join
(AQE) as nothing groups above it but a map-side maximum.

Defined cases: a null or empty url, or null fetch time, matches nothing; events
with null pattern or date are left out; repeated captures get equal rows; other
columns of the captures stay, clashing names are refused by none as only the
named columns take part in the joins; empty tables give no match or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm.common import land, table

#: Kinds in rising priority.
KINDS = ("domain", "prefix", "exact")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def prefix_of(url: Column) -> Column:
    """Host and first path segment, empty without one."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    return F.when(path != "", F.concat(host_of(url), F.lit("/"), path)).otherwise("")


def patterns_of(url: Column) -> Column:
    """(kind, pattern) that could list the URL: exact, prefix, and all domains of at least two labels."""
    labels = F.split(host_of(url), r"\.")
    domains = F.when(
        F.size(labels) >= 2,
        F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("pattern"))),
    ).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    others = F.array(
        F.struct(F.lit("exact").alias("kind"), url.alias("pattern")), F.struct(F.lit("prefix").alias("kind"), prefix_of(url).alias("pattern"))
    )
    return F.filter(F.concat(others, domains), lambda x: x["pattern"] != "")


def intervals(events: DataFrame) -> DataFrame:
    """(kind, pattern, valid_from, valid_to) from (kind, pattern, action, day, seq); ``valid_to`` null while active."""
    daily = events.filter("pattern is not null and day is not null and kind is not null").groupBy("kind", "pattern", "day").agg(
        F.max(F.struct("seq", "action")).getField("action").alias("action")
    )
    w = Window.partitionBy("kind", "pattern").orderBy("day")
    changes = daily.withColumn("before", F.lag("action").over(w)).filter("before is null or before <> action")
    spans = changes.withColumn("valid_to", F.lead("day").over(w))
    return spans.filter("action = 'add'").select("kind", "pattern", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetch_day") -> DataFrame:
    """The captures with blocked, kind, pattern, valid_from and valid_to of the deciding entry."""
    asked = captures.select(F.col(url_col).alias("__url"), F.col(time_col).alias("__at")).filter("__url is not null and __at is not null").distinct()
    wanted = asked.select("__url", "__at", F.explode(patterns_of(F.col("__url"))).alias("p")).select("__url", "__at", "p.kind", "p.pattern")
    # landed, so that the join sees its size: broadcast if small, else a hot pattern's captures are split
    active = land(intervals(events), "intervals").alias("i")
    hit = wanted.alias("w").join(
        active,
        (F.col("w.pattern") == F.col("i.pattern")) & (F.col("w.kind") == F.col("i.kind")) & (F.col("__at") >= F.col("i.valid_from"))
        & (F.col("i.valid_to").isNull() | (F.col("__at") < F.col("i.valid_to"))),
    )
    rank = F.when(F.col("w.kind") == "exact", 2).when(F.col("w.kind") == "prefix", 1).otherwise(0)
    best = hit.groupBy("__url", "__at").agg(
        F.max(F.struct(
            rank.alias("rank"), F.length("w.pattern").alias("length"), F.col("w.kind").alias("kind"), F.col("w.pattern").alias("pattern"),
            F.col("i.valid_from").alias("valid_from"), F.col("i.valid_to").alias("valid_to"),
        )).alias("__best")
    )
    joined = captures.join(best, (F.col(url_col) == F.col("__url")) & (F.col(time_col) == F.col("__at")), "left")
    return joined.select(
        *[captures[c] for c in captures.columns], F.col("__best").isNotNull().alias("blocked"), F.col("__best.kind").alias("entry_kind"),
        F.col("__best.pattern").alias("entry_pattern"), F.col("__best.valid_from").alias("valid_from"), F.col("__best.valid_to").alias("valid_to"),
    )


FIRST_DAY = "2024-01-01"


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with a fetch day, which the table lacks: spread over a year by page id."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 17, F.lit(365)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetch_day"))


def events_of(pages: DataFrame) -> DataFrame:
    """A list history made from the pages: every third page lists, or takes off, its host, prefix or URL."""
    url, n = F.col("url"), F.col("page_id")
    kind = F.when(n % 2 == 0, "exact").when(n % 5 < 3, "prefix").otherwise("domain")
    pattern = F.when(kind == "exact", url).when(kind == "prefix", prefix_of(url)).otherwise(host_of(url))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(n * 31, F.lit(365)).cast("int"))
    return pages.filter("page_id % 3 = 0 and url is not null").select(
        kind.alias("kind"), pattern.alias("pattern"), F.when(n % 4 == 3, "remove").otherwise("add").alias("action"), day.alias("day"), n.alias("seq")
    ).filter("pattern <> ''")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(captures_of(pages), events_of(pages))


SQL = r"""
WITH u AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 17 % 365 AS INT) AS fetch_day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg FROM pages),
e AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'exact' WHEN page_id % 5 < 3 THEN 'prefix' ELSE 'domain' END AS kind,
    CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 5 < 3 THEN CASE WHEN seg <> '' THEN host || '/' || seg ELSE '' END ELSE host END AS pattern,
    CASE WHEN page_id % 4 = 3 THEN 'remove' ELSE 'add' END AS action,
    DATE '2024-01-01' + CAST(page_id * 31 % 365 AS INT) AS day, page_id AS seq
  FROM u WHERE page_id % 3 = 0 AND url IS NOT NULL),
d AS (SELECT kind, pattern, day, arg_max(action, seq) AS action FROM e WHERE pattern <> '' GROUP BY ALL),
c AS (SELECT *, lag(action) OVER (PARTITION BY kind, pattern ORDER BY day) AS before FROM d),
s AS (
  SELECT kind, pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day) AS valid_to
  FROM c WHERE before IS NULL OR before <> action),
i AS (SELECT * FROM s WHERE action = 'add'),
l AS (SELECT DISTINCT url, fetch_day, host, seg, string_split(host, '.') AS labels FROM u),
w AS (
  SELECT url, fetch_day, 'exact' AS kind, url AS pattern, 2 AS rank FROM l WHERE url <> ''
  UNION ALL SELECT url, fetch_day, 'prefix', host || '/' || seg, 1 FROM l WHERE seg <> ''
  UNION ALL SELECT url, fetch_day, 'domain', array_to_string(labels[k:], '.'), 0 FROM l, range(1, 12) AS r(k) WHERE k <= len(labels) - 1),
h AS (
  SELECT w.*, valid_from, valid_to, row_number() OVER (PARTITION BY url, fetch_day ORDER BY rank DESC, length(w.pattern) DESC) AS n
  FROM w JOIN i ON w.kind = i.kind AND w.pattern = i.pattern AND fetch_day >= valid_from AND (valid_to IS NULL OR fetch_day < valid_to))
SELECT page_id, u.url, u.fetch_day, h.url IS NOT NULL AS blocked, h.kind AS entry_kind, h.pattern AS entry_pattern, h.valid_from, h.valid_to
FROM u LEFT JOIN h ON u.url = h.url AND u.fetch_day = h.fetch_day AND h.n = 1
"""
