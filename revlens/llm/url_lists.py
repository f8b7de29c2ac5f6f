"""URL filters by a temporal list join.

List entries are dated changes (list, pattern, day, action add or remove). They
become validity intervals [valid_from, valid_to); of changes of one list and
pattern on one day a removal wins. A pattern is a host name and also covers its
subdomains. Every capture is evaluated against the entries active on the day it
was fetched: the longest active pattern decides, and among equal patterns the
list that stands first in `lists`.

Captures are first reduced to distinct (host, day) pairs, so a host with a third
of all captures is at most one row a day there; an interval list has at most one
change a day for each list and pattern. The pairs' verdicts are joined back to
the captures on both columns.

Only DataFrame functions. Defined results: a null or hostless URL and a null
day match nothing; repeated captures are judged row by row; entries with a null
column or another action are ignored; extra columns are ignored; without
entries nothing matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The deciding order of lists for one pattern.
LISTS = ("allow", "block")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; '' if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def validity(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: still valid) of every addition."""
    days = (
        entries.select("list", F.lower("pattern").alias("pattern"), "day", "action")
        .where(F.col("action").isin("add", "remove"))
        .dropna()
        .groupBy("list", "pattern", "day")
        .agg(F.bool_and(F.col("action") == "add").alias("active"))
    )
    nth = Window.partitionBy("list", "pattern").orderBy("day")
    changes = days.withColumn("was", F.lag("active", 1, False).over(nth)).where("active != was")
    spans = changes.select("list", "pattern", "active", F.col("day").alias("valid_from"), F.lead("day").over(nth).alias("valid_to"))
    return spans.where("active").drop("active")


def patterns_of(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(captures: DataFrame, entries: DataFrame, lists: Sequence[str] = LISTS) -> DataFrame:
    """captures: (page_id, url, day). Returns page_id, host, day, n_active, list,
    pattern, valid_from and blocked for each."""
    own = captures.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "day")
    pairs = own.where((F.col("host") != "") & F.col("day").isNotNull()).select("host", "day").distinct()
    asked = pairs.select("host", "day", F.explode(patterns_of(F.col("host"))).alias("pattern"))
    spans = validity(entries).withColumnRenamed("pattern", "p")
    active = (F.col("pattern") == F.col("p")) & (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, lists)), F.col("list")), F.lit(0))
    rank = F.struct(
        F.length("pattern").alias("length"),
        (-F.when(order > 0, order).otherwise(len(lists) + 1)).alias("order"),
        "list", "pattern", "valid_from",
    )
    verdicts = asked.join(spans, active).groupBy("host", "day").agg(F.count("*").alias("n_active"), F.max(rank).alias("v"))
    verdicts = verdicts.select(F.col("host").alias("h"), F.col("day").alias("d"), "n_active", "v.list", "v.pattern", "v.valid_from")
    return own.join(verdicts, (F.col("host") == F.col("h")) & (F.col("day") == F.col("d")), "left").select(
        "page_id", "host", "day", F.coalesce("n_active", F.lit(0)).alias("n_active"), "list", "pattern", "valid_from",
        F.coalesce(F.col("list") == "block", F.lit(False)).alias("blocked"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch time: a day of 2024 follows from page_id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.pmod(F.col("page_id"), F.lit(366)) * 37, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("day"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Dated changes of two lists, derived from the hosts of `pages` and their
    parent domains: the name's md5 decides on the list and the days."""
    host = pages.select(host_of(F.col("url")).alias("host")).where("host != ''").distinct()
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    names = host.select("host").union(host.where(F.col("host").rlike(r"^[^.]+\.[^.]+\.")).select(parent)).distinct()
    h = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 8), 16, 10).cast("long")

    def change(name: str, action: str, day: Column, when: Column) -> Column:
        on = F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int"))
        return F.when(when, F.struct(F.lit(name).alias("list"), on.alias("day"), F.lit(action).alias("action")))

    changes = F.array_compact(
        F.array(
            change("block", "add", h % 150, h % 3 == 0),
            change("block", "remove", 150 + h % 100, h % 3 == 0),
            change("block", "add", 260 + h % 50, h % 6 == 0),
            change("allow", "add", 100 + h % 60, h % 4 == 0),
            change("allow", "remove", 200 + h % 150, h % 4 == 0),
            change("block", "add", F.lit(50), h % 12 == 5),
            change("block", "remove", F.lit(50), h % 12 == 5),
        )
    )
    return names.select(F.col("host").alias("pattern"), F.inline(changes))


#: The same in DuckDB's SQL.
JUDGE_SQL = r"""
WITH own AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 366 * 37 % 366 AS INTEGER) AS DATE) AS day,
         regexp_replace(regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''),
                        '\.?(:[0-9]*)?$', '') AS host
  FROM pages
), names AS (
  SELECT host AS pattern FROM own WHERE host != ''
  UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM own WHERE regexp_matches(host, '^[^.]+\.[^.]+\.')
), hashed AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 8) AS BIGINT) AS h FROM names
), entries AS (
  SELECT pattern, 'block' AS list, h % 150 AS n, 'add' AS action FROM hashed WHERE h % 3 = 0
  UNION ALL SELECT pattern, 'block', 150 + h % 100, 'remove' FROM hashed WHERE h % 3 = 0
  UNION ALL SELECT pattern, 'block', 260 + h % 50, 'add' FROM hashed WHERE h % 6 = 0
  UNION ALL SELECT pattern, 'allow', 100 + h % 60, 'add' FROM hashed WHERE h % 4 = 0
  UNION ALL SELECT pattern, 'allow', 200 + h % 150, 'remove' FROM hashed WHERE h % 4 = 0
  UNION ALL SELECT pattern, 'block', 50, 'add' FROM hashed WHERE h % 12 = 5
  UNION ALL SELECT pattern, 'block', 50, 'remove' FROM hashed WHERE h % 12 = 5
), states AS (
  SELECT list, pattern, CAST(DATE '2024-01-01' + CAST(n AS INTEGER) AS DATE) AS day, bool_and(action = 'add') AS active
  FROM entries GROUP BY list, pattern, n
), latest AS (
  -- the state on a day is that of the latest change up to it
  SELECT o.host, o.day, s.list, s.pattern, s.active, s.day AS since,
         row_number() OVER (PARTITION BY o.host, o.day, s.list, s.pattern ORDER BY s.day DESC) AS back
  FROM (SELECT DISTINCT host, day FROM own WHERE host != '' AND day IS NOT NULL) o
  JOIN states s ON s.day <= o.day AND (o.host = s.pattern OR ends_with(o.host, '.' || s.pattern))
), active AS (
  SELECT a.*, (SELECT min(x.day) FROM states x WHERE x.list = a.list AND x.pattern = a.pattern AND x.active AND x.day <= a.since
      AND NOT EXISTS (SELECT 1 FROM states y WHERE y.list = a.list AND y.pattern = a.pattern AND NOT y.active AND y.day > x.day AND y.day <= a.since)) AS valid_from
  FROM latest a WHERE back = 1 AND active
), best AS (
  SELECT *, count(*) OVER (PARTITION BY host, day) AS n_active,
         row_number() OVER (PARTITION BY host, day ORDER BY length(pattern) DESC, list) AS r
  FROM active
)
SELECT o.page_id, o.host, o.day, coalesce(b.n_active, 0) AS n_active, b.list, b.pattern, b.valid_from, coalesce(b.list = 'block', false) AS blocked
FROM own o LEFT JOIN best b ON b.host = o.host AND b.day = o.day AND b.r = 1
"""
