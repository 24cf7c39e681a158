"""URL filters: dated list entries as validity intervals, and an as-of join of captures with them.

An entry is a list, a key (a domain, or a domain with the start of a path), an action and its
time. For each list and key the entries become intervals that do not overlap: an addition
holds until the key's next entry. A capture is matched under every suffix of its host, alone and with
every start of its path as deep as any listed key, as of its fetch time: intervals are cut at the bounds of spans of
BUCKET_DAYS days, and captures meet by key and span only what holds in their span, so a key with a long history is
never paired with all of it. Only the time from the first to the last capture is cut. Of a list and key at most one
interval holds. The longest matching key decides; of equal keys an allowing list wins.

Verdicts are computed once for each distinct (url, fetch time), so copies of a hot URL are gathered
before the join. The intervals are a written table: the planner broadcasts them only if they are
small by measure, and else shuffles both sides, splitting a hot host's partition.

Nulls: a capture without a usable host or fetch time matches nothing and is not blocked. An entry with
a null field is ignored; of several actions on a key at one time, removal counts last. Repeated
captures each keep their row. Empty captures give no rows; with empty lists nothing is blocked.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import staged, table


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or final dots; null if there is none."""
    host = F.regexp_extract(F.trim(url), r"^(?i:https?|ftp)://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query and fragment, without its slash at the start."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z]+://[^/?#]*/([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, action, at) -> (list, kind, key, valid_from, valid_to), valid_to null if open."""
    clean = entries.where("list is not null and kind is not null and key is not null and action in ('add', 'remove') and at is not null")
    clean = clean.select("list", "kind", F.regexp_replace(F.lower("key"), "/+$", "").alias("key"), "at", "action").groupBy("list", "kind", "key", "at").agg(F.max("action").alias("action"))
    later = Window.partitionBy("list", "kind", "key").orderBy("at")
    return clean.withColumn("valid_to", F.lead("at").over(later)).where("action = 'add'").select("list", "kind", "key", F.col("at").alias("valid_from"), "valid_to")


#: Days of a span.
BUCKET_DAYS = 32


def span_of(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / (BUCKET_DAYS * 86400)).cast("long")


def keys(host: Column, path: Column, depth: int) -> Column:
    """Every suffix of a host, alone and with each start of the path of at most depth parts."""
    labels, parts = F.split(host, r"\."), F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, max(depth, 1))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if not depth:
        return suffixes
    starts = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.concat(F.array(F.lit("")), F.slice(parts, F.lit(1), n)), "/"))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture_id, url, fetched_at) -> also host, n_lists, list, key, kind, blocked."""
    captures, valid = captures.select("capture_id", "url", "fetched_at"), staged(intervals(entries), "url-intervals")
    depth = valid.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    distinct = captures.select("url", "fetched_at").where("url is not null and fetched_at is not null").distinct()
    first, last = distinct.agg(F.min(span_of(F.col("fetched_at"))), F.max(span_of(F.col("fetched_at")))).first()
    begins, ends = F.greatest(span_of(F.col("valid_from")), F.lit(first).cast("long")), F.least(F.coalesce(span_of(F.col("valid_to")), F.lit(last).cast("long")), F.lit(last).cast("long"))
    held = staged(valid.withColumn("begins", begins).withColumn("ends", ends).where("begins <= ends").withColumn("span", F.explode(F.sequence("begins", "ends"))).drop("begins", "ends"), "url-spans")
    asked = distinct.withColumn("key", F.explode(keys(host_of(F.col("url")), path_of(F.col("url")), depth))).withColumn("span", span_of(F.col("fetched_at")))
    active = asked.join(held, ["key", "span"]).where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    rank = F.struct(F.length("key").alias("n"), (F.col("kind") == "allow").alias("allows"), F.col("list"), F.col("key"), F.col("kind"))
    verdict = active.groupBy(F.col("url").alias("of_url"), F.col("fetched_at").alias("of_time")).agg(F.countDistinct("list").alias("n_lists"), F.max(rank).alias("top"))
    found = captures.join(verdict, (F.col("url") == F.col("of_url")) & (F.col("fetched_at") == F.col("of_time")), "left")
    return found.select(
        "capture_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.coalesce("n_lists", F.lit(0)).alias("n_lists"),
        F.col("top.list").alias("list"), F.col("top.key").alias("key"), F.col("top.kind").alias("kind"), F.coalesce(F.col("top.kind") == "block", F.lit(False)).alias("blocked"),
    )


# --- the query: `pages` has no fetch times and comes with no lists, so both follow from rules ---

#: Entries of a curated list.
CURATED = [
    ("curated", "block", "spam-farm.example.org", "add", "2024-02-01 00:00:00"),
    ("curated", "block", "cheap-pills.example.com", "add", "2024-01-15 00:00:00"),
    ("curated", "block", "cheap-pills.example.com", "remove", "2024-06-01 00:00:00"),
    ("curated", "block", "cheap-pills.example.com", "add", "2024-09-01 00:00:00"),
    ("curated", "block", "example.net/de", "add", "2024-03-01 00:00:00"),
    ("curated", "block", "example.net/de", "remove", "2024-10-01 00:00:00"),
    ("exceptions", "allow", "m.example.net", "add", "2024-01-01 00:00:00"),
    ("exceptions", "allow", "www.cheap-pills.example.com", "add", "2024-10-15 00:00:00"),
]


def _drawn(x: Column, salt: str) -> Column:
    """A number from 0 to 2**24 - 1 from a text."""
    return F.conv(F.substring(F.md5(F.concat(x, F.lit(salt))), 1, 6), 16, 10).cast("long")


def _day(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + n * 86400)


def derived_entries(pages: DataFrame) -> DataFrame:
    """One host in ten is listed from some day of 2024 for thirty to ninety days; one in forty again later."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    d = hosts.select("key", _drawn(F.col("key"), "a").alias("a"), _drawn(F.col("key"), "b").alias("b")).where("a % 10 = 0")
    first = F.col("b") % 200
    until = first + 30 + F.col("b") % 61
    events = F.array(
        F.struct(F.lit("add").alias("action"), _day(first).alias("at")),
        F.struct(F.lit("remove").alias("action"), _day(until).alias("at")),
        F.when(F.col("a") % 40 == 0, F.struct(F.lit("add").alias("action"), _day(until + 20).alias("at"))),
    )
    return d.select("key", F.explode(events).alias("e")).select(F.lit("daily").alias("list"), F.lit("block").alias("kind"), "key", "e.action", "e.at")


def captures_of(pages: DataFrame) -> DataFrame:
    at = _day(_drawn(F.concat(F.col("page_id").cast("string"), F.lit("|"), F.col("url")), "t") % 366)
    return pages.select(F.col("page_id").alias("capture_id"), "url", at.alias("fetched_at"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    curated = spark.createDataFrame(CURATED, "list string, kind string, key string, action string, at string").withColumn("at", F.to_timestamp("at"))
    out = filtered(captures_of(pages), curated.unionByName(derived_entries(pages)))
    return out.select(F.col("capture_id").alias("page_id"), "url", F.unix_timestamp("fetched_at").alias("fetched_s"), "host", "n_lists", "list", "key", "kind", "blocked")


def _sql() -> str:
    host = r"nullif(regexp_replace(lower(regexp_extract(trim(url), '^(?i:https?|ftp)://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '')"
    drawn = "CAST('0x' || substr(md5({}), 1, 6) AS BIGINT)"
    curated = ", ".join(f"('{a}', '{b}', '{c}', '{d}', CAST(epoch(TIMESTAMP '{e}') AS BIGINT))" for a, b, c, d, e in CURATED)
    return rf"""
WITH cap AS (SELECT page_id, url, {host} AS host, regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*/([^?#]*)', 1) AS path,
        1704067200 + ({drawn.format("page_id || '|' || url || 't'")} % 366) * 86400 AS t FROM pages),
h AS (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL),
d AS (SELECT host, {drawn.format("host || 'a'")} AS a, {drawn.format("host || 'b'")} AS b FROM h),
e AS (SELECT * FROM (VALUES {curated}) v(list, kind, key, action, since)
  UNION ALL SELECT 'daily', 'block', host, 'add', 1704067200 + (b % 200) * 86400 FROM d WHERE a % 10 = 0
  UNION ALL SELECT 'daily', 'block', host, 'remove', 1704067200 + (b % 200 + 30 + b % 61) * 86400 FROM d WHERE a % 10 = 0
  UNION ALL SELECT 'daily', 'block', host, 'add', 1704067200 + (b % 200 + 50 + b % 61) * 86400 FROM d WHERE a % 40 = 0),
iv AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, kind, key ORDER BY since) AS until FROM e) WHERE action = 'add'),
hit AS (SELECT page_id, url, t, list, kind, key FROM cap JOIN iv ON t >= since AND (until IS NULL OR t < until)
        AND ('.' || host || '/' || path || '/') LIKE ('%.' || split_part(key, '/', 1) || '/%')
        AND CASE WHEN contains(key, '/') THEN ends_with('.' || host, '.' || split_part(key, '/', 1)) AND split_part(path, '/', 1) = split_part(key, '/', 2)
            ELSE ends_with('.' || host, '.' || key) END),
top AS (SELECT page_id, count(DISTINCT list) AS n, max(struct_pack(n := length(key), allows := kind = 'allow', list := list, key := key, kind := kind)) AS top FROM hit GROUP BY page_id)
SELECT cap.page_id, cap.url, CAST(t AS BIGINT) AS fetched_s, host, CAST(coalesce(n, 0) AS BIGINT) AS n_lists, top.top.list AS list, top.top.key AS key, top.top.kind AS kind,
       coalesce(top.top.kind = 'block', false) AS blocked FROM cap LEFT JOIN top USING (page_id)
"""


SQL = _sql()
