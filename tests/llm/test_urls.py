import datetime as dt

from pyspark.sql import functions as F

from siltstone.llm import url_filter

DAY = dt.datetime(2024, 1, 1)


def at(n):
    return DAY + dt.timedelta(days=n)


ENTRIES = [
    ("a", "block", "bad.example", "add", at(10)), ("a", "block", "bad.example", "remove", at(20)), ("a", "block", "bad.example", "add", at(30)),
    ("b", "block", "ok.example/x/y", "add", at(0)), ("w", "allow", "fine.bad.example", "add", at(0)), ("c", "block", "tie.example", "add", at(5)),
    ("c", "block", "tie.example", "remove", at(5)), ("d", "block", None, "add", at(0)), ("d", "block", "late.example", "add", None),
]
CASES = [
    (1, "http://bad.example/", 9, False), (2, "http://bad.example/", 10, True), (3, "http://BAD.example:80/p", 19, True), (4, "http://bad.example", 20, False),
    (5, "https://u@sub.bad.example./q", 31, True), (6, "http://fine.bad.example/z", 31, False), (7, "http://notbad.example/", 31, False),
    (8, "http://ok.example/x/y/z", 1, True), (9, "http://ok.example/x/yy", 1, False), (10, "http://sub.ok.example/x/y?q", 1, True), (11, "http://tie.example/", 6, False),
    (12, None, 1, False), (13, "not a url", 1, False), (14, "http://bad.example/", None, False), (15, "", 1, False), (16, "http:///x", 12, False),
]


def frames(spark, cases):
    captures = spark.createDataFrame([(i, u, None if d is None else at(d)) for i, u, d, _ in cases], "capture_id long, url string, fetched_at timestamp_ntz").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, key string, action string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))
    return captures.withColumn("key", F.lit("clash")).withColumns({c: F.lit(0) for c in ("valid_to", "top", "of_url", "n_lists")}), entries


def test_verdicts(spark):
    out = url_filter.filtered(*frames(spark, CASES + CASES[:1])).collect()
    assert len(out) == len(CASES) + 1
    want = {i: b for i, _, _, b in CASES}
    assert {r.capture_id: r.blocked for r in out} == want


def test_empty(spark):
    captures, entries = frames(spark, CASES)
    assert url_filter.filtered(captures.limit(0), entries).count() == 0
    assert url_filter.filtered(captures, entries.limit(0)).where("blocked").count() == 0


def test_long_histories_and_urls(spark):
    """Every capture against each entry by itself, with many entries on one key and a very long URL."""
    entries = [("a", "block", "hot.example", "add" if i % 2 == 0 else "remove", at(3 * i)) for i in range(200)] + [("b", "block", "old.example", "add", at(-4000))]
    captures = [(i, "http://hot.example/" + "p/" * (i % 50), at(i)) for i in range(700)] + [(1000, "http://hot.example/" + "x" * 200_000, at(1)), (1001, "http://old.example", at(100))]
    frame = spark.createDataFrame(captures, "capture_id long, url string, fetched_at timestamp_ntz").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    listed = spark.createDataFrame(entries, "list string, kind string, key string, action string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.capture_id: r.blocked for r in url_filter.filtered(frame, listed).collect()}

    def blocked(t):
        past = [e for e in entries if e[2] == "hot.example" and e[4] <= t]
        return bool(past) and max(past, key=lambda e: e[4])[3] == "add"

    assert got == {**{i: blocked(t) for i, _, t in captures[:-1]}, 1001: True}
