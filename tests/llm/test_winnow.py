import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from siltstone.llm import winnow
from tests.llm.helpers import documents, texts

ONES = (1 << 64) - 1


def rolled(run):
    """Hash of the first half, rotated by its length, xor that of the second; of eight code points XXH64."""
    if len(run) == winnow.BASE:
        return xxhash.xxh64_intdigest(run.encode(), 42)
    m = len(run) // 2
    h = rolled(run[:m])
    return (h << m & ONES | h >> (64 - m)) ^ rolled(run[m:])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(text, k=winnow.K, w=winnow.W):
    """Set of (hash, place), by all windows."""
    if not text:
        return set()
    grams = [rolled(text[i : i + k]) for i in range(len(text) - k + 1)] or [xxhash.xxh64_intdigest(text.encode(), 42)]
    out = set()
    for s in range(1 - w, len(grams)):
        window = range(max(0, s), min(len(grams), s + w))
        out.add(min(window, key=lambda i: (signed(grams[i]) >> 31, -i)))
    return {(grams[i] & ((1 << 48) - 1), i) for i in out}


def parsed(s):
    found = [tuple(int(p, 16) for p in x.split(".")) for x in s.split()]
    assert len(found) == len(set(found))
    return set(found)


def near(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def signed_hash(t):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]


def test_equals_brute_force(spark):
    some = ["The quick brown fox jumps over the lazy dog. " * 30, "x" * 300, "ab" * 40, "漢字仮名" * 30 + "😀" * 20, "abcdefghijklmnop", "abcdefghijklmno"]
    rows = [*((i, t) for i, t in enumerate([t for t in texts() if t is None or len(t) < 5000])), *((40 + i, t) for i, t in enumerate(some)), (41, "That it."), (12, "tie one"), (12, "tie two"), (None, "null id"), (None, "another null id"), (None, None), (99, "ab")]
    docs = documents(spark, rows).withColumn("range", F.lit("clash")).withColumn("guest", F.lit(1)).withColumn("h", F.lit(2)).withColumn("own", F.lit(3))
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, x[0] or 0, signed_hash(x[1])))
    for range_bytes in (4 << 20, 100):
        out = winnow.fingerprinted(docs, range_bytes=range_bytes)
        got = out.select("doc_id", "n_chars", "edited_sha256", winnow.as_text(F.col("own")).alias("own"), winnow.as_text(F.col("other")).alias("other"), winnow.likeness(F.col("own_set"), F.col("other_set")).alias("ne"), winnow.likeness(F.col("own_set"), F.col("next_set")).alias("nn")).collect()
        assert len(got) == len(rows)
        for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
            q = len(t) // 4
            edited = t[: len(t) - q] + following[:q]
            sha = hashlib.sha256(edited.encode()).hexdigest()
            own, other, after = plain(t), plain(edited), plain(following)
            row = next(r for r in got if r[0] == d and r[2] == sha and r[1] == len(t) and abs(r[6] - near(own, after)) < 1e-9)
            assert parsed(row[3]) == own and parsed(row[4]) == other, (d, t[:50])
            assert abs(row[5] - near(own, other)) < 1e-9


def test_shared_runs_are_found_wherever_they_lie(spark):
    rng = random.Random(8)
    signs = ["abcdefghijklmnopqrstuvwxyz", "漢字仮名交文書日本語中国韓", "abc de", "ab"]
    rows, pairs = [], []
    for i in range(60):
        of = signs[i % len(signs)]
        run = "".join(rng.choices(of, k=winnow.K + winnow.W - 1))
        for _ in range(2):
            rows.append((len(rows), "".join(rng.choices(of.upper() + "é", k=rng.randint(0, 70))) + run + "".join(rng.choices(of.upper() + "ß", k=rng.randint(0, 70)))))
        pairs.append((len(rows) - 2, len(rows) - 1))
    docs = documents(spark, rows)
    found = {r[0]: set(r[1]) for r in docs.select("doc_id", winnow.hashes(winnow.fingerprint(F.col("text")))).collect()}
    assert all(found[a] & found[b] for a, b in pairs)
    # one character in front moves nothing but places
    long = "".join(rng.choices(signs[1], k=600))
    a, b = (set(r[0]) for r in documents(spark, [(1, long), (2, "x" + long)]).orderBy("doc_id").select(winnow.hashes(winnow.fingerprint(F.col("text")))).collect())
    assert len(a & b) > 0.8 * len(a | b)


def test_long_texts_and_many_nulls(spark):
    long = " ".join(str(i * 7919 % 10007) for i in range(200_000))
    rows = [(1, long), *((None, f"null {i}") for i in range(300))]
    out = winnow.fingerprinted(documents(spark, rows), range_bytes=1000).select("doc_id", "n_chars", F.size("own").alias("n"), F.array_max(F.transform("own", lambda x: x["place"])).alias("last")).collect()
    assert len(out) == 301
    r = next(r for r in out if r.doc_id == 1)
    assert r.n_chars == len(long) and r.n > len(long) / winnow.W and r["last"] == len(long) - winnow.K


def test_empty_and_alone(spark):
    assert winnow.fingerprinted(documents(spark, [])).count() == 0
    one = winnow.fingerprinted(documents(spark, [(1, "alone here")])).collect()
    assert len(one) == 1


def test_ranges_are_even(spark):
    docs = spark.range(4000).select((F.col("id") * 1000 + 7).alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    counts = [r[1] for r in winnow.with_next(docs, range_bytes=20_000).where("not guest").groupBy("range").count().collect()]
    assert 15 <= len(counts) <= 21 and max(counts) < 500
