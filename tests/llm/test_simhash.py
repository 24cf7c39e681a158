import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import simhash
from tests.llm.helpers import documents, texts


def plain(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(3)
    for t in [*texts(), *(" ".join(rng.choices(["A", "b", "Ç", "dé ", "e\t", "\n"], k=rng.randint(0, 40))) for _ in range(100))]:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain(t), repr(t)


def reach(values, radius=4):
    """Least index reachable for each value, by all pairs."""
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(values))]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    values = [0, (1 << 64) - 1]
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.append(x)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
    values = list(dict.fromkeys(values))
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    stars = {r.fp: r.root for r in simhash.close_classes(fps, bucket_rows=1 << 12).collect()}
    got = [stars[v] for v in signed]
    want = reach(values)
    groups = {}
    for g, w in zip(got, want):
        assert groups.setdefault(w, g) == g
    assert len(set(groups.values())) == len(groups)


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1200)}}


def test_hubs(spark):
    edges = [(0, i) for i in range(1, 6001)] + [(7000, i) for i in range(5990, 6001)] + [(9000, i) for i in range(9001, 14500)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(1, 6001), 7000]}, **{i: 9000 for i in range(9001, 14500)}}


def test_stars_and_trees_agree(spark, monkeypatch):
    """Star rounds alone, rounds that leave the rest to one task, and that task alone."""
    rng = random.Random(9)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(400)] + [(2000, i) for i in range(2001, 3500)] + [(5, 5), (1, 2), (2, 1)]
    got = []
    for held in (-1, 1700, 1 << 19):
        monkeypatch.setattr(simhash, "HELD", held)
        got.append({r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()})
    assert got[0] == got[1] == got[2]
    least = {}
    for x in {x for e in edges for x in e}:
        least.setdefault(got[0].get(x, x), set()).add(x)
    assert all(min(nodes) == root for root, nodes in least.items())
    assert all(got[0].get(a, a) == got[0].get(b, b) for a, b in edges)


def test_contracted_by_broadcast_and_by_key(spark, monkeypatch):
    named = spark.createDataFrame([(i, i % 40) for i in range(3000)], "fp long, root long")
    stars = spark.createDataFrame([(i, i % 7) for i in range(7, 40, 2)], "node long, root long")
    want = {(i, (i % 40) % 7 if i % 40 in range(7, 40, 2) else i % 40) for i in range(3000)}
    for most in (simhash.MOST_HEAVY, 3):
        monkeypatch.setattr(simhash, "MOST_HEAVY", most)
        assert set(map(tuple, simhash._contracted(named, stars, 3000).collect())) == want


def test_few_links_take_few_jobs(spark):
    """A chain took dozens of jobs in star rounds, each with all partitions of a shuffle."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "components")
    try:
        assert simhash.components(edges).count() == 300
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_parities_deal_every_variant_once():
    masks = simhash.flips(4)
    x = np.uint64(0x0123456789ABCDEF)
    assert (simhash.parities(masks ^ x) == simhash.parities(masks) ^ simhash.parities(np.array([x]))).all()
    assert sorted(i for p in simhash.PASSES for i in p) == list(range(64))


def test_classes_on_hard_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [*enumerate(texts()), (100, base), (101, base), (102, base.replace("w399", "other")), (None, base), (None, "alone one"), (7, base[::-1]), (7, base[::-1])]
    docs = documents(spark, rows).withColumn("fp", F.lit("clash")).withColumns({c: F.lit(1) for c in ("root", "gone_id", "a", "node")})
    out = simhash.classes(docs).collect()
    assert len(out) == len(rows)
    fps = [plain(t) for _, t in rows]
    want = {}
    for (d, _), r in zip(rows, reach(fps)):
        if d is not None:
            want[r] = min(want.get(r, d), d)
    expected = sorted(((d, int(np.uint64(f).astype(np.int64)), want.get(r)) for (d, _), f, r in zip(rows, fps, reach(fps))), key=str)
    assert sorted(map(tuple, out), key=str) == expected
    kept = simhash.kept_ones(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and 101 not in ids and 102 not in ids


def test_empty(spark):
    assert simhash.classes(documents(spark, [])).count() == 0
