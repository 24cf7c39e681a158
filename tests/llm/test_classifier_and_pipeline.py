import math
import os
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import classifier
from tests.llm.helpers import documents, texts


def corpus(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta river stone house light under over".split()) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(30, 80))]
        good = i % 4 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else [words[0]] * 50
        rows.append((i, " ".join(words) + f" only{i}"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_learns_and_never_reads_the_fold(spark):
    rows, labels = corpus()
    docs = documents(spark, rows).withColumn("label", F.lit("clash")).withColumn("turn", F.lit(0))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = classifier.trained(docs, known)
    out = classifier.scored(docs, weights).select("doc_id", classifier.SCORE, classifier.held_out(F.col("doc_id")).alias("held")).collect()
    truth = dict((d, q) for d, q, _ in labels)
    held = [(r[classifier.SCORE], truth[r.doc_id]) for r in out if r.held]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    wrong = known.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(weights, classifier.trained(docs.repartition(3), wrong.repartition(2)))


def plain_features(text, bits):
    """{slot: value}, without numpy."""
    h = [zlib.crc32(w.encode()) for w in classifier.TOKEN.findall(text)]
    pairs = [0x5BD1E995 if a == b else (a * 0x9E3779B1 + b * 0x85EBCA6B) % 2**32 for a, b in zip(h, h[1:])]
    counts = Counter(x >> (32 - bits) for x in h + pairs)
    values = {k: math.log(1 + c) for k, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values())) or 1.0
    return {**{k: v / norm for k, v in values.items()}, 1 << bits: 1.0}


def plain_scores(rows, labels, bits, epochs, alpha=2.0, beta=1.0, l1=0.01, l2=0.05):
    """Scores by FTRL-proximal with dictionaries, rows by the order of their keyed hash."""
    z, n = {}, {}

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= l1 else (math.copysign(l1, a) - a) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    def turn(d):
        h = xxhash.xxh64_intdigest(struct.pack("<q", d), xxhash.xxh64_intdigest(struct.pack("<i", 9), 42))
        return h - (1 << 64) if h >> 63 else h

    texts_of = dict(rows)
    order = sorted((turn(d), d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5)
    ones = sum(q for *_, q in order)
    share = {1: len(order) / (2 * ones), 0: len(order) / (2 * (len(order) - ones))}
    for _ in range(epochs):
        for _, d, y in order:
            x = {k: float(np.float32(v)) for k, v in plain_features(texts_of[d], bits).items()}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * share[y] * v
                more = n.get(k, 0.0) + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(more) - math.sqrt(n.get(k, 0.0))) / alpha * w[k]
                n[k] = more
    return {d: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in plain_features(t, bits).items()))) for d, t in rows}


def test_equals_a_plain_version(spark):
    rows, labels = corpus(120)
    weights = classifier.trained(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits=12, epochs=3)
    got = {r.doc_id: r[classifier.SCORE] for r in classifier.scored(documents(spark, rows), weights, bits=12).collect()}
    want = plain_scores(rows, labels, 12, 3)
    assert max(abs(got[d] - want[d]) for d in want) < 1e-4


def test_hard_rows(spark):
    rows = [*enumerate(texts()), (None, "no id")]
    docs = documents(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 5, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        scores = [r[0] for r in classifier.scored(docs, classifier.trained(docs, labels)).select(classifier.SCORE).collect()]
        assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    assert classifier.scored(documents(spark, []), np.zeros((1 << 18) + 1, "f4")).count() == 0


def test_pipeline(spark, tmp_path):
    rows, labels = corpus(200)
    rows += [(1000 + i, rows[1][1]) for i in range(5)] + [(2000, rows[2][1] + " call +1 (425) 555-9684 now")]
    for name, df in (("documents", documents(spark, rows)), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))):
        pq.write_table(df.toArrow(), tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in docs.collect()]
    assert not {0, 8, 4} & set(kept["quality"])
    assert 1 in kept["near_copies"] and not {1000, 1004} & set(kept["near_copies"])
    assert sorted(kept["personal_data"]) == sorted(kept["near_copies"])
    assert not spark.read.parquet(f"{tmp_path}/personal_data").where("text like '%425) 555-9684%'").count()
    assert set(kept["pack"]) == set(kept["mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["pack"])


def through(spark, folder, docs, labels):
    """The pipeline's stages over docs, each written and read again; the rows kept by stage."""
    for name, df in (("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))):
        pq.write_table(df.toArrow(), folder / f"{name}.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(folder))
        assert name == "pack" or made.columns == docs.columns
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_pipeline_on_hard_rows(spark, tmp_path):
    rows, labels = corpus(80)
    # nulls, empty and blank texts, repeated rows, a very long text, other scripts, rows without a doc_id
    rows += [*((5000 + i, t) for i, t in enumerate(texts())), (5100, rows[1][1]), (5100, rows[1][1]), (None, rows[2][1]), (None, None), (5200, " ".join(f"river{i} stones" for i in range(30_000)))]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    docs = docs.withColumns({c: F.lit("clash") for c in ("score", "label", "node", "root", "rate", "copies", "first", "kind", "range", "start", "__old")})
    kept = through(spark, tmp_path, docs, labels)
    ids = {name: [r.doc_id for r in held] for name, held in kept.items()}
    assert 5100 not in ids["near_copies"] and 1 in ids["near_copies"] and (5200 in ids["near_copies"]) == (5200 in ids["quality"])
    assert sorted(map(str, ids["near_copies"])) == sorted(map(str, ids["personal_data"]))
    assert set(ids["pack"]) == set(ids["mix"])
    # each piece lies in its sequence without a gap
    ends = Counter()
    for r in sorted(kept["pack"], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert not through(spark, tmp_path, documents(spark, []), [])["pack"]


def test_stages_start_with_what_the_driver_freed_given_back(spark):
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"
    if not os.path.exists(status):
        pytest.skip("memory can't be read here")

    def held() -> float:
        with open(status) as lines:
            return next(int(x.split()[1]) / 1024 for x in lines if x.startswith("VmRSS"))

    # freed memory of the C library below a block that stays
    taken = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    for x in taken[:-1]:
        x.end()
    for _ in range(3):
        jvm.System.gc()
        time.sleep(0.5)
    before = held()
    stage = dict(corpus_pipeline.STAGES)["personal_data"]
    assert stage(spark, documents(spark, [(1, "a")]), "").columns[0] == "doc_id"
    after = held()
    taken[-1].end()
    assert after < before - 30
