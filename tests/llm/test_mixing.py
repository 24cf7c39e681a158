from pyspark.sql import functions as F

from siltstone.llm import mixing
from tests.llm.helpers import documents


def fill(sizes, max_rate=3.0):
    """Targets by repeated resharing; sizes in order of source."""
    weights = [float(i % 3 + 1) for i in range(len(sizes))]
    total, capped = float(sum(sizes)), set()
    while True:
        left = total - sum(max_rate * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        targets = [max_rate * s if i in capped else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(targets) if i not in capped and t > max_rate * sizes[i]}
        if not over:
            return targets
        capped |= over


def test_targets_match_resharing(spark):
    for sizes in ([5, 100, 100, 1, 0, 50], [10], [1, 1, 1000], [7, 7, 7, 7], [0, 0]):
        rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        for i, want in enumerate(fill(sizes)):
            assert abs(got[f"s{i}"] - want) < 1e-6, (sizes, got)


def test_plan_on_hard_rows(spark):
    rows = [(1, None, None), (2, "", None), (3, "a b c", None), (None, "x y", "é"), (4, "a b c", "z"), (4, "a b c", "z")]
    docs = documents(spark, rows).withColumn("size", F.lit("clash")).withColumn("draw", F.lit(0))
    out = mixing.mix_plan(docs).collect()
    assert len(out) == len(rows)
    assert {r.source: r.source_size for r in out} == {None: 3, "é": 2, "z": 6}
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_plan(docs.repartition(3)).collect()), key=str)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in out)


def test_taken_words_come_near_targets(spark):
    size = F.when(F.col("id") % 100 == 0, 400).otherwise(F.col("id") % 40 + 1).cast("int")
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").otherwise(F.concat(F.lit("s"), F.col("id") % 7))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), size).alias("text"), source.alias("source"))
    for r in mixing.mix_plan(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.02 * r.target, r


def test_long_texts(spark):
    rows = [(1, "w " * 1_000_000, "a"), (2, "x", "a"), (3, "y z", "b")]
    out = {r.doc_id: r for r in mixing.mix_plan(documents(spark, rows)).collect()}
    assert out[1].size == 1_000_000 and out[3].target == 6.0 and out[3].taken == 6


def test_empty(spark):
    assert mixing.mix_plan(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [])).count() == 0
