"""Mixing sources to target weights.

One pass over the texts gives each source its words. The targets come from the weights by
filling up to a cap of `max_rate` times a source's words, the excess going to the others by
weight. A document is emitted floor(rate) times, and once more with the rate's fraction as
probability, by a draw from its own values, so that reruns and other partitionings agree. Each document has a
draw for each of SEEDS seeds, and each source takes the seed with which its words come nearest to its target; all
sources' sums for all seeds come from one aggregation of narrow rows.

Nulls: a null text has no words; a null source is a source of its own, last in order. Equal rows
share one draw. An empty table gives an empty result. Only the named columns of the input are
used, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import staged, table, word_count

CYCLE = (1.0, 2.0, 3.0)
SEEDS, DRAW_BITS = 64, 28
DRAWS = 1 << DRAW_BITS


def cycle_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, 1, 2, 3, ... by the rank of a source, which starts at 1."""
    return F.element_at(F.array(*map(F.lit, CYCLE)), (F.pmod(rank - 1, F.lit(len(CYCLE))) + 1).cast("int"))


def source_targets(per_source: DataFrame, share: float = 1.0, max_rate: float = 3.0, weight=cycle_weight) -> DataFrame:
    """(source, source_size) -> (source, source_size, target, rate).

    Works on one row for each source. By ascending cap over weight, a source is capped just if
    the level that remains for it and all later ones reaches its cap; the first source that is
    not capped sets the level of all later ones.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(max_rate))
    used = {c: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "weight")}
    level = (F.col("total") - used["cap"]) / (F.sum("weight").over(everything) - used["weight"])
    return (
        per_source.select("source", "source_size")
        .withColumn("weight", weight(F.row_number().over(by_name)))
        .withColumn("cap", cap)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", level)
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("open_level", F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open_level") * F.col("weight")))
        .withColumn("target", F.least("target", "cap"))
        .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(0.0).alias("rate"))
    )


def drawn(seed: int, doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two numbers below DRAWS that depend on the seed, the doc_id and the text alone: the draw of a seed j is first + j * second, modulo DRAWS."""
    named = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    first, second = (F.conv(F.substring(named, at, DRAW_BITS // 4), 16, 10).cast("long") for at in (1, 9))
    return first.alias("first"), second.alias("second")


def _fraction(rate: Column) -> Column:
    return (rate - F.floor(rate)) * F.lit(float(DRAWS))


def _copied(j: Column, rate: Column) -> Column:
    """Whether the draw of the seed j gives one more copy."""
    return (F.col("first") + j * F.col("second")).bitwiseAND(F.lit(DRAWS - 1)) < _fraction(rate)


def copies(j: Column, rate: Column) -> Column:
    """floor(rate) copies, and one more with probability rate - floor(rate), by the draw of the seed j."""
    return (F.floor(rate) + F.when(_copied(j, rate), 1).otherwise(0)).cast("int")


def _targets(sized: DataFrame, share: float, max_rate: float, weight) -> DataFrame:
    """(source, size, first, second) -> (of_source, source_size, target, rate, seed)."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(per_source, share, max_rate, weight).withColumnRenamed("source", "of_source"), "mix-targets")
    rated = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    sums = rated.groupBy("source").agg(*(F.sum(F.when(_copied(F.lit(j), F.col("rate")), F.col("size")).otherwise(0)).alias(f"more_{j}") for j in range(SEEDS)))
    off = F.array(*(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"more_{j}") - F.col("target")) for j in range(SEEDS)))
    found = sums.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("off", off)
    return staged(found.select("of_source", "source_size", "target", "rate", (F.array_position("off", F.array_min("off")) - 1).alias("seed")), "mix-sources")


def _sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    return staged(docs.select(*more, "source", word_count(F.col("text")).alias("size"), *drawn(seed, F.col("doc_id"), F.col("text"))), "mix-sizes")


def mix_plan(docs: DataFrame, seed: int = 20, share: float = 1.0, max_rate: float = 3.0, weight=cycle_weight) -> DataFrame:
    """documents -> (doc_id, source, size, source_size, target, rate, copies, taken)."""
    sized = _sized(docs, seed, "doc_id")
    return (
        sized.join(_targets(sized, share, max_rate, weight), F.col("source").eqNullSafe(F.col("of_source")), "left")
        .withColumn("copies", copies(F.col("seed"), F.col("rate")))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(docs: DataFrame, seed: int = 20, share: float = 1.0, max_rate: float = 3.0, weight=cycle_weight) -> DataFrame:
    """The documents of the mixture, each as often as the plan takes it, with their columns.

    The texts are not shuffled as long as the table of sources is small enough to broadcast.
    """
    targets = _targets(_sized(docs, seed), share, max_rate, weight).select("of_source", "rate", "seed")
    held = docs.select(F.struct(*docs.columns).alias("doc"), *drawn(seed, F.col("doc_id"), F.col("text")))
    return (
        held.join(targets, F.col("doc.source").eqNullSafe(F.col("of_source")), "left")
        .withColumn("copies", copies(F.col("seed"), F.col("rate")))
        .where("copies > 0")
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc.*")
    )


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


_DRAWN = "md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')))"
_COPIED = f"CAST((a + {{j}} * b) % {DRAWS} AS DOUBLE) < (rate - floor(rate)) * {DRAWS}.0::DOUBLE"
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr({_DRAWN}, 1, 7) AS BIGINT) AS a, CAST('0x' || substr({_DRAWN}, 9, 7) AS BIGINT) AS b FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
        source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(CASE WHEN ratio <= level THEN cap ELSE (SELECT level FROM l WHERE ratio > level ORDER BY ratio, level LIMIT 1) * weight END, cap) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t),
m AS (SELECT u.source, j, any_value(rate) AS rate, any_value(u.source_size) AS source_size, any_value(target) AS target, CAST(sum(CASE WHEN {_COPIED.format(j="j")} THEN size ELSE 0 END) AS BIGINT) AS more
        FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source CROSS JOIN (SELECT unnest(range({SEEDS})) AS j) GROUP BY u.source, j),
c AS (SELECT source, source_size, target, rate, j AS seed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(floor(rate) * source_size + more - target), j) AS turn FROM m) WHERE turn = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN {_COPIED.format(j="seed")} THEN 1 ELSE 0 END) AS BIGINT) AS taken, d.source AS source,
       CAST(floor(rate) + CASE WHEN {_COPIED.format(j="seed")} THEN 1 ELSE 0 END AS INT) AS copies
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
