"""Deltas of a content table that grows as a stream: each micro-batch against the current snapshot.

A stream of (path, content), content null for a removed file, keeps a snapshot up to date. Every micro-batch
keeps the last row of each path, takes the delta against the snapshot's rows of the same paths, and writes it to the change log under
the batch's number; a batch that is run again replaces what it wrote before, so the log holds each change once. A whole
snapshot is written with every EVERY-th batch only; the state after any other is the last one with the changes since.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone import schema as S
from siltstone.operators import delta as D
from siltstone.operators import snapshot

SNAPSHOT = "path string, data_size long, hash string"
#: Batches from one written snapshot to the next.
EVERY = 16


def snapshot_at(spark: SparkSession, folder: str, batch: int, every: int = EVERY) -> DataFrame:
    """The snapshot after a batch; empty before the first."""
    written = (batch + 1) // every * every - 1
    held = spark.read.schema(SNAPSHOT).parquet(f"{folder}/snapshots/batch={written}") if written >= 0 else spark.createDataFrame([], SNAPSHOT)
    since = [spark.read.schema(S.DELTA).parquet(f"{folder}/changes/batch={i}").withColumn("batch", F.lit(i)) for i in range(written + 1, batch + 1)]
    if not since:
        return held
    last = reduce(DataFrame.unionByName, since).groupBy("path").agg(F.max_by(F.struct("status", "data_size", "hash"), "batch").alias("last"))
    kept = held.join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.where(F.col("last.status") != S.DELETED).select("path", "last.data_size", "last.hash"))


def _merge(folder: str, every: int):
    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = rows.groupBy("path").agg(F.max_by("content", "seq").alias("content"))
        fresh = snapshot.index(last.where("content is not null").select("path", "content"))
        touched = snapshot_at(spark, folder, batch - 1, every).join(last.select("path"), "path", "left_semi")
        D.delta(touched, fresh).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")
        if (batch + 1) % every == 0:  # from the changes just written and the snapshot before
            before = snapshot_at(spark, folder, batch - 1, every)
            changes = spark.read.schema(S.DELTA).parquet(f"{folder}/changes/batch={batch}")
            after = before.join(changes.select("path"), "path", "left_anti").unionByName(changes.where(F.col("status") != S.DELETED).select("path", "data_size", "hash"))
            after.write.mode("overwrite").parquet(f"{folder}/snapshots/batch={batch}")

    return run


def keep_snapshot(stream: DataFrame, folder: str, every: int = EVERY, **trigger) -> StreamingQuery:
    """Start the query for a stream of (path, content, seq), seq giving the order of a path's rows."""
    return stream.writeStream.foreachBatch(_merge(folder, every)).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()
