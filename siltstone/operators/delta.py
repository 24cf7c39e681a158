"""The delta of two snapshots: a full outer join on path, rows of equal hash left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema as S


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _offset(df: DataFrame) -> DataFrame:
    return df if "data_offset" in df.columns else df.withColumn("data_offset", F.lit(0).cast("long"))


def _rows(joined: DataFrame) -> DataFrame:
    gone, fresh = F.col("n_path").isNull(), F.col("o_path").isNull()
    return joined.select(
        F.coalesce("n_path", "o_path").alias("path"),
        F.when(gone, S.DELETED).when(fresh, S.ADDED).otherwise(S.UPDATED).alias("status"),
        F.when(gone, 0).otherwise(F.col("n_data_offset")).cast("long").alias("new_offset"),
        F.when(gone, 0).otherwise(F.col("n_data_size")).cast("long").alias("data_size"),
        F.col("n_hash").alias("hash"),
    )


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots of unique paths -> rows of schema.DELTA, unordered. One shuffle of each side.

    A null hash (of a null content) equals only another null one; a null path meets no other.
    """
    o = _side(old.select("path", "hash"), "o_")
    n = _side(_offset(new).select("path", "hash", "data_offset", "data_size"), "n_")
    joined = o.join(n, F.col("o_path") == F.col("n_path"), "full_outer")
    return _rows(joined.where("o_path is null or n_path is null or not (o_hash <=> n_hash)"))


def delta_of_repeated(old: DataFrame, new: DataFrame) -> DataFrame:
    """As delta, for snapshots that repeat paths: old rows meet the new side's first, further new rows are ADDED."""
    first = Window.partitionBy("path").orderBy("entry_idx")
    ranked = _offset(new).withColumn("rank", F.row_number().over(first))
    columns = ["path", "hash", "data_offset", "data_size"]
    more = ranked.where("rank > 1").select("path", F.lit(S.ADDED).alias("status"), F.col("data_offset").alias("new_offset"), "data_size", "hash")
    return delta(old, ranked.where("rank = 1").select(columns)).unionByName(more)


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("path"), "path", "left_anti")


def deleted(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("path"), "path", "left_anti")


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("path", F.col("hash").alias("old_hash")), "path").where("not (hash <=> old_hash)")


def in_io_order(delta: DataFrame) -> DataFrame:
    """Sorted by offset, then path, for sequential reads."""
    return delta.orderBy("new_offset", "path")


def summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("status").agg(F.count("*").alias("files"), F.sum("data_size").alias("bytes"))


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (path, hash) of one side only, with the side; a cross-check of delta by set operations."""
    a, b = old.select("path", "hash"), new.select("path", "hash")
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def path_of(*values: Column) -> Column:
    """One path from key values, different for different keys: / and \\ are escaped, and null is \\N."""

    def part(x: Column) -> Column:
        return F.coalesce(F.replace(F.replace(x.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/")), F.lit("\\N"))

    return F.concat_ws("/", *map(part, values))


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Any keyed table as a snapshot: path from the keys, hash from the other columns as JSON; entry_idx orders equal keys by hash."""
    rest = [c for c in df.columns if c not in keys]
    values = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    rows = df.select(path_of(*map(F.col, keys)).alias("path"), F.octet_length(values).cast("long").alias("data_size"), F.sha2(values, 256).alias("hash"))
    return rows.withColumn("entry_idx", F.col("hash"))
