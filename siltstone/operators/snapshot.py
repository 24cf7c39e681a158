"""Snapshots: paths with size, hash and offsets; header figures; batches; listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema as S
from siltstone.plans.staging import staged


def index(contents: DataFrame) -> DataFrame:
    """(path, content) -> (path, data_size, hash); content: text or binary."""
    content = F.col("content").cast("binary")
    return contents.select("path", F.octet_length(content).cast("long").alias("data_size"), F.sha2(content, 256).alias("hash"))


def union_of_roots(*roots: DataFrame) -> DataFrame:
    """The rows of several roots, repeated paths kept."""
    return reduce(DataFrame.unionByName, roots)


def with_offsets(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """Entries in order of path with entry_idx, data_offset and path_offset: sums over all rows before.

    Two passes: rows are dealt by ranges of path and written with their range; sums run within each
    range, and over the ranges' totals, of which there are as many as ranges. No task sees all rows.
    """
    spark = entries.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(entries.repartitionByRange(ranges, "path").withColumn("range", F.spark_partition_id()), "offsets")
    path_size = F.octet_length("path").cast("long")
    totals = rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("data_size").alias("d"), F.sum(path_size).alias("p"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(totals.select(F.col("range").alias("of_range"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in "ndp")), "offset-bases")
    order = Window.partitionBy("range").orderBy("path", "hash")
    within = order.rowsBetween(Window.unboundedPreceding, -1)

    def running(x: Column | str) -> Column:
        return F.coalesce(F.sum(x).over(within), F.lit(0))

    local = rows.withColumn("i", F.row_number().over(order).cast("long") - 1).withColumn("d", running("data_size")).withColumn("p", running(path_size))
    joined = local.join(bases, F.col("range") == F.col("of_range"))
    return joined.select(*entries.columns, (F.col("base_n") + F.col("i")).alias("entry_idx"), (F.col("base_d") + F.col("d")).alias("data_offset"), (F.col("base_p") + F.col("p")).alias("path_offset"))


def header(entries: DataFrame, index_only: bool = False) -> DataFrame:
    """One row: what the header of an archive of these entries says, and where its data end."""
    data = F.lit(0).cast("long") if index_only else F.coalesce(F.sum("data_size"), F.lit(0))
    out = entries.agg(F.count("*").alias("file_count"), data.alias("data_bytes"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).cast("long").alias("path_bytes"))
    out = out.withColumn("index_offset", F.lit(S.HEADER_BYTES) + F.col("data_bytes"))
    out = out.withColumn("path_offset", F.col("index_offset") + S.ENTRY_BYTES * F.col("file_count"))
    return out.withColumn("metadata_end", F.greatest(F.col("path_offset"), F.col("path_offset") + F.col("path_bytes"))).withColumn("flags", F.lit(S.FLAG_INDEX_ONLY if index_only else 0))


def exported(entries: DataFrame, flags: int = 0) -> DataFrame:
    """The metadata of entries with offsets alone, as an index without data has them: data_offset is 0."""
    return entries.select("entry_idx", "path", F.lit(flags).alias("flags"), F.lit(0).cast("long").alias("data_offset"), "data_size", "hash", "path_offset")


def data_position(offset: Column) -> Column:
    return F.lit(S.HEADER_BYTES) + offset


def flagged(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def batch_plan(free_bytes: Column, files: Column, average: Column) -> Column:
    """struct (files, bytes) of a batch: as many as fit beside a reserve of 256 MiB, at least one."""
    usable = F.greatest(free_bytes - F.lit(256 << 20), F.lit(0))
    n = F.greatest(F.least(F.floor(usable / (F.lit(64) + average)).cast("long"), files), F.lit(1).cast("long"))
    return F.struct(n.alias("files"), (n * average).alias("bytes"))


def with_batches(entries: DataFrame, most_files: int = 4096, most_bytes: int = 128 << 20) -> DataFrame:
    """Entries with offsets -> batch_no, the batches being bounded by files and by bytes of their starts, and batch_offset within the batch."""
    batch = F.greatest(F.floor(F.col("entry_idx") / most_files), F.floor(F.col("data_offset") / most_bytes)).cast("long")
    first = F.min("data_offset").over(Window.partitionBy("batch_no"))
    return entries.withColumn("batch_no", batch).withColumn("batch_offset", F.col("data_offset") - first)


def verified(contents: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with ok: whether the content's hash is the entry's; false where there is no content."""
    found = contents.select(F.col("path").alias("of_path"), F.sha2(F.col("content").cast("binary"), 256).alias("found"))
    return entries.join(found, F.col("path") == F.col("of_path"), "left").withColumn("ok", F.coalesce(F.col("found") == F.col("hash"), F.lit(False))).drop("of_path", "found")


def not_there(entries: DataFrame, there: DataFrame, same_content: bool = False) -> DataFrame:
    """Entries to write: those whose path is not there, or not there with the same hash (two null ones are the same)."""
    found = there.select(F.col("path").alias("there_path"), F.col("hash").alias("there_hash"))
    same = F.col("path") == F.col("there_path")
    return entries.join(found, same & F.col("hash").eqNullSafe(F.col("there_hash")) if same_content else same, "left_anti")


def listing_json(entries: DataFrame) -> DataFrame:
    """One JSON object (path, size) for each entry, escaped."""
    return entries.select("path", F.to_json(F.struct("path", F.col("data_size").alias("size"))).alias("json"))


def listing_array(entries: DataFrame, most: int = 100_000) -> str:
    """The listing as one JSON array, by path, as a browser asks for it; more than `most` entries are an error."""
    rows = listing_json(entries).orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries; use listing_json")
    return "[" + ",".join(r.json for r in rows) + "]"
