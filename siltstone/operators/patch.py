"""Patches: what turns one content table into another, and applying them as a merge."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import schema as S
from siltstone.functions import blocks, paths
from siltstone.operators import delta as D
from siltstone.operators import snapshot
from siltstone.plans.staging import staged


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [blocks.encode(o or b"", n or b"") for o, n in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("hash"), pa.array(payloads, pa.binary())], names=["path", "hash", "payload"])


def encoded(pairs: DataFrame) -> DataFrame:
    """(path, hash, old, new) -> (path, hash, payload): block deltas, one row at a time."""
    return pairs.select("path", "hash", "old", "new").mapInArrow(_encode, "path string, hash string, payload binary")


def create(old: DataFrame, new: DataFrame, most_old: int = S.MOST_DELTA_OLD) -> DataFrame:
    """Contents (path, content) -> rows of schema.PATCH.

    The delta is made of paths and hashes alone; contents are read again for changed paths only.
    Updated contents become block deltas unless the old one is larger than most_old, or one of both is null: a null
    content is written as it is. The delta is written once.
    """
    rows = staged(D.delta(snapshot.index(old), snapshot.index(new)).select("path", "status", "hash"), "patch-delta")
    after = new.select("path", F.col("content").cast("binary").alias("new"))
    before = old.select("path", F.col("content").cast("binary").alias("old"))
    written = rows.where(F.col("status") != S.DELETED).join(after, "path")
    pairs = written.where(F.col("status") == S.UPDATED).join(before, "path")
    small = F.coalesce((F.octet_length("old") <= most_old) & F.col("new").isNotNull(), F.lit(False))
    size = F.octet_length("payload").cast("long").alias("data_size")

    def whole(df: DataFrame) -> DataFrame:
        return df.select("path", F.lit(0).alias("flags"), F.coalesce(F.octet_length("new"), F.lit(0)).cast("long").alias("data_size"), "hash", F.col("new").alias("payload"))

    out = whole(written.where(F.col("status") == S.ADDED)).unionByName(whole(pairs.where(~small)))
    out = out.unionByName(encoded(pairs.where(small)).select("path", F.lit(S.FLAG_BINARY_DELTA).alias("flags"), size, "hash", "payload"))
    nothing = F.lit(None).cast("binary")
    gone = rows.where(F.col("status") == S.DELETED).select("path", F.lit(S.FLAG_DELETED).alias("flags"), F.lit(0).cast("long").alias("data_size"), F.lit(None).cast("string").alias("hash"), nothing.alias("payload"))
    return out.unionByName(gone)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, errors = [], []
        for old, payload in zip(batch.column("old").to_pylist(), batch.column("payload").to_pylist()):
            try:
                if old is None:
                    raise ValueError("there is no old content")
                made.append(blocks.apply(payload, old))
                errors.append(None)
            except ValueError as e:
                made.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("hash"), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["path", "hash", "content", "error"])


def outcome(old: DataFrame, patch: DataFrame) -> DataFrame:
    """(path, action, content, error) of every patch row: action write or delete; error null if it can be done."""
    safe = paths.safe_in_patch(F.col("path"))
    before = old.select("path", F.col("content").cast("binary").alias("old"))
    binary = snapshot.flagged(F.col("flags"), S.FLAG_BINARY_DELTA)
    gone = snapshot.flagged(F.col("flags"), S.FLAG_DELETED)
    deltas = patch.where(safe & binary & ~gone).join(before, "path", "left").select("path", "hash", "old", "payload").mapInArrow(_decode, "path string, hash string, content binary, error string")
    plain = patch.where(safe & ~binary & ~gone).select("path", "hash", F.col("payload").alias("content"), F.lit(None).cast("string").alias("error"))
    wrong = ~F.sha2("content", 256).eqNullSafe(F.col("hash"))
    written = deltas.unionByName(plain).select("path", F.lit("write").alias("action"), "content", F.coalesce("error", F.when(wrong, F.lit("the hash differs"))).alias("error"))
    none = F.lit(None).cast("binary").alias("content")
    there = old.select("path", F.lit(True).alias("there")).distinct()
    dropped = patch.where(safe & gone).join(there, "path", "left").select("path", F.lit("delete").alias("action"), none, F.when(F.col("there").isNull(), F.lit("there is no such file")).alias("error"))
    refused = patch.where(~safe).select("path", F.lit("refuse").alias("action"), none, F.lit("the path is not safe").alias("error"))
    return written.unionByName(dropped).unionByName(refused)


def merged(old: DataFrame, results: DataFrame) -> DataFrame:
    """The content table after a patch: rows with an error leave what was there."""
    done = results.where("error is null")
    kept = old.select("path", F.col("content").cast("binary").alias("content")).join(done.select("path"), "path", "left_anti")
    return kept.unionByName(done.where("action = 'write'").select("path", "content"))


def apply(old: DataFrame, patch: DataFrame) -> DataFrame:
    """The content table after a patch; what it does is written once, since the merge reads it twice."""
    return merged(old, staged(outcome(old, patch), "patch-outcome"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = [[kind for kind, *_ in blocks.decode(x)[1]] for x in batch.column("payload").to_pylist()]
        copies = [sum(k == S.COPY for k in ks) for ks in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(copies, pa.int64()), pa.array([len(k) - c for k, c in zip(kinds, copies)], pa.int64())], names=["path", "copies", "literals"])


def instruction_counts(patch: DataFrame) -> DataFrame:
    """(path, copies, literals) of a patch's block deltas."""
    return patch.where(snapshot.flagged(F.col("flags"), S.FLAG_BINARY_DELTA)).select("path", "payload").mapInArrow(_counted, "path string, copies long, literals long")


def error_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNotNull()).alias("errors"))


def sync(old: DataFrame, new: DataFrame, delta: DataFrame) -> DataFrame:
    """Apply a delta from a content table that has the new contents: copy or drop, unverified."""
    copied = new.select("path", F.col("content").cast("binary").alias("content")).join(delta.where(F.col("status") != S.DELETED).select("path"), "path", "left_semi")
    kept = old.select("path", F.col("content").cast("binary").alias("content")).join(delta.select("path"), "path", "left_anti")
    return kept.unionByName(copied)


def gathered(new: DataFrame, delta: DataFrame) -> DataFrame:
    """Contents of a delta's written rows in order of offset: (new_offset, path, content)."""
    written = delta.where(F.col("status") != S.DELETED).select("path", "new_offset")
    return new.select("path", F.col("content").cast("binary").alias("content")).join(written, "path").select("new_offset", "path", "content").orderBy("new_offset", "path")


# --- block figures in SQL functions, for sizing a patch without making it ---


def split(contents: DataFrame) -> DataFrame:
    """(path, block_no, offset, size, block_hash) of the 4096-byte blocks of each content, the last one shorter."""
    content = F.col("content").cast("binary")
    n = F.ceil(F.octet_length(content) / S.BLOCK).cast("int")
    at = F.posexplode(F.sequence(F.lit(0), n - 1)).alias("block_no", "b")
    rows = contents.where(F.octet_length(content) > 0).select("path", content.alias("c"), at)
    block = F.substring("c", F.col("b") * S.BLOCK + 1, F.lit(S.BLOCK))
    return rows.select("path", F.col("block_no").cast("long").alias("block_no"), (F.col("b").cast("long") * S.BLOCK).alias("offset"), F.octet_length(block).cast("long").alias("size"), F.sha2(block, 256).alias("block_hash"))


def reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aligned whole blocks of new that old has in the same path, with the last old offset of each."""
    last = split(old).where(F.col("size") == S.BLOCK).groupBy("path", "block_hash").agg(F.max("offset").alias("old_offset"))
    return split(new).where(F.col("size") == S.BLOCK).join(last, ["path", "block_hash"]).select("path", "block_no", "offset", "old_offset")


def literal_chunks(contents: DataFrame) -> DataFrame:
    """(path, chunk, offset, size) of the literals that each content would take on its own."""
    size = F.octet_length(F.col("content").cast("binary")).cast("long")
    rows = contents.select("path", size.alias("n")).where("n > 0")
    rows = rows.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / S.MOST_LITERAL))).alias("chunk"))
    return rows.select("path", "chunk", (F.col("chunk") * S.MOST_LITERAL).alias("offset"), F.least(F.lit(S.MOST_LITERAL).cast("long"), F.col("n") - F.col("chunk") * S.MOST_LITERAL).alias("size"))
