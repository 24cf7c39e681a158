"""Token-id files: whole texts encoded, in ascending doc_id order, as one wavelet matrix a shard.

The texts are dealt once, by ranges of doc_id and a hash of the text, and sorted within each range; each task encodes
its documents and writes a file whenever `shard_ids` ids are gathered, so memory is bounded by a
shard and the longest document. The number of ranges follows the bytes of the texts, at most one for 512 MB once there are
4096, and the driver samples ten keys for each of so many. A file is written under a name of its own attempt and then
renamed to a name that depends on range and number only; its bytes depend on the rows only. A
repeated task therefore replaces a file by an equal one. The table of files says which count.

Nulls: a null text is empty and still has its end id. Null doc_ids come last. Rows of equal
doc_id are ordered by a hash of their text. An empty table writes no file. Extra columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import wavelet
from siltstone.llm.common import range_count, shared_path, staged, table
from siltstone.llm.tokens import encoder

FILES = "file string, part long, shard long, n_docs long, n_ids long, bytes long"
ROWS = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def put(folder: str, name: str, raw: bytes) -> None:
    """Write a file and then give it its name; folder: a path, or a URI that pyarrow knows."""
    temp = f".{name}.{uuid.uuid4().hex}"
    if folder.startswith(("file:", "/")):
        local = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/{temp}", "wb") as f:
            f.write(raw)
        os.replace(f"{local}/{temp}", f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{temp}") as f:
        f.write(raw)
    store.move(f"{path}/{temp}", f"{path}/{name}")


def _write(folder: str, tokenizer_file: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), encoder(tokenizer_file).ids_of_all, end_id.to_bytes(4, "little")
        done, held, doc_ids, gathered = [], [], [], 0

        def close() -> None:
            nonlocal held, doc_ids, gathered
            ids = np.frombuffer(b"".join(held), "<u4")
            name = f"part-{part:08d}-{len(done):08d}.wvm"
            raw = wavelet.write(ids, doc_ids, [len(x) // 4 for x in held])
            put(folder, name, raw)
            done.append((name, part, len(done), len(doc_ids), len(ids), len(raw)))
            held, doc_ids, gathered = [], [], 0

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(text.as_py() for text in batch.column(1))):
                held.append(ids + end)
                doc_ids.append(doc_id)
                gathered += len(held[-1]) // 4
                if gathered >= shard_ids:
                    close()
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["file", "part", "shard", "n_docs", "n_ids", "bytes"])

    return run


@contextmanager
def _few_samples(spark, ranges: int):
    """A hundred sampled keys a range, or ten if there are many, while this holds."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "100" if ranges <= 4096 else "10")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 2, shard_ids: int = 1 << 22, range_bytes: int = 4 << 20) -> DataFrame:
    """Write the files; returns the table of files, itself written beside them."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    ranges, order = range_count(size, range_bytes), [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    with _few_samples(docs.sparkSession, ranges):
        dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        return staged(dealt.mapInArrow(_write(folder, tokenizer_file, end_id, shard_ids), FILES), "token-file-table")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = wavelet.Wavelet(raw.as_buffer())
            ids, (doc_ids, lengths) = shard.ids().astype("<u4"), shard.documents()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            name = path.rsplit("/", 1)[-1]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(doc_ids), pa.string()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """What the files hold: (doc_id, start, n_tokens, ids_crc32, file), start over all files.

    The running total over files is of one row a file.
    """
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    so_far = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(files.select(F.col("file").alias("of_file"), F.coalesce(F.sum("n_ids").over(so_far), F.lit(0)).alias("base")), "token-file-bases")
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content").mapInArrow(_read, ROWS)
    return held.join(bases, F.col("file") == F.col("of_file")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "file")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "token-files")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder, files)
