"""Sinks that write contents as files below a folder that all executors mount."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import schema as S
from siltstone.functions import paths
from siltstone.operators import search
from siltstone.sources.archive import local

RESULT = "path string, state string"


def _write(folder: str, overwrite: bool, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for path, content, digest in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "hash"))):
                states.append(put(folder, path, content or b"", digest if verify else None, overwrite))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(states, pa.string())], names=["path", "state"])

    return run


def put(folder: str, path: str, content: bytes, digest: str | None, overwrite: bool) -> str:
    """Write one file beside its place and rename it: written, same, kept, or what went wrong."""
    target = os.path.join(folder, path)
    if digest and hashlib.sha256(content).hexdigest() != digest:
        return "error: the hash differs"
    try:
        if os.path.exists(target):
            if not overwrite:
                return "kept"
            with open(target, "rb") as f:
                if os.path.getsize(target) == len(content) and f.read() == content:
                    return "same"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        stage = f"{target}{S.STAGE_SUFFIX}.{uuid.uuid4().hex}"
        with open(stage, "wb") as f:
            f.write(content)
        os.replace(stage, target)
    except OSError as e:
        return f"error: {e.strerror}"
    return "written"


def extract(files: DataFrame, folder: str, overwrite: bool = True, verify: bool = False) -> DataFrame:
    """Write (path, content[, hash as hex]) below a folder; one row (path, state) for each safe path.

    Nothing is written before an action runs on the result. Unsafe paths are left out. Verified
    contents are written only if their hash is right.
    """
    digest = F.col("hash") if "hash" in files.columns else F.lit(None)
    if "hash" in files.columns and files.schema["hash"].dataType.typeName() == "binary":
        digest = F.lower(F.hex("hash"))
    rows = files.where(paths.safe_to_write(F.col("path"))).select("path", F.col("content").cast("binary").alias("content"), digest.cast("string").alias("hash"))
    return rows.mapInArrow(_write(local(folder), overwrite, verify), RESULT)


def extract_one(files: DataFrame, path: str, folder: str, overwrite: bool = True, verify: bool = False) -> DataFrame:
    """Write the file of one path; a path that is not there is an error."""
    found = files.where(F.col("path") == path)
    if found.isEmpty():
        raise FileNotFoundError(f"no file {path}")
    return extract(found, folder, overwrite, verify)


def extract_folder(files: DataFrame, of: str, folder: str, to: str = "", strict: bool = True, overwrite: bool = True, verify: bool = False) -> DataFrame:
    """Write the files below a folder, their paths taken from there on; a folder without files is an error."""
    found = search.folder(files, of, to, strict)
    if found.isEmpty():
        raise FileNotFoundError(f"no folder {of}")
    return extract(found.withColumn("path", F.col("target")).drop("target"), folder, overwrite, verify)


def _remove(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for path in batch.column("path").to_pylist():
                try:
                    os.remove(os.path.join(folder, path))
                    states.append("removed")
                except OSError as e:
                    states.append(f"error: {e.strerror}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(states, pa.string())], names=["path", "state"])

    return run


def remove(rows: DataFrame, folder: str) -> DataFrame:
    """Remove the files of safe paths below a folder."""
    return rows.where(paths.safe_to_write(F.col("path"))).select("path").mapInArrow(_remove(local(folder)), RESULT)


def apply_outcome(results: DataFrame, folder: str) -> DataFrame:
    """Bring patch results (see operators.patch.outcome) to a folder: (path, state), errors included."""
    good = results.where("error is null")
    written = extract(good.where("action = 'write'"), folder)
    bad = results.where("error is not null").select("path", F.concat(F.lit("error: "), "error").alias("state"))
    return written.unionByName(remove(good.where("action = 'delete'"), folder)).unionByName(bad)
