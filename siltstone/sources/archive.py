"""Data sources: folders of files, and archives of the binary format, read and written in parallel as Arrow batches.

`siltstone_folder` reads the regular files below a folder, hidden and empty ones too. It applies ignore rules
while it walks, so an ignored subtree is never opened.
`siltstone_archive` reads an archive as view=header, entries (metadata only) or files (with contents, or a range of
bytes of each), and writes one from rows (path, content): tasks write part files next to the target, the commit joins them
in order of path range and renames the result. Filters on entry_idx and path reach the reader: an ordinal reads one entry,
and contents are read for asked paths only. Paths are those of a file system that all executors mount.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from siltstone import schema as S

FILES_A_TASK, BYTES_A_TASK = 4096, 128 << 20
#: Fewest bytes of a task where an archive is small, and most of an Arrow batch.
LEAST_BYTES, BATCH_BYTES = 4 << 20, 8 << 20
#: The layout schema.ENTRY for numpy.
ENTRY_TYPE = np.dtype([("path_at", "<u8"), ("length", "<u4"), ("flags", "<u4"), ("at", "<u8"), ("size", "<u8"), ("hash", "S32")])
ENTRY_FIELDS = pa.schema([("archive", pa.string()), ("entry_idx", pa.int64()), ("path", pa.string()), ("flags", pa.int32()), ("data_offset", pa.int64()), ("data_size", pa.int64()), ("hash", pa.binary())])
FILE_FIELDS = ENTRY_FIELDS.append(pa.field("content", pa.binary()))


def local(path: str) -> str:
    """The path of a mounted file system; any other store is an error."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", path):
        raise ValueError(f"{path} is not on a file system that executors mount")
    return path


def _matches(name: str, rules: list[str]) -> bool:
    return any(re.fullmatch(".*".join(map(re.escape, r.split("*"))), name, re.S) for r in rules)


def _rules(file: str) -> list[str]:
    try:
        with open(file, encoding="utf-8", errors="surrogateescape") as f:
            return [x for x in (line.rstrip("\n") for line in f) if x and not x.startswith("#")]
    except OSError:
        return []


def walk(root: str, ignore: str | None = None, recursive: bool = False) -> list[tuple[str, int]]:
    """(path below root, size) of regular files, sorted by path; a missing root is an error.

    With recursive, each folder's own ignore file counts in it and one level below, and the root's
    rules there only; without it the root's rules count everywhere.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no folder {root}")
    start = _rules(ignore or os.path.join(root, S.IGNORE_FILE))
    out, todo = [], [("", start)]
    while todo:
        rel, above = todo.pop()
        own = _rules(os.path.join(root, rel, S.IGNORE_FILE)) if recursive else []
        rules = above + own
        for item in os.scandir(os.path.join(root, rel)):
            if _matches(item.name, rules):
                continue
            path = f"{rel}/{item.name}" if rel else item.name
            if item.is_dir():
                todo.append((path, own if recursive else above))
            elif item.is_file():
                out.append((path, item.stat().st_size))
    return sorted(out)


@dataclass
class Files(InputPartition):
    files: list = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(None)


def grouped(files: list, size) -> list[Files]:
    """Files in order, as tasks bounded by number and bytes."""
    out, now, held = [], [], 0
    for f in files:
        if now and (len(now) >= FILES_A_TASK or held + size(f) > BYTES_A_TASK):
            out.append(Files(now))
            now, held = [], 0
        now.append(f)
        held += size(f)
    return [*out, Files(now)]


class FolderSource(DataSource):
    """Options: path (or roots, separated by line feeds), ignore, recursive, glob, contents."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_folder"

    def schema(self) -> str:
        return "root string, path string, data_size long, content binary" if self._contents() else "root string, path string, data_size long, hash string"

    def _contents(self) -> bool:
        return self.options.get("contents", "true").lower() == "true"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options, self._contents())


class FolderReader(DataSourceReader):
    def __init__(self, options, contents: bool) -> None:
        self.roots = [local(r) for r in (options.get("roots") or options["path"]).split("\n") if r]
        self.ignore, self.recursive = options.get("ignore"), options.get("recursive", "false").lower() == "true"
        self.rule, self.contents = options.get("glob"), contents

    def partitions(self) -> list[Files]:
        found = [(r, p, n) for r in self.roots for p, n in walk(r, self.ignore, self.recursive) if not self.rule or _matches(p, [self.rule])]
        return grouped(found, lambda f: f[2])

    def read(self, partition: Files):
        for root, path, _ in partition.files:
            with open(os.path.join(root, path), "rb") as f:
                if self.contents:
                    raw = f.read()
                    yield root, path, len(raw), raw
                else:
                    yield root, path, os.fstat(f.fileno()).st_size, hashlib.file_digest(f, "sha256").hexdigest()


def read_header(file: str) -> tuple[int, int, int, int, int]:
    """(version, flags, count, index offset, path offset), checked."""
    with open(file, "rb") as f:
        raw = f.read(S.HEADER_BYTES)
    if len(raw) < S.HEADER_BYTES:
        raise ValueError(f"{file} is shorter than a header")
    magic, *rest = struct.unpack(S.HEADER, raw)
    if magic != S.ARCHIVE_MAGIC:
        raise ValueError(f"{file} is not an archive")
    return tuple(rest)


class ArchiveSource(DataSource):
    """Options: path; to read also view (header, entries, files) and, for files, offset and size of the bytes of each content; to write also index_only."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_archive"

    def schema(self):
        return {"header": S.HEADERS, "entries": S.ENTRIES, "files": S.FILES}[self.options.get("view", "entries")]

    def reader(self, schema) -> DataSourceReader:
        part = (int(self.options.get("offset", 0)), int(self.options["size"]) if "size" in self.options else None)
        return ArchiveReader(local(self.options["path"]), self.options.get("view", "entries"), part)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(local(self.options["path"]), schema.fieldNames(), overwrite, self.options.get("index_only", "false").lower() == "true")


class ArchiveReader(DataSourceReader):
    def __init__(self, file: str, view: str, part: tuple[int, int | None]) -> None:
        self.file, self.view, self.part = file, view, part
        self.ordinals: set | None = None
        self.names: set | None = None

    def pushFilters(self, filters: list[Filter]):
        """Keep what narrows the read; Spark evaluates all filters again."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and self.view != "header" and f.attribute == ("entry_idx",):
                self.ordinals = values if self.ordinals is None else self.ordinals & values
            if values is not None and self.view != "header" and f.attribute == ("path",):
                self.names = values if self.names is None else self.names & values
            yield f

    def partitions(self) -> list[InputPartition]:
        _, flags, count, index_at, _ = read_header(self.file)
        if self.view == "files" and flags & S.FLAG_INDEX_ONLY:
            raise ValueError(f"{self.file} has no data, only an index")
        if self.view == "header":
            return [InputPartition(None)]
        if os.path.getsize(self.file) < index_at + count * S.ENTRY_BYTES:
            raise ValueError(f"{self.file} ends within its index")
        if self.ordinals is not None:
            return [Files([i, i + 1]) for i in sorted(i for i in self.ordinals if i is not None and 0 <= i < count)] or [Files([0, 0])]
        if self.view == "entries" or not count:
            step = 16 * FILES_A_TASK
            return [Files([i, min(count, i + step)]) for i in range(0, count, step)] or [Files([0, 0])]
        # runs of entries by bytes
        sizes = np.memmap(self.file, ENTRY_TYPE, "r", index_at, (count,))["size"]
        total = float(np.sum(sizes, dtype=np.float64))
        most, cuts, held = min(max(LEAST_BYTES, total / 4096), BYTES_A_TASK), [0], 0
        for at in range(0, count, 1 << 16):
            for i, size in enumerate(sizes[at : at + (1 << 16)].tolist(), at):
                if i > cuts[-1] and (held + size > most or i - cuts[-1] >= FILES_A_TASK):
                    cuts.append(i)
                    held = 0
                held += size
        return [Files([a, b]) for a, b in zip(cuts, [*cuts[1:], count])]

    def read(self, partition):
        version, flags, count, index_at, paths_at = read_header(self.file)
        if self.view == "header":
            yield self.file, version, flags, count, index_at, paths_at
            return
        first, end = partition.files
        with open(self.file, "rb") as f:
            for at in range(first, end, FILES_A_TASK):
                yield from self._batches(f, at, min(end, at + FILES_A_TASK), index_at, paths_at)

    def _batches(self, f, first: int, end: int, index_at: int, paths_at: int):
        f.seek(index_at + first * S.ENTRY_BYTES)
        raw = f.read((end - first) * S.ENTRY_BYTES)
        if len(raw) < (end - first) * S.ENTRY_BYTES:
            raise ValueError(f"{self.file} ends within its index")
        entries = np.frombuffer(raw, ENTRY_TYPE)
        for column in ("path_at", "at", "size"):
            if len(entries) and entries[column].max() >= 1 << 63:
                raise ValueError(f"an entry from {first} to {end} of {self.file} has a number of 64 bits")
        names = self._names(f, entries, first, paths_at)
        digests = [raw[i + 32 : i + 64] for i in range(0, len(raw), S.ENTRY_BYTES)]
        numbers = [entries[c].tolist() for c in ("flags", "at", "size")]
        rows: list[tuple] = []
        held = 0
        fields = FILE_FIELDS if self.view == "files" else ENTRY_FIELDS

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), fields)], schema=fields)

        for i, (name, flags, at, size, digest) in enumerate(zip(names, *numbers, digests), first):
            if self.names is not None and name not in self.names:
                continue
            row = (self.file, i, name, flags - (1 << 32) if flags >= 1 << 31 else flags, at, size, digest)
            if self.view == "files":
                row += (self._content(f, i, at, size),)
                held += len(row[-1])
            rows.append(row)
            if held >= BATCH_BYTES:
                yield batch()
                rows.clear()
                held = 0
        if rows:
            yield batch()

    def _names(self, f, entries: np.ndarray, first: int, paths_at: int) -> list[str]:
        """The paths of entries: those that lie side by side are read at once."""
        starts, lengths = entries["path_at"].tolist(), entries["length"].tolist()
        for i, n in enumerate(lengths, first):
            if not 0 < n <= S.MOST_PATH:
                raise ValueError(f"the path of entry {i} of {self.file} has {n} bytes")
        out, i = [], 0
        while i < len(starts):
            j = i + 1
            while j < len(starts) and starts[j] == starts[j - 1] + lengths[j - 1]:
                j += 1
            f.seek(paths_at + starts[i])
            size = starts[j - 1] + lengths[j - 1] - starts[i]
            raw = f.read(size)
            if len(raw) < size:
                raise ValueError(f"{self.file} ends within a path")
            out += [raw[a - starts[i] : a - starts[i] + n].decode("utf-8", "replace") for a, n in zip(starts[i:j], lengths[i:j])]
            i = j
        return out

    def _content(self, f, i: int, at: int, size: int) -> bytes:
        offset, most = self.part
        offset = min(offset, size)
        n = size - offset if most is None else min(most, size - offset)
        if n > S.MOST_ENTRY_READ:
            raise ValueError(f"entry {i} of {self.file} is too large for one row")
        f.seek(S.HEADER_BYTES + at + offset)
        content = f.read(n)
        if len(content) < n:
            raise ValueError(f"{self.file} ends within the data of entry {i}")
        return content


@dataclass
class Part(WriterCommitMessage):
    number: int
    data: str
    index: str


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (path, content), or with flags and hash (hex, null for none) as patches have them.

    Rows are taken in order of partition and place: sort by path before writing for a sorted archive.
    """

    def __init__(self, file: str, names: list[str], overwrite: bool, index_only: bool) -> None:
        if os.path.exists(file) and not overwrite:
            raise FileExistsError(file)
        self.file, self.names, self.index_only = file, names, index_only
        self.folder = f"{file}.parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        os.makedirs(self.folder, exist_ok=True)
        stem = f"{self.folder}/{number:08d}-{uuid.uuid4().hex}"
        with open(f"{stem}.data", "wb") as data, open(f"{stem}.index", "wb") as index:
            for batch in iterator:
                nothing = [None] * batch.num_rows
                columns = [batch.column(c).to_pylist() if c in self.names else nothing for c in ("path", "content", "hash", "flags")]
                for name, content, given, flags in zip(*columns):
                    content, path = bytes(content or b""), (name or "").encode("utf-8")
                    if not 0 < len(path) <= S.MOST_PATH:
                        raise ValueError(f"a path of {len(path)} bytes")
                    given = given if "hash" in self.names else hashlib.sha256(content).hexdigest()
                    digest = bytes.fromhex(given) if given else bytes(32)
                    index.write(struct.pack("<IIQ32s", len(path), flags or 0, len(content), digest) + path)
                    if not self.index_only:
                        data.write(content)
        return Part(number, f"{stem}.data", f"{stem}.index")

    def commit(self, messages) -> None:
        """Join the parts: data, then entries, then paths, each copied as a stream."""
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        made, at, count, path_at = f"{self.file}.new-{uuid.uuid4().hex}", 0, 0, 0
        os.makedirs(self.folder, exist_ok=True)
        entries_file, names_file = f"{self.folder}/entries", f"{self.folder}/names"
        with open(made, "wb") as out:
            out.write(bytes(S.HEADER_BYTES))
            with open(entries_file, "wb") as entries, open(names_file, "wb") as names:
                for part in parts:
                    with open(part.data, "rb") as f:
                        shutil.copyfileobj(f, out, 8 << 20)
                    with open(part.index, "rb") as f:
                        while head := f.read(48):
                            length, flags, size, digest = struct.unpack("<IIQ32s", head)
                            names.write(f.read(length))
                            entries.write(struct.pack(S.ENTRY, path_at, length, flags, 0 if self.index_only else at, size, digest))
                            path_at += length
                            at += size
                            count += 1
            index_at = out.tell()
            for file in (entries_file, names_file):
                with open(file, "rb") as f:
                    shutil.copyfileobj(f, out, 8 << 20)
            out.seek(0)
            out.write(struct.pack(S.HEADER, S.ARCHIVE_MAGIC, S.VERSION, S.FLAG_INDEX_ONLY if self.index_only else 0, count, index_at, index_at + S.ENTRY_BYTES * count))
        os.replace(made, self.file)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def register(spark: SparkSession) -> None:
    """Make both sources known, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(ArchiveSource)
