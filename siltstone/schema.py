"""Schemas, flags and layouts of snapshots, deltas and patches."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values of the binary formats, all little-endian and packed ---

ARCHIVE_MAGIC = b"PAF1"
DELTA_MAGIC = b"PAFD"
VERSION = 1
#: magic, version, flags, file count, index offset, path offset
HEADER = "<4sIIIQQ"
HEADER_BYTES = 32
#: path offset, path length, flags, data offset, data size, sha-256
ENTRY = "<QIIQQ32s"
ENTRY_BYTES = 64
#: magic, instruction count, old file size
DELTA_HEADER = "<4sIQ"
DELTA_HEADER_BYTES = 16
#: kind, offset, size; the bytes follow if it is a literal
INSTRUCTION = "<BQI"
INSTRUCTION_BYTES = 13
COPY, LITERAL = 0, 1

BLOCK = 4096
MOST_LITERAL = 65535
MOST_DELTA_OLD = 128 << 20
MOST_ENTRY_READ = (1 << 31) - 1
MOST_PATH = 1023
IGNORE_FILE = ".pafignore"
STAGE_SUFFIX = ".paf_stage"

FLAG_INDEX_ONLY = 0x02
FLAG_DELETED = 0x04
FLAG_BINARY_DELTA = 0x08

# --- tables ---

ADDED, UPDATED, DELETED = "ADDED", "UPDATED", "DELETED"
#: Numbers of the statuses in the format's interface.
STATUS_NUMBERS = {ADDED: 0, UPDATED: 1, DELETED: 2}


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


CONTENTS = _struct(("path", T.StringType()), ("content", T.BinaryType()))
ENTRIES = _struct(("archive", T.StringType()), ("entry_idx", T.LongType()), ("path", T.StringType()), ("flags", T.IntegerType()), ("data_offset", T.LongType()), ("data_size", T.LongType()), ("hash", T.BinaryType()))
HEADERS = _struct(("archive", T.StringType()), ("version", T.LongType()), ("flags", T.IntegerType()), ("file_count", T.LongType()), ("index_offset", T.LongType()), ("path_offset", T.LongType()))
FILES = _struct(*((f.name, f.dataType) for f in ENTRIES.fields), ("content", T.BinaryType()))
DELTA = _struct(("path", T.StringType()), ("status", T.StringType()), ("new_offset", T.LongType()), ("data_size", T.LongType()), ("hash", T.StringType()))
PATCH = _struct(("path", T.StringType()), ("flags", T.IntegerType()), ("data_size", T.LongType()), ("hash", T.StringType()), ("payload", T.BinaryType()))
INSTRUCTIONS = "array<struct<kind:int,offset:bigint,size:bigint,literal:binary>>"
