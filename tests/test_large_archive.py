import struct

import pytest

from siltstone import schema as S
from siltstone.sources import archive


def test_more_than_a_million_entries(spark, tmp_path):
    n, file, short = 1_000_001, tmp_path / "large", tmp_path / "short"
    index = S.HEADER_BYTES + 1
    header = struct.pack(S.HEADER, S.ARCHIVE_MAGIC, S.VERSION, 0, n, index, index + n * S.ENTRY_BYTES)
    entries = struct.pack(S.ENTRY, 0, 1, 0, 0, 1, bytes(32)) * n
    file.write_bytes(header + b"x" + entries + b"a")
    short.write_bytes(header + b"x" + entries[: -S.ENTRY_BYTES])
    archive.register(spark)
    read = spark.read.format("siltstone_archive")
    assert read.option("view", "header").load(str(file)).count() == 1
    for view in ("entries", "files"):
        assert read.option("view", view).load(str(file)).count() == n
        with pytest.raises(Exception, match="ends within its index"):
            read.option("view", view).load(str(short)).count()
