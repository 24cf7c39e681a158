"""Packing token sequences into windows: best-fit decreasing over a segment tree.

Each text is encoded once; only its length and checksums travel further. A document longer than
a window is first cut into full windows. What remains of each document is dealt to groups of about
`group_pieces` pieces, a number that depends on the count of pieces alone, and each group is
packed by falling length: a segment tree over the remaining capacities finds the tightest open
window. Groups are independent, so a lost executor repeats its own groups only, and rerun
groups come out the same: pieces are ordered by length, document, start and checksum. Equal pieces (of repeated rows or
null doc_ids) that are many for a group are dealt to several.

Nulls: a null text is empty and still has its end token. Null or repeated doc_ids are packed like
any others. An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import staged, texts
from siltstone.llm.tokens import Sparing, encoder
from siltstone.plans.staging import small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Sequence ids: the group in the upper bits, the number within the group in the lower.
GROUP_BITS = 32


def cut(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of full windows, then of the rest; 4 bytes are one id."""
    n = len(ids) // 4
    return [(s, min(window, n - s), zlib.crc32(memoryview(ids)[4 * s : 4 * min(n, s + window)])) for s in range(0, n, window)]


def _pieces(tokenizer_file: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_file, Sparing).ids, end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                rows += [(doc_id, *piece, len(ids) // 4) for piece in cut(ids, window)]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class TightestFit:
    """Open windows by remaining capacity: a segment tree whose nodes say whether any leaf below is open."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)  # counts of open windows
        self.windows: dict[int, list[int]] = defaultdict(list)

    def put(self, capacity: int, number: int) -> None:
        self.windows[capacity].append(number)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, number) of the open window with the least capacity that holds the length."""
        node = self.size + length
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()

    def _add(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.open[node] += by
            node >>= 1


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window's number, offset) of pieces that come by falling length."""
    tree, out, fresh = TightestFit(window), [], 0
    for length in lengths:
        capacity, number = tree.take(length) or (window, fresh)
        fresh += number == fresh
        out.append((number, window - capacity))
        if capacity > length:
            tree.put(capacity - length, number)
    return out


def _packed(window: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        if not group.num_rows:
            return
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit(group.column("length").to_pylist(), window)
        base = key[0].as_py() << GROUP_BITS
        group = group.drop_columns(["pack_group"])
        group = group.append_column("sequence_id", pa.array([base + n for n, _ in placed], pa.int64()))
        yield from group.append_column("offset", pa.array([o for _, o in placed], pa.int64())).to_batches()

    return run


def packed(docs: DataFrame, tokenizer_file: str, end_id: int = 1, window: int = 2048, group_pieces: int = 32_768) -> DataFrame:
    """documents -> one row for each piece: its document, place there, checksum, sequence and offset."""
    with small_batches(docs.sparkSession):
        pieces = staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer_file, end_id, window), PIECES), "pack-pieces")
    groups = -(-pieces.count() // group_pieces) or 1
    named = ("doc_id", "start", "ids_crc32")
    share = max(1, group_pieces // 4)
    many = pieces.groupBy(*named).count().where(F.col("count") > share)
    many = staged(many.select(*(F.col(c).alias(f"many_{c}") for c in named), F.ceil(F.col("count") / share).alias("shares")), "pack-many")
    salt = F.lit(0).cast("long")
    if not many.isEmpty():  # the pieces are a written table, so a row's number is the same in every attempt
        pieces = pieces.withColumn("row_no", F.monotonically_increasing_id())
        pieces = pieces.join(many, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"many_{c}")) for c in named)), "left")
        salt = F.coalesce(F.pmod("row_no", "shares"), salt)
    group = F.pmod(F.xxhash64(*named, salt), F.lit(groups)).alias("pack_group")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", group).groupBy("pack_group").applyInArrow(_packed(window), PACKED)


def op8_pack_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
