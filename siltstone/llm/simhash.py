"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the even radius r of each other lie both within r/2 of some value between them.
So every distinct fingerprint emits all values (variants) within half the radius, 2081 for r = 4; equal
variants meet by a shuffle, and their owners are linked, after a check of their distance.
No link is lost, and none needs all pairs of a group: those that share a variant are chained.

The variants are dealt in passes, by parities of their bits: the parities of a variant are those of its owner
and of its flipped bits, so a pass makes only its own variants. The first pass is small. What it links is
contracted to classes, and so again after the second; each later entry carries its owner's class, and
owners of one class make no more links. So a dense group, which would be linked anew in every bucket, is linked once.

An entry is sixteen bytes. The bucket names the upper bits of the mixed variant; the rest and the number
of the flipped bits fit in 64 bits and give back variant and owner exactly; the other eight are the class. The disk
holds one pass's shuffle at a time. Components come from alternating star contractions over written tables, hubs
of many links being joined by a broadcast of bounded size, until so few links are left that a task may hold them: one task ends those.

Nulls: a null text counts as empty, with fingerprint zero. A null doc_id never names a
component that has another document; a component of null doc_ids alone has a null name. Repeated rows
fall in one component. An empty table gives no rows. Extra columns pass through `kept_ones` unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import MOST_HEAVY, joined, let_go, shared_path, staged, texts

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: An odd factor mixes 64 bits one to one; its inverse undoes it.
MIX = 0x9E3779B97F4A7C15
UNMIX = pow(MIX, -1, 1 << 64)
#: Parities that deal the variants, and the passes over their values: a small one, seven times as much, then eighths.
PARITIES = np.random.default_rng(11).integers(1, 1 << 63, 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
PASSES = [range(1), range(1, 8), *(range(at, at + 8) for at in range(8, 64, 8))]
#: Passes after which the links so far are contracted.
CONTRACTED = 2
#: Links that a task holds before it reports them, and up to which one task names the components.
HELD = 1 << 19


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    of = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + min(width, len(words)) - 1 :].tolist())
        h = np.array([of(joined[a:b], 42) for a, b in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def flips(radius: int) -> np.ndarray:
    """All sets of at most half the radius bits, as masks."""
    if radius % 2:
        raise ValueError("the radius has to be even")
    return np.array([sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(range(64), k)], np.uint64)


def parities(x: np.ndarray) -> np.ndarray:
    """Six bits of each value, those of a ^ b being the parities of a and of b, combined by ^."""
    return sum((np.bitwise_count(x & p) & np.uint8(1)).astype(np.int64) << i for i, p in enumerate(PARITIES))


def _emit(radius: int, bucket_bits: int, passing: range, most: int = 1 << 19):
    """(fp, root) -> (bucket, entries, roots): the variants of a pass, those of a bucket side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = flips(radius)
        flip_bits, deal = len(masks).bit_length(), parities(masks)
        numbers = [np.flatnonzero(deal == i).astype(np.uint64) for i in range(64)]
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            bucket, entry, root = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket.astype(np.uint16) if bucket_bits <= 16 else bucket, kind="stable")
            bucket, entry, root = bucket[order], entry[order], root[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            parts = [pa.array([x.tobytes() for x in np.split(y, cuts)], pa.binary()) for y in (entry, root)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cuts])].astype(np.int64)), *parts], names=["bucket", "entries", "roots"])

        for batch in batches:
            fps, roots = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)
            of = parities(fps)
            for p in range(64):
                ours = np.flatnonzero(of == p)
                number = np.concatenate([numbers[p ^ x] for x in passing])
                step = max(1, most // max(1, len(number)))
                for at in range(0, len(ours), step):
                    rows = ours[at : at + step]
                    h = ((fps[rows][:, None] ^ masks[number.astype(np.int64)]) * np.uint64(MIX)).ravel()
                    entry = (h << np.uint64(bucket_bits)) >> np.uint64(bucket_bits) << np.uint64(flip_bits) | np.tile(number, len(rows))
                    held.append((h >> np.uint64(64 - bucket_bits), entry, np.repeat(roots[rows], len(number))))
                    if sum(len(x[0]) for x in held) >= most:
                        yield sent()
        if held and sum(len(x[0]) for x in held):
            yield sent()

    return run


class Forest:
    """Links between numbers, kept as trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        pairs = [(x, self.root(x)) for x in list(self.up)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return [x for x, _ in pairs], [r for _, r in pairs]


def _report(forest: Forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.edges()], names=["a", "b"])


def _links(radius: int, bucket_bits: int):
    """Entries sorted by bucket -> a forest of the classes that share variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, forest = flips(radius), Forest()
        flip_bits = np.uint64(len(masks).bit_length())
        rows = ((k, e, r) for batch in batches for k, e, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)))
        for bucket, group in groupby(rows, lambda r: r[0]):
            parts = [(x.as_buffer(), y.as_buffer()) for _, x, y in group]
            e, roots = (np.concatenate([np.frombuffer(p[i], np.uint64) for p in parts]) for i in (0, 1))
            order = np.argsort(e)
            e, roots = e[order], roots[order]
            same = np.flatnonzero(((e[1:] ^ e[:-1]) >> flip_bits == 0) & (roots[1:] != roots[:-1]))
            if not len(same):
                continue

            def owner(x: np.ndarray, bucket: int = bucket) -> np.ndarray:
                mixed = np.uint64((bucket << (64 - bucket_bits)) & (2**64 - 1)) | x >> flip_bits
                return mixed * np.uint64(UNMIX) ^ masks[x & (np.uint64(1) << flip_bits) - np.uint64(1)]

            close = np.bitwise_count(owner(e[same]) ^ owner(e[same + 1])) <= radius
            pairs = np.unique(np.stack([roots[same][close], roots[same + 1][close]], 1), axis=0).view(np.int64)
            for x, y in pairs.tolist():
                forest.link(x, y)
            if len(forest.up) >= HELD:
                yield _report(forest)
                forest = Forest()
        yield _report(forest)

    return run


@contextmanager
def _shuffles_dropped(spark):
    """Shuffle files of each action go as it ends, while this holds."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def close_classes(fps: DataFrame, radius: int = 4, bucket_rows: int = 1 << 20) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, root): the least of all that are linked, step by step, within the radius."""
    spark, n = fps.sparkSession, fps.count()
    masks = flips(radius)
    named = fps.select("fp", F.col("fp").alias("root"))
    todo = [PASSES[:1], *(PASSES[i : i + 1] for i in range(1, CONTRACTED)), PASSES[CONTRACTED:]]
    for passes in todo:
        path = shared_path(spark, "simhash-links")
        with _shuffles_dropped(spark):
            for passing in passes:
                variants = n * len(masks) * len(passing) // 64
                bits = min(40, max(len(masks).bit_length(), (variants // bucket_rows).bit_length()))
                # even shares whatever the keys: each share sends a row for every bucket, so many small ones would cost more than their entries
                dealt = named.repartition(-(-n // 8192) or 1).mapInArrow(_emit(radius, bits, passing), "bucket long, entries binary, roots binary")
                dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(radius, bits), "a long, b long").write.mode("append").parquet(path)
        named = _contracted(named, components(spark.read.schema("a long, b long").parquet(path)), n)
    return named


def _contracted(named: DataFrame, stars: DataFrame, n: int) -> DataFrame:
    """(fp, root) with the roots of stars (node, root) in place of their nodes."""
    moves = stars.select(F.col("node").alias("of"), F.col("root").alias("to"))
    if stars.count() <= MOST_HEAVY:
        return staged(named.join(F.broadcast(moves), F.col("root") == F.col("of"), "left").select("fp", F.coalesce("to", "root").alias("root")), "simhash-named")
    sizes = named.groupBy("root").agg(F.count("*").alias("n"))
    facts = sizes.join(moves, F.col("root") == F.col("of"), "left").select("root", "n", F.coalesce("to", "root").alias("to"))
    return staged(joined(named, facts, "root", "n", n).select("fp", F.col("to").alias("root")), "simhash-named")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root): every node but the roots with the least node of its component.

    Large and small stars alternate until nothing changes or HELD edges at most are left, which one task turns into trees; each
    round is a written table.
    """
    now, seen = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "components"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        if mark[0] <= HELD:
            now = staged(now.coalesce(1).mapInArrow(_trees, "a long, b long"), "components")
            break
        seen = mark
        now = staged(_stars(now, mark[0]), "components")
    let_go(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> every node but the roots with its root."""
    forest = Forest()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.link(x, y)
    yield _report(forest)


def _stars(edges: DataFrame, n: int) -> DataFrame:
    # large: each node's larger neighbours go to its least neighbour (or itself)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    large = joined(both, least, "a", "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # small: each node and its smaller neighbours go to the least of them
    low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = joined(large, low, "a", "n", 2 * n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """documents -> (doc_id, fp, component_id)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = staged(rows.mapInArrow(_fingerprints(width), "doc_id long, fp long"), "simhash-prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "simhash-distinct")
    named = close_classes(distinct, radius)
    n_prints, n_docs = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    member = distinct.join(named, "fp")
    names = member.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("n_prints"))
    facts = joined(member.select("fp", "root", "n"), names, "root", "n_prints", n_prints).select("fp", "component_id", "n")
    return joined(prints, staged(facts, "simhash-classes"), "fp", "n", n_docs).select("doc_id", "fp", "component_id")


def kept_ones(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One document of each component: that with the least doc_id (documents without doc_id all stay)."""
    gone = staged(classes(docs, radius, width).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone_id")).distinct(), "simhash-gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")


def op4_simhash_classes(spark, sf_dir: str) -> DataFrame:
    out = classes(texts(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
