"""Near copies: candidates by SimHash and by MinHash bands, each verified by its exact Jaccard similarity.

A text's set holds the hashes of its lower-cased runs of five words (all words, if there are fewer).
Equal sets are one node. Each node has the SimHash of its set; `simhash.close_classes`, op 4's ball hashing, gives
the classes linked by RADIUS bits, and pairs of a class within RADIUS bits are candidates. Sets at a similarity of 0.8 mostly
differ in more bits, and no radius that can be listed reaches them. So each node also has BANDS keys, each made of ROWS minima of its
set, and nodes that share a key are candidates too: of pairs at a similarity s, these miss (1 - s^ROWS)^BANDS, 3 in a million at 0.8.
Keys and classes give candidate groups, dealt whole with one text for each node; there,
candidates are linked if the Jaccard similarity of their sets reaches the threshold. Pairs already joined by
verified links are not compared again, so a group of close copies costs about one comparison for each.

No task holds more than about HELD_SHINGLES, eight bytes each, and one set. A candidate group with more is taken apart: its
nodes meet by class and by key instead, a few keys at a time, a key with many nodes in chunks of them. What a round links is contracted
to classes, and only keys that still have several classes go on: dealt to other chunks twice, which joins the classes of
one cluster, and then, for the few left, by all pairs of chunks. So every candidate pair is joined or compared.
Sets are told apart by 64 bits.

Nulls: a null text counts as empty, and empty texts are copies of each other. Documents without doc_id
all stay. Extra columns pass through `kept_ones` unread. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import joined, staged, trimmed
from siltstone.llm.simhash import HELD, MIX, Forest, _contracted, _shuffles_dropped, close_classes, components

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
#: Bits in which the SimHashes of candidates differ at most.
RADIUS = 4
#: Shingles of the sets that a task holds, and the bands that large groups meet by, together; the one behind all others is the class.
HELD_SHINGLES = 1 << 22
BAND_SETS = [range(BANDS, BANDS + 1), range(1), range(1, 6), range(6, BANDS)]
_DRAWN = np.random.default_rng(5).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
_FLIPS, _FACTORS = _DRAWN[0], _DRAWN[1] | np.uint32(1)
_ODD = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's shingles, each once, sorted; an empty text has none."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    of = xxhash.xxh64_intdigest
    w = np.array([of(x.encode("utf-8", "surrogatepass"), 42) for x in words], np.uint64)
    n, width = max(1, len(w) - width + 1), min(width, len(w))
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i : i + n]) * np.uint64(MIX)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def fingerprint(h: np.ndarray) -> int:
    """64-bit SimHash of a set, zero of an empty one."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def keys(h: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set."""
    least, x = np.full(BANDS * ROWS, 2**32 - 1, np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1 << 12):
        part = (x[at : at + (1 << 12), None] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, (part ^ part >> np.uint32(15)).min(axis=0))
    return ((least.astype(np.uint64) + np.uint64(1)) * _ODD).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) * np.uint64(MIX)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x) for x in batch.column("text").to_pylist()]
        nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)
        fps = np.array([fingerprint(h) for h in sets], np.uint64).view(np.int64)
        bands = [keys(h).tobytes() for h in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(nodes), pa.array([len(h) for h in sets], pa.int64()), pa.array(fps), pa.array(bands, pa.binary())], names=["doc_id", "text", "node", "n", "fp", "bands"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "node"])


def _report(forest: Forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.edges()], names=["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key -> a forest of the nodes that share keys."""
    forest, last_key, last_node = Forest(), None, None
    for batch in batches:
        k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        if last_key == k[0] and last_node != n[0]:
            forest.link(last_node, int(n[0]))
        same = np.flatnonzero(k[1:] == k[:-1])
        for a, b in zip(n[same].tolist(), n[same + 1].tolist()):
            forest.link(a, b)
        last_key, last_node = int(k[-1]), int(n[-1])
        if len(forest.up) >= HELD:
            yield _report(forest)
            forest = Forest()
    yield _report(forest)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sets' Jaccard similarity reaches the threshold; two empty ones are alike."""
    small, large = sorted((len(a), len(b)))
    if not large or small / large < least:
        return not large
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (small + large - common) >= least


def verified(members: list[tuple[int, np.ndarray, int]], least: float = LEAST) -> Forest:
    """(node, set, SimHash class) of a candidate group -> its verified links."""
    forest = Forest()
    prints = [fingerprint(held) for _, held, _ in members]
    # by key, and by class: members so far, those of one component together
    shared: dict[tuple[bool, int], list[list[int]]] = {}
    for i, (node, mine, its_class) in enumerate(members):
        forest.link(node, node)
        failed: set[int] = set()
        for by_class, key in [(True, its_class), *((False, key) for key in keys(mine).tolist())]:
            ours, others = [i], []
            for group in shared.get((by_class, key), ()):
                if forest.root(members[group[0]][0]) != forest.root(node):
                    for j in group:
                        if j in failed or by_class and (prints[i] ^ prints[j]).bit_count() > RADIUS:
                            continue
                        if similar(mine, members[j][1], least):
                            forest.link(node, members[j][0])
                            break
                        failed.add(j)
                if forest.root(members[group[0]][0]) == forest.root(node):
                    ours, less = (group, ours) if len(group) > len(ours) else (ours, group)
                    ours.extend(less)
                else:
                    others.append(group)
            shared[by_class, key] = [*others, ours]
    return forest


def _verified(least: float, stored: bool = False):
    """Rows sorted by group, with texts or with stored sets -> the verified links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("root", "node", "held", "class"))))
        for _, group in groupby(rows, lambda r: r[0]):
            yield _report(verified([(node, np.frombuffer(x, np.uint64) if stored else shingles(x), c) for _, node, x, c in group], least))

    return run


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(x).tobytes() for x in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "n", "bands", "class")] + [sets], names=["node", "n", "bands", "class", "held"])


def _by_band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        node, n = (np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), pa.array(found), pa.array(node), pa.array(n)], names=["band", "key", "node", "n"])


def linked_by_key(rows: DataFrame, least: float, held: int) -> DataFrame:
    """(node, n, bands, class, text) of nodes in large groups -> (node, root) by all verified links of candidate pairs."""
    sets = staged(rows.select("node", "n", "bands", "class", "text").mapInArrow(trimmed(_stored), "node long, n long, bands binary, class long, held binary"), "near-sets")
    entries = sets.select("node", "n", "bands").mapInArrow(trimmed(_by_band), "band int, key long, node long, n long")
    entries = staged(entries.unionByName(sets.select(F.lit(BANDS).alias("band"), _class_key().alias("key"), "node", "n")), "near-entries")
    count, labels = sets.count(), sets.select(F.col("node").alias("fp"), F.col("node").alias("root"))
    for bands in BAND_SETS:
        for deal in (0, 1, 2, None):
            ours = entries.where(F.col("band").between(bands[0], bands[-1])).select("key", "node", "n")
            named = ours.join(labels, F.col("node") == F.col("fp")).select("key", "node", "n", "root")
            open_keys = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("size"), F.count("*").alias("n_nodes")).where("low <> high")
            open_keys = open_keys.select("key", "n_nodes", F.ceil(F.col("size") * 2 / held).alias("chunks"))
            if deal != 0:  # keys of one chunk are done
                open_keys = open_keys.where("chunks > 1")
            open_keys = staged(open_keys, "near-keys")
            if open_keys.isEmpty():
                break
            dealt = joined(named.select("key", "node"), open_keys, "key", "n_nodes", count * len(bands)).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(deal or 0)), "chunks"))
            if deal is None:  # every pair of chunks
                dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
                group = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
            else:
                group = F.xxhash64("key", "chunk")
            held_rows = dealt.select(group.alias("root"), "node").distinct().join(sets.select("node", "held", "class"), "node").select("root", "node", "held", "class")
            links = staged(held_rows.repartition("root").sortWithinPartitions("root", "node").mapInArrow(trimmed(_verified(least, True)), "a long, b long"), "near-links")
            labels = _contracted(labels, components(links), count)
    return labels.select(F.col("fp").alias("node"), "root")


def _class_key():
    return F.xxhash64("class", F.lit("SimHash"))


def alike(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Nodes with fp, their SimHash -> the same with class, the least fp that theirs is linked to step by step within RADIUS bits."""
    prints = staged(nodes.groupBy("fp").agg(F.count("*").alias("n_alike")), "near-fingerprints")
    named = close_classes(prints.select("fp"), RADIUS).select("fp", F.col("root").alias("class"))
    return joined(nodes, prints.join(named, "fp"), "fp", "n_alike", n_nodes).drop("n_alike")


def classes(docs: DataFrame, least: float = LEAST, held: int = HELD_SHINGLES) -> DataFrame:
    """documents -> (doc_id, component_id)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = staged(rows.mapInArrow(trimmed(_prints), "doc_id long, text string, node long, n long, fp long, bands binary").withColumn("row_no", F.monotonically_increasing_id()), "near-prints")
    # the text and the keys of a node are those of its first row
    nodes = staged(prints.groupBy("node").agg(F.min("row_no").alias("first_row"), F.min("doc_id").alias("first_doc"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.count("*").alias("n_rows")), "near-nodes")
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    nodes = staged(alike(nodes, n_nodes), "near-alike")
    with _shuffles_dropped(docs.sparkSession):
        entries = prints.join(nodes.select("first_row"), F.col("row_no") == F.col("first_row"), "left_semi").select("node", "bands").mapInArrow(trimmed(_entries), "key long, node long")
        entries = entries.unionByName(nodes.select(_class_key().alias("key"), "node"))
        links = staged(entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(trimmed(_candidates), "a long, b long"), "near-candidates")
        groups = components(links)
        groups = staged(groups.union(groups.select(F.col("root").alias("node"), "root").distinct()), "near-groups")
        firsts = nodes.join(groups.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select("first_row", "root", "n", "class")
        firsts = staged(firsts, "near-firsts")
        sizes = staged(firsts.groupBy("root").agg(F.sum("n").alias("size"), F.count("*").alias("n_nodes")), "near-sizes")
        sized = staged(joined(firsts, sizes, "root", "n_nodes", n_nodes).select("first_row", "root", "size", "class"), "near-sized")
        small, large = (sized.where(x).select("first_row", "root", "class") for x in (F.col("size") <= held, F.col("size") > held))
        # dealt by row at every size: only small tables of candidates could be broadcast
        texts = prints.join(small.hint("merge"), F.col("row_no") == F.col("first_row")).select("root", "node", F.col("text").alias("held"), "class")
        pairs = staged(texts.repartition("root").sortWithinPartitions("root", "node").mapInArrow(trimmed(_verified(least)), "a long, b long"), "near-links")
        if not sizes.where(F.col("size") > held).isEmpty():
            named = linked_by_key(prints.join(large, F.col("row_no") == F.col("first_row")), least, held)
            pairs = pairs.unionByName(named.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    # the links are trees with the least node as root
    member = staged(nodes.join(pairs, F.col("node") == F.col("a"), "left").select("node", "first_doc", "n_rows", F.coalesce("b", "node").alias("root")), "near-members")
    names = member.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("n_nodes"))
    named = staged(joined(member.select("node", "root", "n_rows"), names, "root", "n_nodes", n_nodes).select("node", "component_id", "n_rows"), "near-classes")
    return joined(prints.select("doc_id", "node"), named, "node", "n_rows", n_rows).select("doc_id", "component_id")


def kept_ones(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each component: that with the least doc_id (documents without doc_id all stay)."""
    gone = staged(classes(docs, least).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone_id")).distinct(), "near-gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
