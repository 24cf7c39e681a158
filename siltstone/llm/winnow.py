r"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of k code points of a text is a gram. Its hash is rolled from those of shorter runs, as a cyclic polynomial is:
the hash of 2m code points is that of the first m, rotated by m, xor that of the next m. The shortest runs, of BASE code points
at every place, are hashed by XXH64, so each is read once for all grams it lies in. Of every window of w grams the least hash (by its upper 33 bits, signed) is kept, the
rightmost of equal ones; windows grow and shrink at the edges, so a text keeps its first and last gram. Window minima
grow fourfold from pass to pass. Each kept gram has its hash and its place, the number of code points before it.
Any run of w + k - 1 code points that two texts share, wherever it lies in them, has a common hash. A text shorter
than a gram is one gram. The likeness of two fingerprints is the share of common hashes among all of theirs.

An edited text keeps the windows of its unchanged start; only those that reach into the new end are made anew.

Texts are dealt once, by ranges of doc_id, for the document that follows each: within a range it is the next row; a range's last
row finds its successor in a copy of the next range's first document, which is sent along. The number of ranges, and of the
partitions they are dealt to, follows the bytes of the texts, without a cap. Null doc_ids come last, in ranges of the hash of their text; rows of equal
doc_id are ordered by a hash of their text, and the last document is followed by the first.

Nulls: a null text counts as empty; an empty text has an empty fingerprint, which is like another
empty one (1) and unlike any other (0). Repeated rows each keep their row. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bound, range_count, table

#: Code points of a gram (BASE times a power of two), grams of a window.
K, W = 16, 32
BASE = 8
#: Bits of a place: a text has fewer bytes than that.
PLACE_BITS = 31
LAST = (1 << PLACE_BITS) - 1
#: Bits of a hash that a fingerprint shows.
SHOWN_BITS = 48
NONE = "array<long>"


def _rolled(m: int):
    """The hash of two runs, one behind the other, of m code points each."""
    return lambda a, b: F.shiftleft(a, m).bitwiseOR(F.shiftrightunsigned(a, 64 - m)).bitwiseXOR(b)


def _pairs(of: Column, m: int, f) -> Column:
    """f of all elements and those m behind."""

    def paired(a: Column) -> Column:
        n = F.size(a) - m
        return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(m + 1), n), f)).otherwise(F.array().cast(NONE))

    return bound(of, paired)


def grams(text: Column, k: int = K) -> Column:
    """The hashes of all grams of a text, by place."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{BASE}}}))."), F.lit(1))
    out, m = F.transform(runs, lambda x: F.xxhash64(x)), BASE
    while m < k:
        out = _pairs(out, m, _rolled(m))
        m *= 2
    alone = F.when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast(NONE))
    return F.when(F.length(text) >= k, out).otherwise(alone)


def _least(of: Column, steps: list[int]) -> Column:
    """The least of each element and those behind by the steps; what is beyond the end does not count."""
    return bound(of, lambda a: F.transform(a, lambda x, i: F.least(x, *(F.get(a, i + j) for j in steps))))


def minima(hashes: Column, growing: Column, w: int = W) -> Column:
    """The least of each window as 33 bits of hash above the place, which falls; windows shrink at the end and, if growing, grow at the start."""
    missing = F.array_repeat(F.lit(None).cast("long"), w - 1)
    keys = F.transform(hashes, lambda x, i: x.bitwiseOR(F.lit(LAST).cast("long")).bitwiseXOR(i.cast("long")))
    out, m = F.concat(F.when(growing, missing).otherwise(F.array().cast(NONE)), keys), 1
    while m < w:  # windows of m elements become such of up to four times as many
        steps = [min(j * m, w - m) for j in (1, 2, 3) if (j - 1) * m < w - m]
        out, m = _least(out, steps), m + steps[-1]
    return F.when(F.size(hashes) > 0, out).otherwise(F.array().cast(NONE))


def place(key: Column) -> Column:
    return (F.lit(LAST).cast("long") - key.bitwiseAND(F.lit(LAST))).cast("int")


def _kept(keys: Column, hash_at) -> Column:
    """Distinct keys -> the grams kept: (hash, place)."""
    shown = F.lit((1 << SHOWN_BITS) - 1)
    return F.transform(keys, lambda x: F.struct(hash_at(place(x)).bitwiseAND(shown).alias("hash"), place(x).alias("place")))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """The kept grams of a text."""
    return bound(grams(text, k), lambda g: _kept(F.array_distinct(minima(g, F.lit(True), w)), lambda at: F.get(g, at)))


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: x["hash"]))


def as_text(kept: Column) -> Column:
    """hash.place hash.place ..., hexadecimal."""
    return F.lower(F.array_join(F.transform(kept, lambda x: F.concat(F.hex(x["hash"]), F.lit("."), F.hex(x["place"]))), " "))


def likeness(a: Column, b: Column) -> Column:
    """Common hashes over all hashes; 1 for two empty fingerprints."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def _range_of(doc_id: Column, h: Column, starts: list[int], null_bits: int) -> Column:
    """Number of the range: that of the last start which is not above the doc_id, by halving; null doc_ids go behind, by hash."""
    held = F.lit(starts or [0])
    between = F.struct(F.lit(0).alias("lo"), F.lit(len(starts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        before = F.get(held, mid) <= doc_id
        return F.when(s["lo"] >= s["hi"], s).when(before, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(starts).bit_length() + 1)), between, halve)["lo"]
    of_null = F.shiftright(h, 64 - null_bits) + (1 << (null_bits - 1)) if null_bits else F.lit(0)
    return F.when(doc_id.isNull(), F.lit(len(starts) + 1).cast("long") + of_null).otherwise(found.cast("long"))


def with_next(docs: DataFrame, range_bytes: int = 1 << 20, most_range_bytes: int = 512 << 20) -> DataFrame:
    """(doc_id, text, range, guest, h, next_text) of every row, and of guests: the rows of other ranges sent along.

    Ranges have range_bytes of text, from 4096 of them on more, up to most_range_bytes. The driver holds the
    start and the first row of each range, some 40 bytes for at least most_range_bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n, n_null, size = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    ranges = range_count(size, range_bytes, most_range_bytes)
    starts: list[int] = []
    if ranges > 1 and n > n_null:
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
        starts = sorted(r["first"] for r in ids.repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("first")).collect())
    null_bits = (n_null * ranges // max(n, 1)).bit_length() if ranges > 1 else 0
    ranged = rows.withColumn("range", _range_of(F.col("doc_id"), F.col("h"), starts, null_bits))
    order = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "h")
    firsts = sorted((r["range"], r["first"]["doc_id"], r["first"]["h"]) for r in ranged.groupBy("range").agg(F.min(order).alias("first")).collect()) if n else []
    every = ranged.withColumn("guest", F.lit(False))
    if firsts:
        # the first rows of each range go along with the range before; those of the first with the last
        sent = [(doc_id, h, firsts[i - 1][0]) for i, (_, doc_id, h) in enumerate(firsts)]
        first = F.broadcast(docs.sparkSession.createDataFrame(sent, "first_id long, first_h long, to_range long"))
        guests = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
        every = every.unionByName(guests.select("doc_id", "text", "h", F.col("to_range").alias("range"), F.lit(True).alias("guest")))
    return every.repartition(ranges, "range").withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), "h")


def fingerprinted(docs: DataFrame, k: int = K, w: int = W, **ranges) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, own, other, own_set, other_set, next_set): own and other, the edited text's, are the kept grams."""
    n, kept_n, following = F.length("text"), F.col("n_kept"), F.coalesce("next_text", F.lit(""))
    rows = with_next(docs, **ranges).withColumn("n_kept", n - F.floor(n / 4).cast("int"))
    rows = rows.withColumn("new_end", F.substring(following, F.lit(1), n - kept_n))
    # windows of the text that lie within what the edited text keeps; the others' grams are in tail
    rows = rows.withColumn("n_same", F.greatest(kept_n - (w + k - 2), F.lit(0)))
    same = F.col("n_same")
    tail = F.when(~F.col("guest"), F.concat(F.substring("text", same + 1, kept_n - same), F.col("new_end")))
    rows = rows.select(
        "doc_id", "range", "guest", "h", "n_kept", "n_same", n.cast("long").alias("n_chars"), F.sha2(F.concat(F.substring("text", F.lit(1), kept_n), F.col("new_end")), 256).alias("edited_sha256"),
        grams(F.col("text"), k).alias("own_grams"), grams(tail, k).alias("tail_grams"),
    )
    rows = rows.withColumn("own_least", minima(F.col("own_grams"), F.lit(True), w)).withColumn("tail_least", minima(F.col("tail_grams"), same == 0, w))
    start = F.when(same > 0, F.slice("own_least", F.lit(1), same + (w - 1))).otherwise(F.array().cast(NONE))
    rows = rows.withColumn("other_keys", F.array_distinct(F.concat(start, F.transform("tail_least", lambda x: x - same))))
    rows = rows.withColumn("own", _kept(F.array_distinct("own_least"), lambda at: F.get("own_grams", at)))
    rows = rows.withColumn("other", _kept(F.col("other_keys"), lambda at: F.when(at < same, F.get("own_grams", at)).otherwise(F.get("tail_grams", at - same))))
    rows = rows.select("doc_id", "range", "guest", "h", "n_chars", "edited_sha256", "own", "other").withColumn("own_set", hashes(F.col("own"))).withColumn("other_set", hashes(F.col("other")))
    return rows.withColumn("next_set", F.lead("own_set").over(_order())).where("not guest")


def op10_winnow_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = fingerprinted(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("other_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
