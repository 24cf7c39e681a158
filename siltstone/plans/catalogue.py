"""The catalogue: one query for each operator on the driver's tables, with its SQL.

Two snapshots come from `documents`: the old one lacks doc_ids that end in 3, the new one those that end in
7, and every fifth text is changed in the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schema as S
from siltstone.functions import paths
from siltstone.operators import delta as D
from siltstone.operators import patch, search, snapshot
from siltstone.plans.staging import shared_path, shuffles_dropped, staged
from siltstone.sources import archive, extract

#: Paths that show the safety rules.
HOSTILE = ["ok/a.txt", "", "/x", "\\x", "../x", "a../b", "a..", "a..b", "C:x", "dir/../up", "dir/..", "d" * 1023, "d" * 1024, "é/ü.txt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> F.Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def old_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 3").select(_path().alias("path"), F.col("text").alias("content"))


def new_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 7").select(_path().alias("path"), text.alias("content"))


def _old(spark, d):
    return snapshot.index(old_contents(spark, d))


def _new(spark, d):
    return snapshot.index(new_contents(spark, d))


def _offsets(spark, d):
    return snapshot.with_offsets(_new(spark, d))


def snapshot_offsets(spark, d):
    return _offsets(spark, d).select("path", "data_size", "hash", "entry_idx", "data_offset", "path_offset", snapshot.data_position(F.col("data_offset")).alias("data_position"))


def delta_dup_paths(spark, d):
    def repeated(contents, last):
        rows = contents.unionByName(contents.where(F.col("path").endswith("5.txt")).select("path", F.concat("content", F.lit(last)).alias("content")))
        return snapshot.index(rows).withColumn("entry_idx", F.col("data_size"))

    return D.delta_of_repeated(repeated(old_contents(spark, d), " twice"), repeated(new_contents(spark, d), " again")).select("path", "status", "data_size", "hash")


def delta_io_order(spark, d):
    rows = D.delta(_old(spark, d), _offsets(spark, d))
    return D.in_io_order(rows).withColumn("io_rank", F.row_number().over(Window.orderBy("new_offset", "path")).cast("long")).select("path", "status", "new_offset", "io_rank")


def delta_null_contents(spark, d):
    """Contents that are null in one snapshot or both."""

    def with_nulls(contents, ends):
        return contents.withColumn("content", F.when(~F.col("path").rlike(ends), F.col("content")))

    old, new = with_nulls(old_contents(spark, d), "[12][.]txt$"), with_nulls(new_contents(spark, d), "[24][.]txt$")
    return D.delta(snapshot.index(old), snapshot.index(new)).select("path", "status", "data_size", "hash")


def delta_keys(spark, d):
    """Keys that a plain concatenation would take for one another."""
    columns = "a string, b string, v int"
    old = spark.createDataFrame([("a/b", "c", 1), ("a", None, 2), ("x", "y", 3), ("n", "\\N", 4)], columns)
    new = spark.createDataFrame([("a", "b/c", 1), (None, "a", 2), ("x", "y", None), ("n", None, 4)], columns)
    return D.delta(D.keyed(old, "a", "b"), D.keyed(new, "a", "b")).select("path", "status", "hash")


def _day(column: str) -> F.Column:
    return F.col(column).cast("date").cast("string").alias(column)


def _money(column: str) -> F.Column:
    return F.col(column).cast("decimal(18,2)").cast("string").alias(column)


def orders_row_delta(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", _money("o_totalprice"), _day("o_orderdate"), "o_orderpriority")
    changed = orders.where("o_orderkey % 11 <> 5").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return D.delta(D.keyed(orders.where("o_orderkey % 11 <> 3"), "o_orderkey"), D.keyed(changed, "o_orderkey")).select("path", "status", "data_size", "hash")


def lineitem_row_delta(spark, d):
    """Whole rows of lineitem, whose keys repeat: old rows meet the new side's first by hash."""
    money = [_money(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *money, "l_returnflag", "l_linestatus", _day("l_shipdate"))
    changed = items.where("l_orderkey % 13 <> 5").withColumn("l_linestatus", F.when(F.col("l_orderkey") % 17 == 0, "X").otherwise(F.col("l_linestatus")))
    keys = ("l_orderkey", "l_linenumber")
    rows = D.delta_of_repeated(D.keyed(items.where("l_orderkey % 13 <> 3"), *keys), D.keyed(changed, *keys))
    # of the rows of a status: how many, their bytes, and a sum over their hashes
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.sum("data_size").alias("bytes"), F.sum(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")).alias("hash_sum"))


def search_limit(spark, d):
    return search.search(_offsets(spark, d), "src1*/e*.txt", 25).select("entry_idx", "path")


def exists_checks(spark, d):
    asked = spark.createDataFrame([(p,) for p in ("src1/en", "src1", "src1/", "src1/en/41.txt", "src", "nowhere", "")], "path string")
    return search.existing(_new(spark, d), asked)


def path_safety(spark, d):
    rows = spark.createDataFrame([(p,) for p in HOSTILE], "path string").unionByName(_old(spark, d).select("path"))
    p = F.col("path")
    return rows.select("path", paths.safe_to_write(p).alias("to_write"), paths.safe_in_patch(p).alias("in_patch"), paths.safe_to_read(p).alias("to_read"), paths.safe_in_folder(p).alias("in_folder"))


RULES = [("", "*7.txt"), ("", "fr"), ("", "# no rule"), ("src2", "de"), ("src2/en", "1*")]


def _rules(spark):
    return spark.createDataFrame(RULES, "folder string, pattern string")


def verify_hash(spark, d):
    contents = new_contents(spark, d)
    broken = contents.withColumn("content", F.when(F.col("path").endswith("9.txt"), F.concat(F.lit("x"), "content")).otherwise(F.col("content")))
    return snapshot.verified(broken, snapshot.index(contents)).select("path", "ok")


def batch_plan(spark, d):
    mib = 1 << 20
    rows = spark.createDataFrame([(v * mib, n, a * 1024) for v in (0, 255, 256, 512, 8192) for n in (0, 1, 100, 10**7) for a in (0, 1, 1024)], "free long, files long, average long")
    plan = snapshot.batch_plan(F.col("free"), F.col("files"), F.col("average"))
    return rows.select("free", "files", "average", plan["files"].alias("batch_files"), plan["bytes"].alias("batch_bytes"))


def list_json(spark, d):
    return snapshot.listing_json(_new(spark, d))


def patch_create(spark, d):
    rows = patch.create(old_contents(spark, d), new_contents(spark, d))
    # of a block delta: its size and its head (magic, count of instructions, old size); of whole contents: their hash
    delta_head = F.when(F.col("flags") == S.FLAG_BINARY_DELTA, F.hex(F.substring("payload", 1, S.DELTA_HEADER_BYTES)))
    return rows.select("path", "flags", "hash", "data_size", delta_head.alias("head"), F.when(F.col("flags") == 0, F.sha2("payload", 256)).alias("payload_hash"))


def patch_instructions(spark, d):
    return patch.instruction_counts(patch.create(old_contents(spark, d), new_contents(spark, d)))


def patch_apply(spark, d):
    old, new = old_contents(spark, d), new_contents(spark, d)
    made = patch.apply(old, patch.create(old, new))
    return made.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("data_size"))


def patch_errors(spark, d):
    old, new = old_contents(spark, d), new_contents(spark, d)
    made = patch.create(old, new)
    # the old table that the patch meets lacks some files, so that deltas and deletions fail
    return patch.error_count(patch.outcome(old.where(~F.col("path").endswith("5.txt")), made))


def sync_from_table(spark, d):
    old, new = old_contents(spark, d), new_contents(spark, d)
    made = patch.sync(old, new, D.delta(snapshot.index(old), snapshot.index(new)))
    return made.select("path", F.sha2("content", 256).alias("hash"))


def gather_in_order(spark, d):
    new = new_contents(spark, d)
    return patch.gathered(new, D.delta(_old(spark, d), _offsets(spark, d))).select("new_offset", "path", F.sha2("content", 256).alias("hash"))


def _folder(spark, what: str) -> str:
    import os

    folder = archive.local(shared_path(spark, what))
    os.makedirs(folder, exist_ok=True)
    return folder


def _archive(spark, d, **options):
    archive.register(spark)
    file = f"{_folder(spark, 'archive')}/documents.arc"
    rows = new_contents(spark, d).select("path", F.col("content").cast("binary").alias("content"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(tasks, "path").sortWithinPartitions("path").write.format("siltstone_archive").mode("append").options(path=file, **options).save()
    return file


def _files(spark, d, **options):
    return spark.read.format("siltstone_archive").options(view="files", **options).load(_archive(spark, d))


def _tree(spark, d) -> str:
    """The new contents as files in a folder, with an ignore file at its root."""
    archive.register(spark)
    folder = _folder(spark, "tree")
    extract.extract(new_contents(spark, d), folder).write.format("noop").mode("overwrite").save()
    with open(f"{folder}/{S.IGNORE_FILE}", "w", encoding="utf-8") as f:
        f.write("# rules\n\n*7.txt\nfr\n")
    return folder


def folder_index(spark, d):
    """A folder walked with its ignore rules, hashed where the files are."""
    read = spark.read.format("siltstone_folder").options(path=_tree(spark, d), contents="false").load()
    return read.where(F.col("path") != S.IGNORE_FILE).select("path", "data_size", "hash")


def extract_all(spark, d):
    """All files of an archive written with their hashes checked, then read back."""
    folder = _folder(spark, "extracted")
    states = extract.extract(_files(spark, d), folder, verify=True)
    read = spark.read.format("siltstone_folder").options(path=folder).load()
    states = staged(states, "extract-states")
    return read.join(states, "path").select("path", "state", F.sha2("content", 256).alias("hash"))


def extract_again(spark, d):
    """A second extraction over old files, with and without overwriting."""
    folder = _folder(spark, "extracted")
    extract.extract(old_contents(spark, d), folder).write.format("noop").mode("overwrite").save()
    kept = staged(extract.extract(new_contents(spark, d), folder, overwrite=False).withColumn("overwrite", F.lit(False)), "extract-kept")
    extract.remove(new_contents(spark, d).join(old_contents(spark, d).select("path"), "path", "left_anti"), folder).write.format("noop").mode("overwrite").save()
    return kept.unionByName(staged(extract.extract(new_contents(spark, d), folder).withColumn("overwrite", F.lit(True)), "extract-written"))


def extract_single(spark, d):
    """One file by its path, the reader taking no other content; a missing one is an error."""
    folder, files = _folder(spark, "extracted"), _files(spark, d)
    try:
        extract.extract_one(files, "src1/en/none", folder)
    except FileNotFoundError:
        return staged(extract.extract_one(files, _one(spark, d), folder, verify=True), "extract-one")
    raise AssertionError("a missing file was extracted")


def _one(spark, d) -> str:
    return new_contents(spark, d).agg(F.min("path")).first()[0]


def extract_subfolder(spark, d):
    """The files of a folder, below another name."""
    folder = _folder(spark, "extracted")
    states = staged(extract.extract_folder(_files(spark, d), "src1/en", folder, "out/"), "extract-folder")
    read = spark.read.format("siltstone_folder").options(path=folder).load()
    return read.join(states, "path").select("path", "state", F.sha2("content", 256).alias("hash"))


def apply_to_folder(spark, d):
    """A patch brought to a folder of old files, which then holds the new ones."""
    archive.register(spark)
    folder, old = _folder(spark, "patched"), old_contents(spark, d)
    # the patch is made before the files are there, so that its shuffles and they never share the disk
    with shuffles_dropped(spark):
        made = staged(patch.create(old, new_contents(spark, d)), "patch")
        results = staged(patch.outcome(old, made), "patch-results")
    extract.extract(old, folder).write.format("noop").mode("overwrite").save()
    extract.apply_outcome(results, folder).write.format("noop").mode("overwrite").save()
    return spark.read.format("siltstone_folder").options(path=folder, contents="false").load().select("path", "data_size", "hash")


def sync_from_archive(spark, d):
    """A delta applied with an archive as the source of contents."""
    old, new = old_contents(spark, d), new_contents(spark, d)
    made = patch.sync(old, _files(spark, d).select("path", "content"), D.delta(snapshot.index(old), snapshot.index(new)))
    return made.select("path", F.sha2("content", 256).alias("hash"))


def archive_point_read(spark, d):
    """One entry by its ordinal; the reader opens that entry alone."""
    return _files(spark, d).where("entry_idx = 17").select("entry_idx", "path", F.sha2("content", 256).alias("hash"))


def archive_byte_range(spark, d):
    """A range of bytes of each content, read from its place in the archive."""
    return _files(spark, d, offset="100", size="50").select("path", F.sha2("content", 256).alias("part_hash"), F.octet_length("content").cast("long").alias("size"))


def header_checks(spark, d):
    """damaged archives, and what reading them says."""
    file = _archive(spark, d, index_only="true")
    with open(file, "rb") as f:
        raw = f.read()
    folder, out = _folder(spark, "damaged"), []
    for name, damaged, view in (("magic", b"XXXX" + raw[4:], "header"), ("short", raw[:20], "header"), ("index", raw[:100], "entries"), ("no data", raw, "files"), ("whole", raw, "entries")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(damaged)
        try:
            reader = archive.ArchiveReader(f"{folder}/{name}", view, (0, None))
            reader.partitions()
            if view == "header":
                archive.read_header(f"{folder}/{name}")
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "archive string, ok boolean")


def archive_entries(spark, d):
    read = spark.read.format("siltstone_archive").option("view", "entries").load(_archive(spark, d))
    return read.select("entry_idx", "path", "flags", "data_offset", "data_size", F.lower(F.hex("hash")).alias("hash"))


def archive_files(spark, d):
    return _files(spark, d).select("path", F.sha2("content", 256).alias("found"), F.lower(F.hex("hash")).alias("hash"))


def archive_header(spark, d):
    read = spark.read.format("siltstone_archive").option("view", "header").load(_archive(spark, d))
    return read.select("version", "flags", "file_count", "index_offset", "path_offset")


def archive_index_only(spark, d):
    file = _archive(spark, d, index_only="true")
    read = spark.read.format("siltstone_archive").option("view", "entries").load(file)
    return read.select("path", "data_offset", "data_size", F.lower(F.hex("hash")).alias("hash"))


_CTE = r"""
WITH d AS (SELECT *, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents),
oc AS (SELECT path, text AS content FROM d WHERE doc_id % 10 <> 3),
nc AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN text || ' v2' ELSE text END AS content FROM d WHERE doc_id % 10 <> 7),
o AS (SELECT path, CAST(strlen(content) AS BIGINT) AS data_size, sha256(content) AS hash FROM oc),
n AS (SELECT path, CAST(strlen(content) AS BIGINT) AS data_size, sha256(content) AS hash FROM nc),
no AS (SELECT path, data_size, hash, CAST(row_number() OVER w - 1 AS BIGINT) AS entry_idx,
       CAST(coalesce(sum(data_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset,
       CAST(coalesce(sum(strlen(path)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS path_offset
       FROM n WINDOW w AS (ORDER BY path)),
dl AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'DELETED' WHEN o.path IS NULL THEN 'ADDED' ELSE 'UPDATED' END AS status,
       CASE WHEN n.path IS NULL THEN 0 ELSE n.data_offset END AS new_offset, CASE WHEN n.path IS NULL THEN 0 ELSE n.data_size END AS data_size, n.hash AS hash
       FROM o FULL OUTER JOIN no n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.hash IS DISTINCT FROM n.hash)
"""


def _blocks(t: str) -> str:
    return f"(SELECT path, CAST(b AS BIGINT) AS block_no, CAST(b * 4096 AS BIGINT) AS \"offset\", encode(content)[b * 4096 + 1 : b * 4096 + 4096] AS block FROM (SELECT path, content, unnest(range(0, CAST(ceil(strlen(content) / 4096.0) AS BIGINT))) AS b FROM {t}))"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _json(**fields: str) -> str:
    """An expression for a JSON object of these fields; braces are doubled for format."""
    return " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items()).join(("'{{' || ", " || '}}'"))


def _text(expression: str) -> str:
    return f"'\"' || CAST({expression} AS VARCHAR) || '\"'"


def _cents(column: str) -> str:
    return _text(f"CAST({column} AS DECIMAL(18,2))")


_ORDER = _json(o_custkey="o_custkey", o_orderstatus=_text("{status}"), o_totalprice=_cents("o_totalprice"), o_orderdate=_text("CAST(o_orderdate AS DATE)"), o_orderpriority=_text("o_orderpriority"))
_ITEM = _json(
    l_partkey="l_partkey", l_suppkey="l_suppkey", l_quantity=_cents("l_quantity"), l_extendedprice=_cents("l_extendedprice"), l_discount=_cents("l_discount"), l_tax=_cents("l_tax"),
    l_returnflag=_text("l_returnflag"), l_linestatus=_text("{status}"), l_shipdate=_text("CAST(l_shipdate AS DATE)"),
)
#: A number of eight bytes, the least first, as hexadecimal digits; and copies and bytes of the block delta of a text with its old one as start.
_LITTLE = " || ".join(f"format('{{:02X}}', (({{0}}) >> {8 * i}) & 255)" for i in range(8)).replace("{:02X}", "{{:02X}}")
_DELTAS = "dd AS (SELECT dl.path, o.data_size AS old_size, o.data_size // 4096 AS copies, 16 + 13 * (o.data_size // 4096) + 13 + dl.data_size - 4096 * (o.data_size // 4096) AS bytes FROM dl JOIN o USING (path) WHERE status = 'UPDATED')"

#: name -> (query, SQL after the shared tables, or None)
QUERIES: dict = {
    "delta_full": (lambda s, d: D.delta(_old(s, d), _offsets(s, d)), "SELECT * FROM dl"),
    "snapshot_index": (_new, "SELECT * FROM n"),
    "snapshot_offsets": (snapshot_offsets, "SELECT *, 32 + data_offset AS data_position FROM no"),
    "snapshot_header": (lambda s, d: snapshot.header(_new(s, d)), "SELECT count(*) AS file_count, CAST(sum(data_size) AS BIGINT) AS data_bytes, CAST(sum(strlen(path)) AS BIGINT) AS path_bytes, CAST(32 + sum(data_size) AS BIGINT) AS index_offset, CAST(32 + sum(data_size) + 64 * count(*) AS BIGINT) AS path_offset, CAST(32 + sum(data_size) + 64 * count(*) + sum(strlen(path)) AS BIGINT) AS metadata_end, 0 AS flags FROM n"),
    "snapshot_batches": (lambda s, d: snapshot.with_batches(_offsets(s, d), 100, 1 << 20).select("path", "batch_no", "batch_offset"), "SELECT path, b AS batch_no, data_offset - min(data_offset) OVER (PARTITION BY b) AS batch_offset FROM (SELECT path, data_offset, CAST(greatest(entry_idx // 100, data_offset // 1048576) AS BIGINT) AS b FROM no)"),
    "multi_root_union": (lambda s, d: snapshot.union_of_roots(_old(s, d), _new(s, d)), "SELECT * FROM o UNION ALL SELECT * FROM n"),
    "export_index": (lambda s, d: snapshot.exported(_offsets(s, d), S.FLAG_INDEX_ONLY), "SELECT entry_idx, path, 2 AS flags, CAST(0 AS BIGINT) AS data_offset, data_size, hash, path_offset FROM no"),
    "delta_added": (lambda s, d: D.added(_old(s, d), _new(s, d)), "SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path)"),
    "delta_deleted": (lambda s, d: D.deleted(_old(s, d), _new(s, d)), "SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.path = n.path)"),
    "delta_updated": (lambda s, d: D.updated(_old(s, d), _new(s, d)), "SELECT n.path, n.data_size, n.hash, o.hash AS old_hash FROM n JOIN o ON o.path = n.path AND o.hash <> n.hash"),
    "delta_none": (lambda s, d: D.delta(_new(s, d), _offsets(s, d)), "SELECT no.path, 'UPDATED' AS status, no.data_offset AS new_offset, no.data_size, no.hash FROM n FULL OUTER JOIN no ON n.path = no.path WHERE n.hash IS DISTINCT FROM no.hash"),
    "delta_summary": (lambda s, d: D.summary(D.delta(_old(s, d), _new(s, d))), "SELECT status, count(*) AS files, CAST(sum(data_size) AS BIGINT) AS bytes FROM dl GROUP BY status"),
    "delta_dup_paths": (delta_dup_paths, r""", o2 AS (SELECT path, content FROM oc UNION ALL SELECT path, content || ' twice' FROM oc WHERE path LIKE '%5.txt'),
        n2 AS (SELECT path, strlen(content) AS data_size, sha256(content) AS hash, row_number() OVER (PARTITION BY path ORDER BY strlen(content)) AS r FROM (SELECT path, content FROM nc UNION ALL SELECT path, content || ' again' FROM nc WHERE path LIKE '%5.txt'))
        SELECT coalesce(n2.path, o2.path) AS path, CASE WHEN n2.path IS NULL THEN 'DELETED' WHEN o2.path IS NULL THEN 'ADDED' ELSE 'UPDATED' END AS status, CAST(coalesce(n2.data_size, 0) AS BIGINT) AS data_size, n2.hash AS hash
        FROM o2 FULL OUTER JOIN (SELECT * FROM n2 WHERE r = 1) n2 ON o2.path = n2.path WHERE o2.path IS NULL OR n2.path IS NULL OR sha256(o2.content) <> n2.hash
        UNION ALL SELECT path, 'ADDED', CAST(data_size AS BIGINT), hash FROM n2 WHERE r > 1"""),
    "delta_io_order": (delta_io_order, "SELECT path, status, new_offset, row_number() OVER (ORDER BY new_offset, path) AS io_rank FROM dl"),
    "delta_except_check": (lambda s, d: D.changed_rows(_old(s, d), _new(s, d)), "SELECT *, 'old' AS side FROM (SELECT path, hash FROM o EXCEPT ALL SELECT path, hash FROM n) UNION ALL SELECT *, 'new' FROM (SELECT path, hash FROM n EXCEPT ALL SELECT path, hash FROM o)"),
    "delta_null_contents": (delta_null_contents, r""", ob AS (SELECT path, CASE WHEN regexp_matches(path, '[12][.]txt$') THEN NULL ELSE content END AS c FROM oc),
        na AS (SELECT path, CASE WHEN regexp_matches(path, '[24][.]txt$') THEN NULL ELSE content END AS c FROM nc)
        SELECT coalesce(na.path, ob.path) AS path, CASE WHEN na.path IS NULL THEN 'DELETED' WHEN ob.path IS NULL THEN 'ADDED' ELSE 'UPDATED' END AS status,
        CASE WHEN na.path IS NULL THEN 0 ELSE CAST(strlen(na.c) AS BIGINT) END AS data_size, sha256(na.c) AS hash
        FROM ob FULL OUTER JOIN na ON ob.path = na.path WHERE ob.path IS NULL OR na.path IS NULL OR ob.c IS DISTINCT FROM na.c"""),
    "delta_keys": (delta_keys, r"""SELECT path, status, CASE WHEN j <> '' THEN sha256(j) END AS hash FROM (VALUES ('a\/b/c', 'DELETED', ''), ('a/\N', 'DELETED', ''), ('n/\\N', 'DELETED', ''), ('a/b\/c', 'ADDED', '{"v":1}'),
        ('\N/a', 'ADDED', '{"v":2}'), ('x/y', 'UPDATED', '{}'), ('n/\N', 'ADDED', '{"v":4}')) v(path, status, j)"""),
    "orders_row_delta": (orders_row_delta, rf""", ob AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, {_ORDER.format(status="o_orderstatus")} AS j FROM orders WHERE o_orderkey % 11 <> 3),
        na AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, {_ORDER.format(status="CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END")} AS j FROM orders WHERE o_orderkey % 11 <> 5)
        SELECT coalesce(na.path, ob.path) AS path, CASE WHEN na.path IS NULL THEN 'DELETED' WHEN ob.path IS NULL THEN 'ADDED' ELSE 'UPDATED' END AS status, CASE WHEN na.path IS NULL THEN 0 ELSE CAST(strlen(na.j) AS BIGINT) END AS data_size,
        sha256(na.j) AS hash FROM ob FULL OUTER JOIN na ON ob.path = na.path WHERE ob.path IS NULL OR na.path IS NULL OR ob.j <> na.j"""),
    "lineitem_row_delta": (lineitem_row_delta, rf""", ob AS (SELECT l_orderkey || '/' || l_linenumber AS path, sha256({_ITEM.format(status="l_linestatus")}) AS h FROM lineitem WHERE l_orderkey % 13 <> 3),
        na AS (SELECT path, strlen(j) AS n, sha256(j) AS h FROM (SELECT l_orderkey || '/' || l_linenumber AS path, {_ITEM.format(status="CASE WHEN l_orderkey % 17 = 0 THEN 'X' ELSE l_linestatus END")} AS j FROM lineitem WHERE l_orderkey % 13 <> 5)),
        nr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY h) AS r FROM na),
        rows_of AS (SELECT CASE WHEN n1.path IS NULL THEN 'DELETED' WHEN ob.path IS NULL THEN 'ADDED' ELSE 'UPDATED' END AS status, n1.n, n1.h
            FROM ob FULL OUTER JOIN (SELECT * FROM nr WHERE r = 1) n1 ON ob.path = n1.path WHERE ob.path IS NULL OR n1.path IS NULL OR ob.h <> n1.h
            UNION ALL SELECT 'ADDED', n, h FROM nr WHERE r > 1)
        SELECT status, count(*) AS files, CAST(sum(coalesce(n, 0)) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS hash_sum FROM rows_of GROUP BY status"""),
    "search_glob": (lambda s, d: search.search(_new(s, d), "src1*/*1.txt"), "SELECT * FROM n WHERE path LIKE 'src1%/%1.txt'"),
    "search_prefix": (lambda s, d: search.search(_new(s, d), "src12/*"), "SELECT * FROM n WHERE starts_with(path, 'src12/')"),
    "search_count": (lambda s, d: search.match_count(_new(s, d), "*.txt"), "SELECT count(*) AS matches FROM n WHERE path LIKE '%.txt'"),
    "search_limit": (search_limit, "SELECT entry_idx, path FROM no WHERE path LIKE 'src1%/e%.txt' ORDER BY entry_idx LIMIT 25"),
    "point_read": (lambda s, d: search.at(_offsets(s, d), 17).select("entry_idx", "path", "hash"), "SELECT entry_idx, path, hash FROM no WHERE entry_idx = 17"),
    "byte_range": (lambda s, d: search.byte_range(new_contents(s, d), 100, 50).select("path", F.sha2("part", 256).alias("part_hash"), F.octet_length("part").cast("long").alias("size")), "SELECT path, sha256(part) AS part_hash, CAST(octet_length(part) AS BIGINT) AS size FROM (SELECT path, encode(content)[101:150] AS part FROM nc)"),
    "exists_checks": (exists_checks, r"""SELECT p AS path, EXISTS (SELECT 1 FROM n WHERE path = p) AS is_file, EXISTS (SELECT 1 FROM n WHERE p <> '' AND starts_with(path, p || '/')) AS is_folder
        FROM (VALUES ('src1/en'), ('src1'), ('src1/'), ('src1/en/41.txt'), ('src'), ('nowhere'), ('')) v(p)"""),
    "folder_extract": (lambda s, d: search.folder(_new(s, d), "src1/en", "out/"), "SELECT *, 'out/' || path[9:] AS target FROM n WHERE starts_with(path, 'src1/en/')"),
    "folder_extract_bare": (lambda s, d: search.folder(_new(s, d), "src1", "out", strict=False), "SELECT *, 'out' || path[5:] AS target FROM n WHERE starts_with(path, 'src1')"),
    "path_safety": (path_safety, r""", p AS (SELECT path FROM (VALUES """ + _values((x,) for x in HOSTILE) + r""") v(path) UNION ALL SELECT path FROM o)
        SELECT path, path <> '' AND strlen(path) <= 1023 AND NOT regexp_matches(path, '^[/\\]') AND NOT contains(path, '..') AND NOT contains(path, ':') AS to_write,
        path <> '' AND NOT regexp_matches(path, '^[/\\]') AND NOT contains(path, '..') AS in_patch,
        NOT regexp_matches(path, '^[/\\]') AND NOT regexp_matches(path, '\.\.([/\\]|$)') AS to_read,
        NOT regexp_matches(path, '^[/\\]') AND NOT contains(path, '..') AS in_folder FROM p"""),
    "ignore_filter": (lambda s, d: search.ignored(_new(s, d), _rules(s)), "SELECT * FROM n WHERE NOT (path LIKE '%7.txt' OR '/' || path LIKE '%/fr/%')"),
    "ignore_recursive": (lambda s, d: search.ignored(_new(s, d), _rules(s), recursive=True), "SELECT * FROM n WHERE NOT (split_part(path, '/', 2) = 'fr' OR starts_with(path, 'src2/de/') OR starts_with(path, 'src2/en/1'))"),
    "verify_hash": (verify_hash, "SELECT path, path NOT LIKE '%9.txt' AS ok FROM n"),
    "smart_overwrite": (lambda s, d: snapshot.not_there(_new(s, d), _old(s, d), same_content=True), "SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path AND o.hash = n.hash)"),
    "no_overwrite": (lambda s, d: snapshot.not_there(_new(s, d), _old(s, d)), "SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path)"),
    "path_projection": (lambda s, d: _new(s, d).select("path", paths.basename(F.col("path")).alias("name"), paths.staged_name(F.col("path")).alias("staged")), "SELECT path, split_part(path, '/', 3) AS name, path || '.paf_stage' AS staged FROM n"),
    "block_split": (lambda s, d: patch.split(old_contents(s, d)), f"SELECT path, block_no, \"offset\", CAST(octet_length(block) AS BIGINT) AS size, sha256(block) AS block_hash FROM {_blocks('oc')}"),
    "block_reuse": (lambda s, d: patch.reuse(old_contents(s, d), new_contents(s, d)), f", ob AS (SELECT path, sha256(block) AS h, max(\"offset\") AS old_offset FROM {_blocks('oc')} WHERE octet_length(block) = 4096 GROUP BY ALL) SELECT b.path, block_no, \"offset\", old_offset FROM {_blocks('nc')} b JOIN ob ON ob.path = b.path AND ob.h = sha256(b.block) WHERE octet_length(b.block) = 4096"),
    "literal_chunks": (lambda s, d: patch.literal_chunks(new_contents(s, d)), "SELECT path, c AS chunk, c * 65535 AS \"offset\", CAST(least(65535, data_size - c * 65535) AS BIGINT) AS size FROM (SELECT path, data_size, unnest(range(0, CAST(ceil(data_size / 65535.0) AS BIGINT))) AS c FROM n)"),
    "batch_plan": (batch_plan, r""", b AS (SELECT CAST(v AS BIGINT) * 1048576 AS free, n AS files, a * 1024 AS average FROM (SELECT unnest([0, 255, 256, 512, 8192]) AS v) CROSS JOIN (SELECT unnest([0, 1, 100, 10000000]) AS n) CROSS JOIN (SELECT unnest([0, 1, 1024]) AS a)),
        c AS (SELECT CAST(free AS BIGINT) AS free, CAST(files AS BIGINT) AS files, CAST(average AS BIGINT) AS average, CAST(greatest(least(greatest(free - 268435456, 0) // (64 + average), files), 1) AS BIGINT) AS batch_files FROM b)
        SELECT *, batch_files * average AS batch_bytes FROM c"""),
    "list_json": (list_json, "SELECT path, '{\"path\":\"' || path || '\",\"size\":' || data_size || '}' AS json FROM n"),
    "patch_create": (patch_create, f""", {_DELTAS} SELECT dl.path, CASE status WHEN 'ADDED' THEN 0 WHEN 'UPDATED' THEN 8 ELSE 4 END AS flags, hash, CAST(CASE status WHEN 'UPDATED' THEN bytes ELSE data_size END AS BIGINT) AS data_size,
        CASE status WHEN 'UPDATED' THEN '50414644' || substr({_LITTLE.format("copies + 1")}, 1, 8) || {_LITTLE.format("old_size")} END AS head, CASE status WHEN 'ADDED' THEN hash END AS payload_hash FROM dl LEFT JOIN dd USING (path)"""),
    "patch_instructions": (patch_instructions, f", {_DELTAS} SELECT path, copies, CAST(1 AS BIGINT) AS literals FROM dd"),
    "patch_apply": (patch_apply, "SELECT path, hash, data_size FROM n"),
    "patch_errors": (patch_errors, "SELECT count(*) AS errors FROM dl WHERE status <> 'ADDED' AND path LIKE '%5.txt'"),
    "sync_from_table": (sync_from_table, "SELECT path, hash FROM n"),
    "gather_in_order": (gather_in_order, "SELECT new_offset, path, hash FROM dl WHERE status <> 'DELETED'"),
    "folder_index": (folder_index, "SELECT * FROM n WHERE NOT (path LIKE '%7.txt' OR '/' || path LIKE '%/fr/%')"),
    "extract_all": (extract_all, "SELECT path, 'written' AS state, hash FROM n"),
    "extract_again": (extract_again, "SELECT n.path, CASE WHEN o.path IS NULL THEN 'written' ELSE 'kept' END AS state, false AS overwrite FROM n LEFT JOIN o USING (path) UNION ALL SELECT n.path, CASE WHEN o.hash = n.hash THEN 'same' ELSE 'written' END, true FROM n LEFT JOIN o USING (path)"),
    "extract_single": (extract_single, "SELECT min(path) AS path, 'written' AS state FROM n"),
    "extract_subfolder": (extract_subfolder, "SELECT 'out/' || path[9:] AS path, 'written' AS state, hash FROM n WHERE starts_with(path, 'src1/en/')"),
    "apply_to_folder": (apply_to_folder, "SELECT path, data_size, hash FROM n"),
    "sync_from_archive": (sync_from_archive, "SELECT path, hash FROM n"),
    "archive_point_read": (archive_point_read, "SELECT entry_idx, path, hash FROM no WHERE entry_idx = 17"),
    "archive_byte_range": (archive_byte_range, "SELECT path, sha256(part) AS part_hash, CAST(octet_length(part) AS BIGINT) AS size FROM (SELECT path, encode(content)[101:150] AS part FROM nc)"),
    "header_checks": (header_checks, "SELECT * FROM (VALUES ('magic', false), ('short', false), ('index', false), ('no data', false), ('whole', true)) v(archive, ok)"),
    "archive_entries": (archive_entries, "SELECT entry_idx, path, 0 AS flags, data_offset, data_size, hash FROM no"),
    "archive_files": (archive_files, "SELECT path, hash AS found, hash FROM n"),
    "archive_header": (archive_header, "SELECT CAST(1 AS BIGINT) AS version, 0 AS flags, count(*) AS file_count, CAST(32 + sum(data_size) AS BIGINT) AS index_offset, CAST(32 + sum(data_size) + 64 * count(*) AS BIGINT) AS path_offset FROM n"),
    "archive_index_only": (archive_index_only, "SELECT path, CAST(0 AS BIGINT) AS data_offset, data_size, hash FROM n"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _CTE + sql for name, (_, sql) in QUERIES.items() if sql}
