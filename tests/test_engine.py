import hashlib
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from siltstone import schema as S
from siltstone.functions import paths
from siltstone.operators import delta as D
from siltstone.operators import patch, search, snapshot
from siltstone.plans import catalogue, staging
from siltstone.sources import archive, extract

HELLO = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def contents(spark, files):
    return spark.createDataFrame([(p, c.encode() if isinstance(c, str) else c) for p, c in files.items()], "path string, content binary")


@pytest.fixture(scope="module")
def src(spark):
    return contents(spark, {"a.txt": "hello", "b.txt": "world"})


@pytest.fixture(scope="module")
def v2(spark):
    return contents(spark, {"a.txt": "v2", "b.txt": "world"})


def delta_of(a, b):
    return {r.path: r.status for r in D.delta(snapshot.index(a), snapshot.index(b)).collect()}


def test_index_and_listing(src):
    rows = {r.path: r for r in snapshot.index(src).collect()}
    assert len(rows) == 2 and rows["a.txt"].hash == HELLO and rows["a.txt"].data_size == 5
    assert {r.json for r in snapshot.listing_json(snapshot.index(src)).collect()} == {'{"path":"a.txt","size":5}', '{"path":"b.txt","size":5}'}


def test_delta(spark, src, v2):
    assert delta_of(src, src) == {}
    assert delta_of(src, v2) == {"a.txt": "UPDATED"}
    assert delta_of(src, contents(spark, {"b.txt": "world", "c.txt": ""})) == {"a.txt": "DELETED", "c.txt": "ADDED"}


def test_delta_of_repeated_paths(spark):
    def entries(rows):
        return spark.createDataFrame([(i, p, h, 1) for i, (p, h) in enumerate(rows)], "entry_idx long, path string, hash string, data_size long")

    out = D.delta_of_repeated(entries([("a", "1"), ("a", "2")]), entries([("a", "1"), ("a", "1"), ("b", "3")])).collect()
    assert sorted((r.path, r.status) for r in out) == [("a", "ADDED"), ("a", "UPDATED"), ("b", "ADDED")]


def test_search(src):
    held = snapshot.with_offsets(snapshot.index(src))
    for pattern, n in (("*.txt", 2), ("a.txt", 1), ("*.png", 0), ("*", 2), ("a*", 1)):
        assert search.search(held, pattern, 16).count() == n
    assert search.search(held, "*.txt", 1).first().path == "a.txt"
    with pytest.raises(ValueError):
        search.search(held, "*", 0)
    assert search.file_exists(held, "a.txt") and not search.file_exists(held, "a")


def test_only_the_star_is_special(spark):
    names = ["a?b", "a[b]", "a%b", "a_b", "a!b", "axb", "a\\b", "d/e/f", ""]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    for pattern, want in (("a?b", {"a?b"}), ("a[b]", {"a[b]"}), ("a%*", {"a%b"}), ("*_b", {"a_b"}), ("a!*b", {"a!b"}), ("a\\*", {"a\\b"}), ("d*f", {"d/e/f"}), ("*", set(names)), ("", {""}), ("**", set(names))):
        assert {r.path for r in rows.where(paths.glob(F.col("path"), pattern)).collect()} == want
        both = rows.withColumn("p", F.lit(pattern))
        assert {r.path for r in both.where(paths.glob_column(F.col("path"), F.col("p"))).collect()} == want


def test_folders(spark):
    held = snapshot.with_offsets(snapshot.index(contents(spark, {"foo/x": "1", "foobar/y": "2", "foo/../z": "3", "foo/d/e": ""})))
    assert search.folder_exists(held, "foo") and not search.folder_exists(held, "fo") and not search.folder_exists(held, "foo/") and not search.folder_exists(held, "")
    assert {(r.path, r.target) for r in search.folder(held, "foo", "out/").collect()} == {("foo/x", "out/x"), ("foo/d/e", "out/d/e")}
    assert {r.path for r in search.folder(held, "foo", strict=False).collect()} == {"foo/x", "foobar/y", "foo/d/e"}
    assert search.folder(held, "fo", strict=False).count() == 0


def test_path_safety(spark):
    want = {"ok/a.txt": (1, 1, 1), "": (0, 0, 1), "/x": (0, 0, 0), "\\x": (0, 0, 0), "../x": (0, 0, 0), "a../b": (0, 0, 0), "a..": (0, 0, 0), "a..b": (0, 0, 1), "C:x": (0, 1, 1), "d" * 1023: (1, 1, 1), "d" * 1024: (0, 1, 1)}
    p = F.col("path")
    rows = spark.createDataFrame([(k,) for k in want], "path string").select("path", paths.safe_to_write(p), paths.safe_in_patch(p), paths.safe_to_read(p)).collect()
    assert {r[0]: tuple(map(int, r[1:])) for r in rows} == want


def test_offsets_and_header(spark):
    files = {f"d{i % 7}/é{i:04d}": "x" * (i % 13) for i in range(300)}
    held = snapshot.with_offsets(snapshot.index(contents(spark, files)), 5).orderBy("entry_idx").collect()
    at = names = 0
    for i, r in enumerate(held):
        assert (r.entry_idx, r.data_offset, r.path_offset) == (i, at, names) and r.path == sorted(files)[i]
        at, names = at + len(files[r.path]), names + len(r.path.encode())
    head = snapshot.header(snapshot.index(contents(spark, files))).first()
    assert (head.file_count, head.index_offset, head.path_offset) == (300, 32 + at, 32 + at + 64 * 300)
    assert snapshot.header(snapshot.index(contents(spark, {"a": "b"}).limit(0))).first().path_offset == 32


def test_patch_round_trip(spark):
    rng = random.Random(2)
    block = rng.randbytes(3 * S.BLOCK)
    old = contents(spark, {"same": "s", "gone": "g", "moved": block, "empty": b"", "large": block})
    new_files = {"same": b"s", "moved": b"x" + block, "empty": b"now", "large": b"", "fresh": block[:10]}
    new = contents(spark, new_files)
    made = patch.create(old, new)
    flags = {r.path: r.flags for r in made.collect()}
    assert flags == {"gone": 4, "moved": 8, "empty": 8, "large": 8, "fresh": 0}
    assert {r.path: bytes(r.content) for r in patch.apply(old, made).collect()} == new_files
    assert {r.path: r.flags for r in patch.create(old, new, most_old=100).collect()}["moved"] == 0
    broken = made.withColumn("hash", F.when(F.col("path") == "fresh", F.repeat(F.lit("0"), 64)).otherwise(F.col("hash")))
    broken = broken.unionByName(made.where("path = 'fresh'").withColumn("path", F.lit("../up"))).unionByName(made.where("path = 'gone'").withColumn("path", F.lit("never")))
    results = patch.outcome(old, broken)
    assert {r.path for r in results.where("error is not null").collect()} == {"fresh", "../up", "never"}
    assert patch.error_count(results).first().errors == 3
    assert {r.path for r in patch.merged(old, results).collect()} == {"same", "moved", "empty", "large"}


def test_folder_source(spark, tmp_path):
    archive.register(spark)
    for p, c in {".hidden": "h", "_x": "", "a b%.txt": "t", "d/e/f.log": "1", "d/e/g.txt": "2", "d/.pafignore": "*.log\n", "d/e/.pafignore": "# c\n\ng.txt\n", "skip/z": "3", ".pafignore": "skip\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)

    def read(**options):
        return {r.path for r in spark.read.format("siltstone_folder").options(path=str(tmp_path), **options).load().collect()}

    everything = {".hidden", "_x", "a b%.txt", "d/e/f.log", "d/e/g.txt", "d/.pafignore", "d/e/.pafignore", ".pafignore"}
    assert read() == everything
    assert read(recursive="true") == everything - {"d/e/f.log", "d/e/g.txt"}
    assert read(glob="*.txt") == {"a b%.txt", "d/e/g.txt"}
    meta = spark.read.format("siltstone_folder").options(path=str(tmp_path), contents="false").load()
    assert "content" not in meta.columns and meta.count() == len(everything)
    with pytest.raises(FileNotFoundError):
        archive.walk(str(tmp_path / "none"))


def test_archive_round_trip_and_bytes(spark, src, tmp_path):
    archive.register(spark)
    file = str(tmp_path / "x.arc")
    src.coalesce(1).sortWithinPartitions("path").write.format("siltstone_archive").mode("append").options(path=file).save()
    raw = open(file, "rb").read()
    assert struct.unpack_from(S.HEADER, raw) == (b"PAF1", 1, 0, 2, 42, 170) and raw[32:42] == b"helloworld" and raw[170:] == b"a.txtb.txt"
    assert struct.unpack_from(S.ENTRY, raw, 42) == (0, 5, 0, 0, 5, bytes.fromhex(HELLO))
    files = spark.read.format("siltstone_archive").option("view", "files").load(file)
    assert {r.path: bytes(r.content) for r in files.collect()} == {"a.txt": b"hello", "b.txt": b"world"}
    assert sorted(os.listdir(tmp_path)) == ["x.arc"]
    for name, damaged in (("magic", b"XXXX" + raw[4:]), ("short", raw[:20]), ("index", raw[:100])):
        (tmp_path / name).write_bytes(damaged)
        with pytest.raises(Exception, match="archive|header|index"):
            spark.read.format("siltstone_archive").load(str(tmp_path / name)).collect()


def test_index_only_has_no_files(spark, src, tmp_path):
    archive.register(spark)
    file = str(tmp_path / "x.idx")
    src.coalesce(1).write.format("siltstone_archive").mode("append").options(path=file, index_only="true").save()
    assert {r.data_offset for r in spark.read.format("siltstone_archive").load(file).collect()} == {0}
    with pytest.raises(Exception, match="no data"):
        spark.read.format("siltstone_archive").option("view", "files").load(file).collect()


def test_extract_and_apply_to_a_folder(spark, src, v2, tmp_path):
    out = str(tmp_path / "out")

    def states(df):
        return {r.path: r.state for r in df.collect()}

    assert states(extract.extract(src.unionByName(contents(spark, {"../up": "no"})), out)) == {"a.txt": "written", "b.txt": "written"}
    assert states(extract.extract(v2, out, overwrite=False)) == {"a.txt": "kept", "b.txt": "kept"}
    assert states(extract.extract(src, out)) == {"a.txt": "same", "b.txt": "same"}
    wrong = src.withColumn("hash", F.lit("0" * 64))
    assert set(states(extract.extract(wrong, str(tmp_path / "n"), verify=True)).values()) == {"error: the hash differs"}
    results = patch.outcome(src, patch.create(src, v2.where("path = 'a.txt'")))
    assert states(extract.apply_outcome(results, out)) == {"a.txt": "written", "b.txt": "removed"}
    assert os.listdir(out) == ["a.txt"] and open(f"{out}/a.txt").read() == "v2"


def test_ignored_rows_follow_the_walk(spark, tmp_path):
    archive.register(spark)
    tree = ["a.log", "k/a.log", "k/m/a.log", "k/m/n/a.log", "k/m/n/b.txt", "z/b.txt"]
    rules = {"": "z\n", "k": "*.log\n", "k/m": "n\n"}
    for p in tree:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    for folder, text in rules.items():
        (tmp_path / folder / ".pafignore").write_text(text)
    frame = spark.createDataFrame([(f, t.strip()) for f, t in rules.items()], "folder string, pattern string")
    everything = spark.createDataFrame([(p,) for p in tree], "path string")
    for recursive in (False, True):
        walked = {p for p, _ in archive.walk(str(tmp_path), recursive=recursive) if not p.endswith(".pafignore")}
        assert {r.path for r in search.ignored(everything, frame, recursive).collect()} == walked


def test_null_contents(spark):
    def side(**files):
        return spark.createDataFrame(list(files.items()), "path string, content string")

    old, new = side(a=None, b="x", c=None, d="1", e=""), side(a="now", b=None, c=None, d="1", e=None)
    assert delta_of(old, new) == {"a": "UPDATED", "b": "UPDATED", "e": "UPDATED"}
    assert {r.path for r in D.updated(snapshot.index(old), snapshot.index(new)).collect()} == {"a", "b", "e"}
    assert {r.path for r in snapshot.not_there(snapshot.index(new), snapshot.index(old), same_content=True).collect()} == {"a", "b", "e"}
    results = patch.outcome(old, patch.create(old, new))
    assert results.where("error is not null").count() == 0
    assert {r.path: r.content and bytes(r.content) for r in patch.apply(old, patch.create(old, new)).collect()} == {"a": b"now", "b": None, "c": None, "d": b"1", "e": None}


def test_keys_do_not_collide(spark):
    rows = spark.createDataFrame([("a/b", "c"), ("a", "b/c"), ("a", None), (None, "a"), ("a\\", "b"), ("a", "\\N"), ("\\N", "a")], "x string, y string")
    held = D.keyed(rows, "x", "y")
    assert held.select("path").distinct().count() == 7 and held.select("hash").distinct().count() == 1


def test_filters_reach_the_archive(spark, tmp_path):
    archive.register(spark)
    file = str(tmp_path / "x.arc")
    files = {f"d/{i:03d}": f"content {i}" * 10 for i in range(500)}
    contents(spark, files).repartitionByRange(3, "path").sortWithinPartitions("path").write.format("siltstone_archive").mode("append").options(path=file).save()
    read = spark.read.format("siltstone_archive").option("view", "files").load(file)
    assert [(r.path, bytes(r.content).decode()) for r in read.where("entry_idx = 17").collect()] == [("d/017", files["d/017"])]
    assert {r.path for r in read.where("path in ('d/003', 'd/499', 'none')").collect()} == {"d/003", "d/499"}
    assert read.where("entry_idx = 500").count() == 0 and read.where("entry_idx = 3 and path = 'd/004'").count() == 0
    reader = archive.ArchiveReader(file, "files", (0, None))
    assert list(reader.pushFilters([archive.EqualTo(("entry_idx",), 17)])) and [p.files for p in reader.partitions()] == [[17, 18]]
    part = spark.read.format("siltstone_archive").options(view="files", offset="8", size="5").load(file)
    assert {r.path: bytes(r.content).decode() for r in part.collect()} == {p: c[8:13] for p, c in files.items()}
    for bad in ("", "d" * 1024):
        with pytest.raises(Exception, match="a path of"):
            contents(spark, {bad: "x"}).write.format("siltstone_archive").mode("append").options(path=str(tmp_path / "bad")).save()
    with pytest.raises(ValueError, match="mount"):
        archive.local("hdfs://host/x")


def test_extract_one_and_folder(spark, tmp_path):
    files = contents(spark, {"foo/x": "1", "foo/d/y": "2", "bar": "3"})
    assert [tuple(r) for r in extract.extract_one(files, "foo/x", str(tmp_path)).collect()] == [("foo/x", "written")]
    assert {tuple(r) for r in extract.extract_folder(files, "foo", str(tmp_path), "to/").collect()} == {("to/x", "written"), ("to/d/y", "written")}
    assert (tmp_path / "to/d/y").read_text() == "2"
    for call in (lambda: extract.extract_one(files, "no", str(tmp_path)), lambda: extract.extract_folder(files, "fo", str(tmp_path))):
        with pytest.raises(FileNotFoundError):
            call()


def test_listing_as_an_array(spark):
    held = snapshot.index(contents(spark, {'b"q': "1", "a": ""}))
    assert json.loads(snapshot.listing_array(held)) == [{"path": "a", "size": 0}, {"path": 'b"q', "size": 1}]
    with pytest.raises(ValueError):
        snapshot.listing_array(held, most=1)


def test_written_tables_can_be_removed(spark):
    held = list(staging._written)
    staging._written.clear()
    try:
        assert staging.staged(spark.range(5), "t").count() == 5
        (path,) = (archive.local(p) for p in staging._written)
        assert os.listdir(path)
        assert staging.cleaned(spark) == 1 and not os.path.exists(path)
    finally:
        staging._written.extend(held)


def test_apply_to_folder_registers_its_source(spark, tmp_path):
    """In a session where nothing was registered before."""
    rows = [(i, f"text {i}", "en", "src1") for i in range(20)]
    alone = spark.newSession()
    try:
        # createDataFrame makes its session the active one, in which Spark looks sources up
        alone.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
        out = catalogue.apply_to_folder(alone, str(tmp_path)).collect()
    finally:
        spark.createDataFrame([(0,)], "x int")
    want = {f"src1/en/{i}.txt": f"text {i}{' v2' if i % 5 == 0 else ''}" for i in range(20) if i % 10 != 7}
    assert {(r.path, r.data_size, r.hash) for r in out} == {(p, len(t), hashlib.sha256(t.encode()).hexdigest()) for p, t in want.items()}
