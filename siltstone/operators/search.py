"""Searches over the entries of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import schema as S
from siltstone.functions import paths


def search(entries: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """Entries whose path matches a glob; with most, the first so many in order of entry_idx."""
    if most is not None and most <= 0:
        raise ValueError("most has to be positive")
    out = entries.where(paths.glob(F.col("path"), pattern))
    return out if most is None else out.orderBy("entry_idx").limit(most)


def at(entries: DataFrame, ordinal: int) -> DataFrame:
    """The entry of an ordinal, if its path is safe to read and its content fits in a row."""
    fits = F.col("data_size") <= S.MOST_ENTRY_READ
    return entries.where((F.col("entry_idx") == ordinal) & paths.safe_to_read(F.col("path")) & fits)


def byte_range(contents: DataFrame, offset: int, size: int) -> DataFrame:
    """(path, part): bytes of each content from an offset; fewer, or none, where it ends before."""
    return contents.select("path", F.substring(F.col("content").cast("binary"), offset + 1, size).alias("part"))


def match_count(entries: DataFrame, pattern: str) -> DataFrame:
    return entries.where(paths.glob(F.col("path"), pattern)).agg(F.count("*").alias("matches"))


def file_exists(entries: DataFrame, path: str) -> bool:
    return not entries.where(F.col("path") == path).limit(1).isEmpty()


def folder_exists(entries: DataFrame, folder: str) -> bool:
    return not entries.where(paths.under(F.col("path"), folder)).limit(1).isEmpty()


def existing(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(path) -> (path, is_file, is_folder), for many paths in one pass over the entries."""
    ask = asked.select("path").distinct()
    files = entries.select("path").distinct().withColumn("is_file", F.lit(True))
    parents = entries.select(F.explode(_ancestors(F.col("path"))).alias("path")).distinct().withColumn("is_folder", F.lit(True))
    return ask.join(files, "path", "left").join(parents, "path", "left").na.fill(False, ["is_file", "is_folder"])


def _ancestors(path):
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def folder(entries: DataFrame, folder: str, to: str = "", strict: bool = True) -> DataFrame:
    """Entries of a folder with their target: the path without the folder, below `to`.

    strict=False takes the bare prefix, so that `foo` also takes `foobar/x`; either way there is nothing
    if no path lies below the folder, and unsafe paths are left out.
    """
    path = F.col("path")
    prefix = f"{folder}/" if strict else folder
    if not strict and not folder_exists(entries, folder):
        return entries.where(F.lit(False)).withColumn("target", path)
    return entries.where(path.startswith(prefix) & paths.safe_in_folder(path)).withColumn("target", paths.rebased(path, prefix, to))


def ignored(entries: DataFrame, rules: DataFrame, recursive: bool = False) -> DataFrame:
    """Entries that no ignore rule covers.

    rules: (folder, pattern), folder '' being the root. A rule globs the names of entries and of
    folders, and an ignored folder takes its subtree along. With recursive=False only the root's
    rules count, at every depth; with recursive=True a folder's rules count in it and one level below.
    """
    path = F.col("path")
    clean = rules.where("trim(pattern) <> '' and not startswith(pattern, '#')").select(F.col("folder").alias("rule_folder"), "pattern").distinct()
    steps = F.split(path, "/")
    if not recursive:  # the patterns of one ignore file, told apart within the row
        patterns = sorted(r[0] for r in clean.where("rule_folder = ''").select("pattern").collect())
        if not patterns:
            return entries
        return entries.where(~F.coalesce(F.exists(steps, lambda name: F.exists(F.lit(patterns), lambda p: paths.glob_column(name, p))), F.lit(False)))
    # each name on the way, with its folder and the folder above that
    on_way = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda n: F.struct(
            steps[n - 1].alias("name"), F.array_join(F.slice(steps, F.lit(1), n - 1), "/").alias("folder"),
            F.when(n > 1, F.array_join(F.slice(steps, F.lit(1), F.greatest(n - 2, F.lit(0))), "/")).alias("above"),
        ),
    )
    names = entries.select("path").distinct().select("path", F.explode(on_way).alias("s")).select("path", "s.*")
    scoped = names.select("path", "name", F.explode(F.array_distinct(F.array("folder", F.coalesce("above", "folder")))).alias("rule_folder"))
    hit = scoped.join(clean, "rule_folder").where(paths.glob_column(F.col("name"), F.col("pattern")))
    return entries.join(hit.select("path").distinct(), "path", "left_anti")


def parse_rules(lines: DataFrame, folder: str = "") -> DataFrame:
    """Lines of an ignore file (value) -> (folder, pattern), without blank lines and comments."""
    return lines.where("value <> '' and not startswith(value, '#')").select(F.lit(folder).alias("folder"), F.col("value").alias("pattern"))
