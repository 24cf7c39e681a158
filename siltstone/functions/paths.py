"""Predicates and projections on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone import schema as S


def like_pattern(glob: str) -> str:
    """A LIKE pattern with escape ! for a glob whose only wildcard is *, which also crosses /."""
    out = glob.replace("!", "!!").replace("%", "!%").replace("_", "!_")
    return out.replace("*", "%")


def glob(path: Column, pattern: str) -> Column:
    """Whole, case-sensitive match; the constant pattern lets Catalyst turn it into =, prefix or suffix tests."""
    if "*" not in pattern:
        return path == pattern
    if pattern.count("*") == 1 and pattern.endswith("*"):
        return path.startswith(pattern[:-1])
    return F.call_function("like", path, F.lit(like_pattern(pattern)), F.lit("!"))


def glob_column(path: Column, pattern: Column) -> Column:
    """As glob, for patterns in a column."""
    escaped = pattern
    for c in "!%_":
        escaped = F.replace(escaped, F.lit(c), F.lit("!" + c))
    return F.call_function("like", path, F.replace(escaped, F.lit("*"), F.lit("%")), F.lit("!"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def under(path: Column, folder: str) -> Column:
    """Whether a path lies below a folder; the empty folder has nothing below it."""
    return path.startswith(folder + "/") if folder else F.lit(False)


def rebased(path: Column, prefix: str, to: str = "") -> Column:
    """The path with a prefix replaced by another."""
    return F.concat(F.lit(to), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))


def _rooted(path: Column) -> Column:
    return path.startswith("/") | path.startswith("\\")


def safe_to_write(path: Column) -> Column:
    """Neither empty, too long, rooted, with two dots in a row, nor with a drive."""
    return (F.octet_length(path) > 0) & (F.octet_length(path) <= S.MOST_PATH) & ~_rooted(path) & ~path.contains("..") & ~path.contains(":")


def safe_in_patch(path: Column) -> Column:
    """As safe_to_write, without the tests of length and drive."""
    return (F.octet_length(path) > 0) & ~_rooted(path) & ~path.contains("..")


def safe_to_read(path: Column) -> Column:
    """Not rooted, and no two dots before a separator or the end."""
    return ~_rooted(path) & ~path.rlike(r"\.\.(?:[/\\]|\z)")


def safe_in_folder(path: Column) -> Column:
    """Not rooted and no two dots in a row."""
    return ~_rooted(path) & ~path.contains("..")


def staged_name(path: Column) -> Column:
    return F.concat(path, F.lit(S.STAGE_SUFFIX))
