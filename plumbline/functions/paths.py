"""Path predicates as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline import fixed_values as fv


def normalize_path(path: Column) -> Column:
    """Backslashes become slashes and ONE leading ``./`` is dropped."""
    slashed = F.translate(path, "\\", "/")
    return F.when(slashed.startswith("./"), F.substring(slashed, 3, 1 << 30)).otherwise(slashed)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extname(path: Column) -> Column:
    """From the last dot of the base name; empty when that dot leads the name or is absent."""
    base = basename(path)
    tail = F.substring_index(base, ".", -1)
    return F.when(F.length(base) - F.length(tail) > 1, F.concat(F.lit("."), tail)).otherwise(F.lit(""))


def is_ignored_path(path: Column) -> Column:
    """True when any segment, the file name included, is an ignored name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in fv.IGNORED_NAMES]))


def classify_file(path: Column) -> Column:
    """``code``, ``sql`` or null; case-sensitive."""
    ext = extname(path)
    return F.when(ext.isin(fv.CODE_EXTENSIONS), F.lit("code")).when(ext == fv.SQL_EXTENSION, F.lit("sql"))


def is_scannable_path(path: Column) -> Column:
    normal = normalize_path(path)
    return ~is_ignored_path(normal) & classify_file(normal).isNotNull()


def is_example_file(path: Column) -> Column:
    return path.rlike(fv.EXAMPLE_FILE)


def repo_owner(full_name: Column) -> Column:
    """Text before the FIRST slash; the whole name when a slash is absent or leads."""
    slash = F.locate("/", full_name)
    return F.when(slash > 1, F.substring(full_name, F.lit(1), slash - 1)).otherwise(full_name)


def repo_name(full_name: Column) -> Column:
    slash = F.locate("/", full_name)
    return F.when(slash > 1, F.substring(full_name, slash + 1, F.length(full_name))).otherwise(F.lit(""))


def is_repo_full_name(value: Column) -> Column:
    return F.coalesce(value.rlike(fv.REPO_PATTERN), F.lit(False))


def is_name(value: Column) -> Column:
    return F.coalesce(value.rlike(fv.NAME_PATTERN), F.lit(False))


def is_commit_sha(value: Column) -> Column:
    return F.coalesce(value.rlike(fv.SHA_PATTERN), F.lit(False))
