"""File discovery over a table of files or a directory tree: inclusion, hidden and binary files, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.functions import patterns


def hidden(path: Column) -> Column:
    """Does the base name begin with a dot?"""
    return F.substring_index(path, "/", -1).startswith(".")


def binary(content: Column) -> Column:
    """By the first 512 bytes: a NUL, invalid UTF-8, or more than 30 % control characters; empty content is text.

    A character cut at byte 512 counts as invalid.
    """
    head = F.substring(content, 1, 512)
    text = F.decode(head, "ISO-8859-1")
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    size = F.octet_length(head)
    return (size > 0) & (F.contains(text, F.lit("\0")) | ~F.is_valid_utf8(head.cast("string")) | (control * 10 > size * 3))


def included(
    path: Column,
    size: Column,
    include: tuple[str, ...] = patterns.INCLUDED_FILES,
    exclude: tuple[str, ...] = patterns.EXCLUDED_FILES,
    max_size: int = patterns.MAX_FILE_SIZE,
    include_hidden: bool = True,
) -> Column:
    """Size limit, then hidden files, then exclusion, then inclusion (no patterns include all); globs see the relative path."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    ok = F.coalesce(size <= max_size, F.lit(True)) if max_size > 0 else F.lit(True)
    if not include_hidden:
        ok = ok & ~hidden(slashed)
    if exclude:
        ok = ok & ~slashed.rlike("|".join(map(patterns.glob_pattern, exclude)))
    if include:
        ok = ok & slashed.rlike("|".join(map(patterns.glob_pattern, include)))
    return ok


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def discovery_stats(files: DataFrame, path: str = "path", size: str = "size", is_binary: str = "is_binary", is_hidden: str = "is_hidden") -> DataFrame:
    """One row: files, bytes, binary and hidden files, and a map of the number of files per non-empty extension."""
    per = files.groupBy(extension(F.col(path)).alias("ext")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.count_if(is_binary).alias("b"), F.count_if(is_hidden).alias("h")
    )
    entry = F.when((F.col("ext") != "") & F.col("ext").isNotNull(), F.struct("ext", "n"))
    return per.agg(
        F.sum("n").alias("total_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size"),
        F.sum("b").alias("binary_files"),
        F.sum("h").alias("hidden_files"),
        F.map_from_entries(F.array_compact(F.collect_list(entry))).alias("extensions"),
    )


def text_stats(files: DataFrame, text: str) -> DataFrame:
    """Each file with its bytes and its lines (line feeds and one)."""
    t = F.col(text)
    return files.withColumns({"n_bytes": F.octet_length(t), "n_lines": F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1})
