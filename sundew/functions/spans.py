"""Positions in text: all matches with offsets, lines and columns, windows of characters and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<value:string,start:int,stop:int>>"


def spans(text: Column, pattern: str) -> Column:
    """All matches with their 0-based character offsets.

    Matched and unmatched pieces are interleaved and their lengths summed up, so no position is searched twice.
    Null text gives null.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(g.alias("g"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["g"])
        last = first + F.length(x["v"])
        new = F.struct(x["v"].alias("value"), first.alias("start"), last.alias("stop"))
        return F.struct(last.alias("at"), F.array_append(acc["out"], new).cast(SPAN).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def line_of(text: Column, start: Column) -> Column:
    """1-based line of a 0-based offset."""
    prefix = F.substr(text, F.lit(1), start)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """1-based column of a 0-based offset."""
    return F.length(F.substring_index(F.substr(text, F.lit(1), start), "\n", -1)) + 1


def byte_column_of(text: Column, start: Column) -> Column:
    """As ``column_of``, counted in bytes of UTF-8."""
    return F.octet_length(F.substring_index(F.substr(text, F.lit(1), start), "\n", -1)) + 1


def before(text: Column, start: Column, size: int) -> Column:
    """Up to ``size`` characters before an offset."""
    first = F.greatest(start - size, F.lit(0))
    return F.substr(text, first + 1, start - first)


def after(text: Column, stop: Column, size: int) -> Column:
    """Up to ``size`` characters after an offset."""
    return F.substr(text, stop + 1, F.lit(size))


def around(text: Column, start: Column, stop: Column, size: int) -> Column:
    """The characters from ``size`` before to ``size`` after; offsets are clamped, and swapped if out of order."""
    n = F.length(text)
    a = F.least(F.greatest(F.least(start, stop), F.lit(0)), n)
    b = F.least(F.greatest(F.greatest(start, stop), F.lit(0)), n)
    first = F.greatest(a - size, F.lit(0))
    return F.substr(text, first + 1, F.least(b + size, n) - first)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_window(all_lines: Column, line: Column, back: int, ahead: int, glue: str = "\n") -> Column:
    """The lines from ``back`` before to ``ahead`` after a 1-based line, clamped; empty for a line out of range."""
    n = F.size(all_lines)
    first = F.greatest(line - back, F.lit(1))
    count = F.least(line + ahead, n) - first + 1
    inside = (line >= 1) & (line <= n)
    return F.when(inside, F.array_join(F.slice(all_lines, first, F.greatest(count, F.lit(1))), glue)).otherwise("")


def line_at(all_lines: Column, line: Column) -> Column:
    return F.coalesce(F.get(all_lines, line - 1), F.lit(""))
