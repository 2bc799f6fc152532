"""Second look at findings: comments, strings, surrounding words and shapes of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.functions import patterns, spans
from sundew.functions.let import has_any
from sundew.functions.masking import lookup


def in_comment(line: Column, column: Column) -> Column:
    """Does a comment sign begin before the 1-based column?"""
    out = F.lit(False)
    for sign in patterns.COMMENT_SIGNS:
        at = F.instr(line, F.lit(sign))
        out = out | ((at > 0) & (at - 1 < column))
    return out


def in_string(line: Column, column: Column) -> Column:
    """Is the number of unescaped single or of double quotes before the column odd?"""
    left = F.substr(line, F.lit(1), F.greatest(column - 1, F.lit(0)))
    return (F.regexp_count(left, F.lit(r"(?<!\\)'")) % 2 == 1) | (F.regexp_count(left, F.lit(r'(?<!\\)"')) % 2 == 1)


def language(path: Column) -> Column:
    """Programming language by extension, else unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return lookup(extension, patterns.LANGUAGES, F.lit("unknown"))


def extended_window(all_lines: Column, line: Column) -> Column:
    """Five lines before to six after."""
    return spans.line_window(all_lines, line, 5, 6)


def is_test_data(path: Column, all_lines: Column, line: Column) -> Column:
    window = F.lower(extended_window(all_lines, line))
    return has_any(F.lower(path), patterns.TEST_FILE_WORDS) | has_any(window, patterns.TEST_INDICATORS)


def is_mock_data(all_lines: Column, line: Column) -> Column:
    return has_any(F.lower(extended_window(all_lines, line)), patterns.MOCK_INDICATORS)


def is_obviously_fake(all_lines: Column, line: Column) -> Column:
    return has_any(F.lower(extended_window(all_lines, line)), patterns.FAKE_INDICATORS)


def code_shape(value: Column, content: Column) -> Column:
    """sequential, uuid or hash by the value, else variable if the content assigns anything, else none."""
    out = F.when(F.lower(content).rlike("const|var|let|="), "variable").otherwise("none")
    for name, pattern in reversed(patterns.CODE_SHAPES.items()):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def has_valid_context(kind: Column, all_lines: Column, line: Column) -> Column:
    """Does a word of the type occur two lines before to three after?  Types without words have no context."""
    window = F.lower(spans.line_window(all_lines, line, 2, 3, " "))
    out = F.lit(False)
    for k, words in patterns.CONTEXT_WORDS.items():
        out = F.when(kind == k, has_any(window, words)).otherwise(out)
    return out


def validated(findings: DataFrame, content: str | None = None) -> DataFrame:
    """``detect``'s findings with the second look's columns, those that it rejects removed.

    The confidence becomes 0.95 with valid context, else 0.8; the detector's own stays in ``detector_confidence``.
    Dropped are comments with obvious fakes, UUIDs and hashes.
    """
    lines, line, col = F.col("lines"), F.col("at"), F.col("col")
    text = spans.line_at(lines, line)
    out = findings.withColumns(
        {
            "in_comment": in_comment(text, col),
            "in_string": in_string(text, col),
            "language": language(F.col("file")),
            "is_test_data": is_test_data(F.col("file"), lines, line),
            "is_mock_data": is_mock_data(lines, line),
            "has_context": has_valid_context(F.col("kind"), lines, line),
            "_fake": is_obviously_fake(lines, line),
            "code_shape": code_shape(F.col("value"), F.col(content) if content else F.array_join("lines", "\n")),
            "detector_confidence": F.col("confidence"),
        }
    )
    kept = out.where(~(F.col("in_comment") & F.col("_fake")) & ~F.col("code_shape").isin("uuid", "hash"))
    reason = F.when(F.col("has_context"), "Valid context found").otherwise("Pattern match")
    return kept.withColumns({"confidence": F.when(F.col("has_context"), 0.95).otherwise(0.8), "reason": reason}).drop("_fake")


# Fixed values of the plain filter.
PLAIN_TEST_FILES = ("_test.go", "test.go", "mock_", "fixture_")
PLAIN_MOCK_WORDS = ("mock", "test", "example", "sample", "dummy", "placeholder")


def plainly_filtered(findings: DataFrame) -> DataFrame:
    """A plainer filter for comparisons: no finding after //, in test files, or within a line of a mock word; the rest at 0.9."""
    lines, at = F.col("lines"), F.col("at")
    text = spans.line_at(lines, at)
    slashes = F.instr(text, F.lit("//"))
    commented = (slashes > 0) & (F.col("col") > slashes - 1)
    mocked = F.lower(spans.line_window(lines, at, 1, 2, " ")).rlike(patterns.any_of(PLAIN_MOCK_WORDS))
    tested = F.col("file").rlike(patterns.any_of(PLAIN_TEST_FILES))
    return findings.where(~(commented | mocked | tested)).withColumn("confidence", F.lit(0.9))
