"""Detection: candidates of all matchers, ordered de-overlap, positions, checks, context gates, and the rule detector.

Texts are never shuffled: candidates are found, folded and filtered within the row, and only findings are exploded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sundew.functions import checksums, patterns, spans
from sundew.functions.let import has_any
from sundew.functions.masking import lookup
from sundew.operators import matchers
from sundew.session import slices

SPAN = "array<struct<kind:string,value:string,start:int,stop:int>>"


def accepted(kind: str, value: Column) -> Column:
    """The check that a matcher makes of its match before it counts."""
    return matchers.TABLE[kind].check.column(value)


def value_of(kind: str, match: Column) -> Column:
    """The value within a match: the number of a company, else the match."""
    inner = matchers.TABLE[kind].inner
    return F.regexp_extract(match, patterns.java(inner), 0) if inner else match


def matches(text: Column, kind: str) -> Column:
    """Accepted values of one type, in order, without positions (cheaper than ``candidates``)."""
    found = F.regexp_extract_all(text, F.lit(patterns.java(matchers.TABLE[kind].pattern)), F.lit(0))
    return F.filter(F.transform(found, lambda m: value_of(kind, m)), lambda v: accepted(kind, v))


def candidates(text: Column, kind: str) -> Column:
    """Accepted matches of one type with their offsets."""
    found = spans.spans(text, patterns.java(matchers.TABLE[kind].pattern))
    typed = F.transform(
        found,
        lambda m: F.struct(F.lit(kind).alias("kind"), value_of(kind, m["value"]).alias("value"), m["start"].alias("start"), m["stop"].alias("stop")),
    )
    return F.filter(typed, lambda m: accepted(kind, m["value"])).cast(SPAN)


def without_overlap(ordered: Column) -> Column:
    """Greedy de-overlap in matcher order: a match is dropped if its start or its end lies in an accepted one.

    The rule is asymmetric on purpose: a match that strictly contains an accepted one stays.
    """

    def step(kept: Column, m: Column) -> Column:
        clash = F.exists(
            kept, lambda r: ((m["start"] >= r["start"]) & (m["start"] < r["stop"])) | ((m["stop"] > r["start"]) & (m["stop"] <= r["stop"]))
        )
        return F.when(clash, kept).otherwise(F.array_append(kept, m).cast(SPAN))

    return F.aggregate(ordered, F.array().cast(SPAN), step)


def excluded_path(path: Column) -> Column:
    """Is the file left out by folder or minified name?"""
    globs = "|".join(patterns.glob_pattern(g) for g in patterns.EXCLUDED_PATHS)
    return path.rlike(f"{patterns.any_of(patterns.EXCLUDED_PATHS)}|{globs}")


def path_modifier(path: Column) -> Column:
    """0.1 for test and mock files (by pattern, or by the pattern's bare text anywhere in the name), else 1.0."""
    globs = patterns.TEST_PATHS + patterns.MOCK_PATHS
    bare = tuple(dict.fromkeys(g.strip("*/") for g in globs))
    rule = f"{patterns.any_of(bare)}|{'|'.join(patterns.glob_pattern(g) for g in globs)}"
    return F.when(path.rlike(rule), 0.1).otherwise(1.0)


def rule_path_modifier(path: Column) -> Column:
    """0.1 for test, spec and mock files, 0.3 for examples and samples, else 1.0; case doesn't matter."""
    low = F.lower(path)
    return F.when(low.rlike("test|spec|mock"), 0.1).when(low.rlike("example|sample"), 0.3).otherwise(1.0)


def type_risk(kind: Column) -> Column:
    """Risk of a type by its weight; types without one are low."""
    weight = lookup(kind, patterns.RISK_WEIGHTS, F.lit(0))
    return F.when(weight >= 90, "HIGH").when(weight >= 60, "MEDIUM").otherwise("LOW")


def in_test_context(all_lines: Column, line: Column) -> Column:
    return has_any(F.lower(spans.line_window(all_lines, line, 3, 3)), patterns.TEST_WORDS)


def in_comment_example(all_lines: Column, line: Column) -> Column:
    text = spans.line_at(all_lines, line)
    return has_any(text, ("//", "#", "/*", "*/")) & has_any(F.lower(text), patterns.EXAMPLE_WORDS)


def in_mock_context(all_lines: Column, line: Column) -> Column:
    return has_any(F.lower(spans.line_window(all_lines, line, 2, 2)), patterns.MOCK_WORDS)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


#: Texts without this can't match any of the built-in kinds.
MAY_MATCH = matchers.may_match(tuple(matchers.TABLE))
FOUND = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
    ]
)


def accepted_value(kind: str, value: str) -> bool:
    """As ``accepted``, for one string."""
    return matchers.TABLE[kind].check.holds(value)


def compiled_matchers(table: list[tuple[str, matchers.Matcher]]) -> list[tuple[str, re.Pattern, re.Pattern | None, matchers.Check]]:
    """(kind, pattern, pattern of the value within a match, check) of each matcher."""
    make = lambda p: re.compile(patterns.python(p), re.ASCII) if p else None
    return [(k, make(m.pattern), make(m.inner), m.check) for k, m in table]


def found_in(text: str, compiled: list[tuple[str, re.Pattern, re.Pattern | None, matchers.Check]]) -> list[tuple[str, str, int, int]]:
    """Kept matches of one text in matcher order: (kind, value, start, stop), overlaps dropped greedily.

    Accepted ranges are looked up by position in sorted lists of starts and stops, so long texts stay near-linear.
    """
    kept: list[tuple[str, str, int, int]] = []
    starts: list[int] = []
    stops: list[int] = []
    reach = 0
    for kind, pattern, inner, check in compiled:
        for m in pattern.finditer(text):
            value = inner.search(m[0])[0] if inner else m[0]
            if not check.holds(value):
                continue
            a, b = m.span()
            # a clash needs a range that starts at or before a (or before b) and ends after a (or at or after b)
            i = bisect_right(starts, b)
            clash = False
            while i > 0 and not clash and starts[i - 1] > a - reach - 1:
                i -= 1
                s, e = starts[i], stops[i]
                clash = (s <= a < e) or (s < b <= e)
            if clash:
                continue
            at = bisect_right(starts, a)
            starts.insert(at, a)
            stops.insert(at, b)
            reach = max(reach, b - a)
            kept.append((kind, value, a, b))
    return kept


def detect(
    files: DataFrame,
    id_column: str,
    path_column: str,
    text_column: str,
    kinds: tuple[str, ...] | None = None,
    min_confidence: float = 0.4,
    gates: bool = True,
    whole_path: bool = False,
    max_bytes: int | None = patterns.MAX_FILE_SIZE,
    checked: bool = True,
) -> DataFrame:
    """Findings of the pattern detector: one row per kept match.

    Columns: id, file, kind, value, start, line, col, context_before, context_after (50 characters), validated,
    confidence, context_modifier, risk_level, detector_name, and for the second look ``lines`` (five lines before to six
    after) with ``at``, the finding's line within them.  Null texts and excluded paths give no rows, nor do texts of more
    than ``max_bytes`` (None: no limit), of which ``refused`` gives an error row each.  Ranges are reserved before the context gates, so a gated finding still blocks what it overlaps.
    ``whole_path`` lets folder rules see the whole path instead of the base name.  Without ``checked`` no checksum is looked
    at, so every finding has the confidence of a type without one.

    The ordered fold runs in one Arrow kernel (as nested array functions it took ten times as long); paths, gates,
    checks and risks are column expressions before and after it.
    """
    kinds = tuple(matchers.TABLE) if kinds is None else kinds
    table = [(k, matchers.TABLE[k]) for k in kinds]
    name = F.col("_path") if whole_path else base_name(F.col("_path"))
    rows = files.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(path_column), F.lit("")).alias("_path"), F.col(text_column).alias("_text"))
    size = F.octet_length("_text") <= max_bytes if max_bytes is not None else F.lit(True)
    rows = rows.where(F.col("_text").isNotNull() & size & ~excluded_path(name) & F.col("_text").rlike(matchers.may_match(kinds)))
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()), T.StructField("file", T.StringType()), *FOUND.fields, T.StructField("line", T.IntegerType()),
            T.StructField("col", T.IntegerType()), T.StructField("context_before", T.StringType()), T.StructField("context_after", T.StringType()),
            T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("at", T.IntegerType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compiled_matchers(table)
        for batch in (part for whole in batches for part in slices(whole, 2)):
            out: list[tuple] = []
            for rid, path, text in zip(*[c.to_pylist() for c in batch.columns]):
                kept = found_in(text, compiled)
                if not kept:
                    continue
                lines = text.split("\n")
                firsts = [0]
                for x in lines:
                    firsts.append(firsts[-1] + len(x) + 1)
                for kind, value, a, b in kept:
                    n = bisect_right(firsts, a) - 1
                    top = max(n - 5, 0)
                    out.append((rid, path, kind, value, a, b, n + 1, a - firsts[n] + 1, text[max(a - 50, 0) : a], text[b : b + 50], lines[top : n + 7], n - top + 1))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return _judged(rows.mapInArrow(kernel, schema), min_confidence, gates, whole_path, checked)


def refused(files: DataFrame, id_column: str, path_column: str, text_column: str, max_bytes: int = patterns.MAX_FILE_SIZE) -> DataFrame:
    """(id, file, size, error): the texts that ``detect`` refuses for their size."""
    size = F.octet_length(text_column)
    rows = files.where(size > max_bytes).select(F.col(id_column).cast("bigint").alias("id"), F.col(path_column).alias("file"), size.cast("bigint").alias("size"))
    return rows.withColumn("error", F.format_string(f"file too large: %d bytes, at most {max_bytes}", "size"))


def detect_declared(files: DataFrame, id_column: str, path_column: str, text_column: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, kind, value, start, stop) as ``detect`` finds them before its gates, by column expressions alone."""
    text = F.col(text_column)
    found = F.explode(without_overlap(F.flatten(F.array(*[candidates(text, k) for k in kinds or matchers.TABLE]))))
    rows = files.where(text.isNotNull() & ~excluded_path(base_name(F.coalesce(F.col(path_column), F.lit("")))))
    return rows.select(F.col(id_column).alias("id"), found.alias("m")).select("id", "m.*")


def _judged(found: DataFrame, min_confidence: float, gates: bool, whole_path: bool, checked: bool = True) -> DataFrame:
    """Context gates, checks, risks and modifiers of raw matches."""
    name = F.col("file") if whole_path else base_name(F.col("file"))
    out = found.withColumn("context_modifier", path_modifier(name))
    lines, at, kind, value = F.col("lines"), F.col("at"), F.col("kind"), F.col("value")
    if gates:
        test = (F.col("context_modifier") > 0.1) & in_test_context(lines, at)
        out = out.where(~(test | in_comment_example(lines, at) | in_mock_context(lines, at)))
    out = out.withColumn("_ok", checksums.valid(kind, value) if checked else F.lit(None).cast("boolean")).withColumn("confidence", checksums.confidence_of(F.col("_ok")))
    if min_confidence > 0.5:  # no finding has less
        out = out.where(F.col("confidence") >= min_confidence)
    marks = {"validated": F.coalesce("_ok", F.lit(False)), "risk_level": type_risk(kind), "detector_name": F.lit("pattern-detector")}
    return out.withColumns(marks).drop("_ok")


# Rule detector ------------------------------------------------------------------------------------------------------


def rule_kind(rule: Column, rules: dict = patterns.SECRET_RULES) -> Column:
    """Type of a rule: its own, else by a word in its id, else SECRET_ and the id."""
    known = lookup(rule, {k: v[2] for k, v in rules.items() if v[2]}, F.lit(None).cast("string"))
    other = F.concat(F.lit("SECRET_"), F.upper(rule))
    for words, kind in reversed(patterns.RULE_KINDS.items()):
        other = F.when(rule.rlike(words), kind).otherwise(other)
    return F.coalesce(known, other)


def rule_risk(rule: Column, tags: Column | None = None) -> Column:
    """Risk of a rule's finding: by the first tag that names one, else HIGH for keys and tokens, else MEDIUM."""
    plain = F.when(rule.rlike("key|token"), "HIGH").otherwise("MEDIUM")
    if tags is None:
        return plain
    table = patterns.RULE_TAG_RISKS
    named = F.filter(F.transform(tags, F.lower), lambda t: t.isin(*table))
    return F.when(F.size(named) > 0, lookup(F.get(named, F.lit(0)), table, plain)).otherwise(plain)


def rule_matches(text: Column, rule: str, rules: dict = patterns.SECRET_RULES, allowed: tuple[str, ...] = patterns.SECRET_ALLOWED) -> Column:
    """Matches of one rule with their offsets: nothing unless a keyword occurs (a rule without keywords always looks), and
    none that the allowlist covers."""
    pattern, keywords = rules[rule][:2]
    java = patterns.java(pattern)
    found = F.when(text.rlike(java), spans.spans(text, java)).otherwise(F.array().cast(spans.SPAN))  # most texts have none
    if allowed:
        any_allowed = "|".join(f"(?:{patterns.java(p)})" for p in allowed)
        found = F.filter(found, lambda m: ~m["value"].rlike(any_allowed))
    return F.when(F.lower(text).rlike(patterns.any_of(keywords)), found).otherwise(F.array().cast(spans.SPAN)) if keywords else found


def detect_rules(
    files: DataFrame, id_column: str, path_column: str, text_column: str, rules: dict = patterns.SECRET_RULES, allowed: tuple[str, ...] = patterns.SECRET_ALLOWED
) -> DataFrame:
    """Findings of the rule detector: (id, file, rule, kind, value, start, line, col, context, risk_level, confidence,
    context_modifier, detector_name); ``context`` is the line.

    ``rules`` maps an id to (pattern, keywords, type or None[, tags]).  Each occurrence has its own position; null texts
    give no rows.  Texts stay where they are: a finding's position is computed beside its text, without a join.
    """
    text = F.col(text_column)

    def named(rule: str) -> Column:
        return F.transform(rule_matches(text, rule, rules, allowed), lambda m: F.struct(F.lit(rule).alias("rule"), m["value"].alias("value"), m["start"].alias("start")))

    found = files.where(text.isNotNull()).select(
        F.col(id_column).alias("id"), F.col(path_column).alias("file"), text.alias("_text"), F.explode(F.flatten(F.array(*[named(r) for r in rules]))).alias("m")
    )
    rule, start = F.col("m.rule"), F.col("m.start")
    tags = {k: v[3] for k, v in rules.items() if len(v) > 3 and v[3]}
    tagged = F.coalesce(*[F.when(rule == k, F.array(*[F.lit(t) for t in v])) for k, v in tags.items()]) if tags else None
    line = F.concat(F.substring_index(F.substr("_text", F.lit(1), start), "\n", -1), F.substring_index(F.substr(F.col("_text"), start + 1), "\n", 1))
    return found.select(
        "id",
        "file",
        rule.alias("rule"),
        rule_kind(rule, rules).alias("kind"),
        F.col("m.value").alias("value"),
        start.alias("start"),
        spans.line_of(F.col("_text"), start).cast("int").alias("line"),
        spans.column_of(F.col("_text"), start).cast("int").alias("col"),
        line.alias("context"),
        rule_risk(rule, tagged).alias("risk_level"),
        F.lit(0.9).alias("confidence"),
        rule_path_modifier(F.coalesce("file", F.lit(""))).alias("context_modifier"),
        F.lit("gitleaks-detector").alias("detector_name"),
    )


#: A detector maps (files, id column, path column, text column) to findings.
Detector = Callable[[DataFrame, str, str, str], DataFrame]
DETECTORS: dict[str, Detector] = {"pattern": detect, "rules": detect_rules}


def detect_all(files: DataFrame, id_column: str, path_column: str, text_column: str, names: tuple[str, ...] = ("pattern", "rules")) -> DataFrame:
    """Union of several detectors' findings, none dropped as a duplicate of another's."""
    columns = ["id", "file", "kind", "value", "risk_level", "confidence", "context_modifier", "detector_name"]
    out = None
    for n in names:
        found = DETECTORS[n](files, id_column, path_column, text_column).select(*columns)
        out = found if out is None else out.unionByName(found)
    return out
