"""Queries of the engine's own operators over the shared tables, each with equivalent SQL for DuckDB where SQL can say it.

The texts come from ``findings`` (a matched line with the lines around it, as one snippet), ``files`` and ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.functions import checksums, masking, patterns, proximity, spans
from sundew.operators import context, detect, discovery, evaluate, pairs
from sundew.session import durable, table
from sundew.sinks import reports
from sundew.sources import generate, repositories
from sundew.streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(finding_id, file_path, text): the lines of a finding with those around it."""
    t = table(spark, sf_dir, "findings")
    return t.select("finding_id", F.coalesce("file_path", F.lit("")).alias("file_path"), F.concat_ws("\n", "context_before", "context", "context_after").alias("text"))


SNIPPETS = "(SELECT finding_id, coalesce(file_path, '') AS file_path, concat_ws(chr(10), context_before, context, context_after) AS text FROM findings)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Matchers -----------------------------------------------------------------------------------------------------------

BARE = r"regexp_replace(v, '[\t\n\f\r \-]', '', 'g')"
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
ACCEPTED_SQL = {
    "ABN": "length(replace(v, ' ', '')) = 11 AND replace(v, ' ', '') NOT LIKE '614%'",
    "MEDICARE": r"length(regexp_replace(v, '[\t\n\f\r /\-]', '', 'g')) >= 10",
    "TFN": f"length({BARE}) = 9 AND {BARE} NOT LIKE '0%'",
    "BSB": f"length({BARE}) = 6 AND substring({BARE}, 1, 1) BETWEEN '0' AND '7'",
    "ACN": "length(replace(v, ' ', '')) = 9",
    "PHONE": f"length({DIGITS}) = 10 OR (length({DIGITS}) = 11 AND {DIGITS} LIKE '61%')",
    "EMAIL": "true",
    "DRIVER_LICENSE": f"v NOT LIKE '0%' AND {DIGITS} NOT LIKE '1300%' AND {DIGITS} NOT LIKE '1800%' AND {DIGITS} NOT LIKE '04%'",
    "NAME": f"NOT regexp_matches(lower(v), {quoted(patterns.any_of(patterns.NOT_NAMES))}) AND NOT regexp_matches(lower(v), {quoted(patterns.any_of(patterns.NOT_NAME_PARTS))})"
    " AND regexp_matches(v, '^[A-Za-z ]+$') AND NOT regexp_matches(v, '(?:^| )[A-Za-z]{1,2}(?: |$)') AND regexp_matches(v, '[a-z]')",
}


def match_sql(kind: str, source: str = SNIPPETS, id_column: str = "finding_id") -> str:
    value = f"regexp_extract(m, {quoted(patterns.ACN_DIGITS)}, 0)" if kind == "ACN" else "m"
    return f"""
        SELECT {id_column}, v AS value FROM (
            SELECT {id_column}, {value} AS v FROM (
                SELECT {id_column}, unnest(regexp_extract_all(text, {quoted(patterns.MATCHERS[kind])})) AS m FROM {source}))
        WHERE {ACCEPTED_SQL[kind]}"""


def _match_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return snippets(spark, sf_dir).select("finding_id", F.explode(detect.matches(F.col("text"), kind)).alias("value"))

    return run


for _i, _kind in enumerate(patterns.MATCHERS):
    query(f"match_{_kind.lower()}", match_sql(_kind))(_match_query(_kind))


_NESTED = "(SELECT result_id, f.match_text AS text FROM (SELECT result_id, unnest(findings) AS f FROM scan_results))"


@query("match_nested_emails", match_sql("EMAIL", _NESTED, "result_id"))
def match_nested_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "scan_results").select("result_id", F.explode("findings.match_text").alias("text"))
    return t.select("result_id", F.explode(detect.matches(F.col("text"), "EMAIL")).alias("value"))


@query("match_document_names", match_sql("NAME", "(SELECT doc_id, text FROM documents)", "doc_id"))
def match_document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.matches(F.col("text"), "NAME")).alias("value"))


# Rule detector ------------------------------------------------------------------------------------------------------

_ALLOWED = quoted("|".join(f"(?:{p})" for p in patterns.SECRET_ALLOWED))


def rule_sql(rule: str) -> str:
    pattern, keywords, kind = patterns.SECRET_RULES[rule]
    risk = "HIGH" if "key" in rule or "token" in rule else "MEDIUM"
    return f"""
        SELECT finding_id AS id, '{rule}' AS rule, '{kind}' AS kind, v AS value, '{risk}' AS risk_level FROM (
            SELECT finding_id, unnest(regexp_extract_all(text, {quoted(pattern)})) AS v FROM {SNIPPETS}
            WHERE regexp_matches(lower(text), {quoted(patterns.any_of(keywords))}))
        WHERE NOT regexp_matches(v, {_ALLOWED})"""


@query("rule_findings", " UNION ALL ".join(rule_sql(r) for r in patterns.SECRET_RULES))
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_rules(snippets(spark, sf_dir), "finding_id", "file_path", "text")
    return found.select("id", "rule", "kind", "value", "risk_level")


@query(
    "rule_path_modifier",
    """SELECT finding_id, CASE WHEN regexp_matches(lower(file_path), 'test|spec|mock') THEN 0.1::DOUBLE
       WHEN regexp_matches(lower(file_path), 'example|sample') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS modifier FROM findings WHERE file_path IS NOT NULL""",
)
def rule_path_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("file_path").isNotNull())
    return t.select("finding_id", detect.rule_path_modifier(F.col("file_path")).alias("modifier"))


# Whole detection: ordered de-overlap and gates (tested against a plain loop; SQL has no ordered fold) ---------------


@query("detect_findings")
def detect_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(snippets(spark, sf_dir), "finding_id", "file_path", "text").drop("lines", "at")


@query("detect_validated")
def detect_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.validated(detect.detect(snippets(spark, sf_dir), "finding_id", "file_path", "text")).drop("lines", "at")


@query("detect_files")
def detect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").where(F.col("file_text").isNotNull())
    return detect.detect(files, "file_id", "rel_path", "file_text").drop("lines", "at")


@query("detect_all")
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_all(snippets(spark, sf_dir), "finding_id", "file_path", "text")


# Gates and windows on the stored line of each finding ---------------------------------------------------------------

#: The matched line's number within the snippet.
_AT = "length(coalesce(context_before, '')) - length(replace(coalesce(context_before, ''), chr(10), '')) + CASE WHEN context_before IS NULL THEN 0 ELSE 1 END + 1"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets with their lines and the number of the line that was matched."""
    t = table(spark, sf_dir, "findings")
    b = F.coalesce("context_before", F.lit(""))
    at = F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))) + F.when(F.col("context_before").isNull(), 0).otherwise(1) + 1
    text = F.concat_ws("\n", "context_before", "context", "context_after")
    return t.select("finding_id", F.col("file_path").alias("file"), "col_no", "match_text", "pi_type", text.alias("text"), spans.lines(text).alias("lines"), at.alias("line"))


PLACED = f"(SELECT finding_id, file_path AS file, col_no, match_text, pi_type, concat_ws(chr(10), context_before, context, context_after) AS text, string_split(concat_ws(chr(10), context_before, context, context_after), chr(10)) AS lines, {_AT} AS line FROM findings)"


def window_sql(back: int, ahead: int, glue: str = "chr(10)") -> str:
    return f"array_to_string(list_slice(lines, greatest(line - {back}, 1), least(line + {ahead}, len(lines))), {glue})"


def has_sql(text: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower({text}), {quoted(patterns.any_of(words))})"


@query(
    "context_gates",
    f"""SELECT finding_id, {has_sql(window_sql(3, 3), patterns.TEST_WORDS)} AS test_context,
        (regexp_matches(lines[line], '//|#|/\\*|\\*/') AND {has_sql('lines[line]', patterns.EXAMPLE_WORDS)}) AS comment_example,
        {has_sql(window_sql(2, 2), patterns.MOCK_WORDS)} AS mock_context FROM {PLACED}""",
)
def context_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, line = F.col("lines"), F.col("line")
    return placed(spark, sf_dir).select(
        "finding_id",
        detect.in_test_context(lines, line).alias("test_context"),
        detect.in_comment_example(lines, line).alias("comment_example"),
        detect.in_mock_context(lines, line).alias("mock_context"),
    )


_CONTEXT_CASE = " ".join(f"WHEN kind = '{k}' THEN {has_sql(window_sql(2, 3, quoted(' ')), w)}" for k, w in patterns.CONTEXT_WORDS.items())
_COMMENT = " OR ".join(f"(instr(lines[line], {quoted(s)}) > 0 AND instr(lines[line], {quoted(s)}) - 1 < col_no)" for s in patterns.COMMENT_SIGNS)


@query(
    "context_flags",
    f"""SELECT finding_id, coalesce({_COMMENT}, false) AS in_comment,
        {has_sql(window_sql(5, 6), patterns.MOCK_INDICATORS)} AS mock_data, {has_sql(window_sql(5, 6), patterns.FAKE_INDICATORS)} AS obviously_fake,
        ({has_sql('file', patterns.TEST_FILE_WORDS)} OR {has_sql(window_sql(5, 6), patterns.TEST_INDICATORS)}) AS test_data,
        CASE {_CONTEXT_CASE} ELSE false END AS has_context
        FROM (SELECT *, upper(pi_type) AS kind FROM {PLACED}) WHERE file IS NOT NULL AND col_no IS NOT NULL""",
)
def context_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, line, col = F.col("lines"), F.col("line"), F.col("col_no")
    t = placed(spark, sf_dir).where(F.col("file").isNotNull() & F.col("col_no").isNotNull())
    return t.select(
        "finding_id",
        context.in_comment(spans.line_at(lines, line), col).alias("in_comment"),
        context.is_mock_data(lines, line).alias("mock_data"),
        context.is_obviously_fake(lines, line).alias("obviously_fake"),
        context.is_test_data(F.col("file"), lines, line).alias("test_data"),
        context.has_valid_context(F.upper("pi_type"), lines, line).alias("has_context"),
    )


@query(
    "code_shapes",
    f"""SELECT finding_id, CASE WHEN regexp_matches(match_text, {quoted(patterns.CODE_SHAPES['sequential'])}) THEN 'sequential'
        WHEN regexp_matches(match_text, {quoted(patterns.CODE_SHAPES['uuid'])}) THEN 'uuid'
        WHEN regexp_matches(match_text, {quoted(patterns.CODE_SHAPES['hash'])}) THEN 'hash'
        WHEN regexp_matches(lower(context), 'const|var|let|=') THEN 'variable' ELSE 'none' END AS shape FROM findings""",
)
def code_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "findings").select("finding_id", context.code_shape(F.col("match_text"), F.col("context")).alias("shape"))


@query(
    "string_context",
    """SELECT finding_id, (len(regexp_extract_all(s, '(?:^|[^\\\\])''')) % 2 = 1 OR len(regexp_extract_all(s, '(?:^|[^\\\\])"')) % 2 = 1) AS in_string
       FROM (SELECT finding_id, replace(replace(left(context, greatest(coalesce(col_no, 1) - 1, 0)), '''''', ''' '''), '""', '" "') AS s
             FROM findings WHERE context IS NOT NULL)""",
)
def string_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("context").isNotNull())
    return t.select("finding_id", context.in_string(F.col("context"), F.coalesce("col_no", F.lit(1))).alias("in_string"))


_LANGUAGE_CASE = " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in patterns.LANGUAGES.items())


@query(
    "file_languages",
    f"""SELECT language, count(*) AS n_files FROM (SELECT CASE {_LANGUAGE_CASE} ELSE 'unknown' END AS language
        FROM (SELECT lower(regexp_extract(rel_path, '\\.([^./]*)$', 1)) AS e FROM files WHERE rel_path IS NOT NULL)) GROUP BY language""",
)
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "files").where(F.col("rel_path").isNotNull())
    return t.groupBy(context.language(F.col("rel_path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


@query(
    "match_positions",
    """SELECT finding_id, i AS start, length(left(context, i)) - length(replace(left(context, i), chr(10), '')) + 1 AS line,
              i - CASE WHEN contains(left(context, i), chr(10)) THEN length(left(context, i)) - position(chr(10) IN reverse(left(context, i))) + 1 ELSE 0 END + 1 AS col,
              substring(context, greatest(i - 50, 0) + 1, i - greatest(i - 50, 0)) AS before, substring(context, i + length(match_text) + 1, 50) AS after
       FROM (SELECT finding_id, context, match_text, CAST(instr(context, match_text) - 1 AS INT) AS i FROM findings WHERE contains(context, match_text))""",
)
def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.contains("context", "match_text"))
    at, text = F.col("start"), F.col("context")
    return t.withColumn("start", F.instr("context", F.col("match_text")) - 1).select(
        "finding_id",
        "start",
        spans.line_of(text, at).alias("line"),
        spans.column_of(text, at).alias("col"),
        spans.before(text, at, 50).alias("before"),
        spans.after(text, at + F.length("match_text"), 50).alias("after"),
    )


# Paths --------------------------------------------------------------------------------------------------------------


def glob_sql(column: str, globs: tuple[str, ...]) -> str:
    return f"regexp_matches({column}, {quoted('|'.join(map(patterns.glob_pattern, globs)))})"


_P = "replace(rel_path, chr(92), '/')"


@query(
    "files_included",
    f"""SELECT file_id, rel_path, size_bytes FROM files WHERE rel_path IS NOT NULL AND coalesce(size_bytes <= {patterns.MAX_FILE_SIZE}, true)
        AND NOT {glob_sql(_P, patterns.EXCLUDED_FILES)} AND {glob_sql(_P, patterns.INCLUDED_FILES)}""",
)
def files_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "files").where(F.col("rel_path").isNotNull())
    return t.where(discovery.included(F.col("rel_path"), F.col("size_bytes"))).select("file_id", "rel_path", "size_bytes")


_TRIMMED = tuple(dict.fromkeys(g.strip("*/") for g in patterns.TEST_PATHS + patterns.MOCK_PATHS))


@query(
    "path_flags",
    f"""SELECT file_id, starts_with(regexp_extract(rel_path, '[^/]*$'), '.') AS hidden,
        (regexp_matches(rel_path, {quoted(patterns.any_of(patterns.EXCLUDED_PATHS))}) OR {glob_sql('rel_path', patterns.EXCLUDED_PATHS)}) AS excluded,
        CASE WHEN regexp_matches(rel_path, {quoted(patterns.any_of(_TRIMMED))}) OR {glob_sql('rel_path', patterns.TEST_PATHS + patterns.MOCK_PATHS)}
        THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS modifier FROM files WHERE rel_path IS NOT NULL""",
)
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("rel_path")
    t = table(spark, sf_dir, "files").where(p.isNotNull())
    return t.select("file_id", discovery.hidden(p).alias("hidden"), detect.excluded_path(p).alias("excluded"), detect.path_modifier(p).alias("modifier"))


@query(
    "binary_contents",
    r"""SELECT file_id, length(regexp_extract_all(left(file_text, 512), '[\x00-\x08\x0B\x0C\x0E-\x1F]')) * 10 > length(left(file_text, 512)) * 3 AS looks_binary
        FROM files WHERE file_text IS NOT NULL AND regexp_full_match(left(file_text, 512), '[\x01-\x7f]*')""",
)
def binary_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "files").where(F.col("file_text").isNotNull())
    return t.select("file_id", discovery.binary(F.col("file_text").cast("binary")).alias("looks_binary"))


@query(
    "extension_counts",
    r"""SELECT lower(regexp_extract(rel_path, '(\.[^./]*)$', 1)) AS ext, count(*) AS n_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS n_bytes
        FROM files WHERE rel_path IS NOT NULL GROUP BY 1""",
)
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "files").where(F.col("rel_path").isNotNull())
    return t.groupBy(discovery.extension(F.col("rel_path")).alias("ext")).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes")
    )


@query(
    "discovery_stats",
    r"""WITH e AS (SELECT lower(regexp_extract(rel_path, '(\.[^./]*)$', 1)) AS ext, count(*) AS n FROM files WHERE rel_path IS NOT NULL GROUP BY 1)
        SELECT count(*) AS total_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size, count(*) FILTER (WHERE is_binary) AS binary_files, count(*) FILTER (WHERE is_hidden) AS hidden_files,
               (SELECT string_agg(ext || '=' || n, ',' ORDER BY ext || '=' || n) FROM e WHERE ext <> '') AS extensions FROM files WHERE rel_path IS NOT NULL""",
)
def discovery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "files").where(F.col("rel_path").isNotNull())
    told = F.array_sort(F.transform(F.map_entries("extensions"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return discovery.discovery_stats(t, "rel_path", "size_bytes").withColumn("extensions", F.array_join(told, ","))


@query(
    "text_stats",
    "SELECT file_id, strlen(file_text) AS n_bytes, length(file_text) - length(replace(file_text, chr(10), '')) + 1 AS n_lines FROM files WHERE file_text IS NOT NULL",
)
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "files").where(F.col("file_text").isNotNull())
    return discovery.text_stats(t, "file_text").select("file_id", "n_bytes", "n_lines")


_FORMS = [("web", repositories.WEB), ("ssh", repositories.SSH), ("short", repositories.SHORT)]


def addresses_sql(source: str) -> str:
    return rf"""SELECT clone_id, url, CASE {' '.join(f"WHEN regexp_matches(b, {quoted(p)}) THEN regexp_extract(b, {quoted(p)}, 1)" for _, p in _FORMS)} END AS owner,
        CASE {' '.join(f"WHEN regexp_matches(b, {quoted(p)}) THEN regexp_extract(b, {quoted(p)}, 2)" for _, p in _FORMS)} END AS name,
        (regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') AND (NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://github\.com(?:[/?#]|$)')
            OR regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://github\.com/+[^/]+/'))) AS valid,
        (starts_with(url, 'https://') AND length(url) > 8) AS is_https
        FROM (SELECT clone_id, url, regexp_replace(url, '\.git$', '') AS b FROM {source})"""


def addresses(urls: DataFrame) -> DataFrame:
    u = F.col("url")
    who = repositories.owner_and_name(u)
    return urls.select(
        "clone_id", "url", who["owner"].alias("owner"), who["name"].alias("name"), repositories.valid_url(u).alias("valid"), repositories.https_url(u).alias("is_https")
    )


@query("repository_addresses", addresses_sql("(SELECT clone_id, url FROM repositories WHERE url IS NOT NULL)"))
def repository_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(table(spark, sf_dir, "repositories").where(F.col("url").isNotNull()))


_GITHUB = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+', 'https://github.com')"


@query(
    "hosted_addresses",
    addresses_sql(
        f"""(SELECT clone_id, {_GITHUB} AS url FROM repositories WHERE url IS NOT NULL
             UNION ALL SELECT clone_id, regexp_replace({_GITHUB}, '^https://github.com/', 'git@github.com:') FROM repositories WHERE url IS NOT NULL)"""
    ),
)
def hosted_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored addresses with their host replaced by the one whose web and SSH forms have rules of their own."""
    t = table(spark, sf_dir, "repositories").where(F.col("url").isNotNull()).select("clone_id", "url")
    web = t.withColumn("url", F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/]+", "https://github.com"))
    return addresses(web.unionByName(web.withColumn("url", F.regexp_replace("url", "^https://github.com/", "git@github.com:"))))


# Identifiers --------------------------------------------------------------------------------------------------------


def digit_sql(weights: tuple[int, ...], text: str) -> str:
    return " + ".join(f"CAST(substring({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))


def check_sql(kind: str, v: str) -> str:
    if kind == "TFN":
        return f"({digit_sql(checksums.TFN_WEIGHTS, v)}) % 11 = 0"
    if kind == "ABN":
        return f"({digit_sql(checksums.ABN_WEIGHTS, v)} - 10) % 89 = 0"
    if kind == "MEDICARE":
        return f"substring({v}, 1, 1) BETWEEN '2' AND '6' AND ({digit_sql(checksums.MEDICARE_WEIGHTS, v)}) % 10 = CAST(substring({v}, 9, 1) AS INT)"
    if kind == "BSB":
        return f"substring({v}, 3, 1) BETWEEN '2' AND '7'"
    return f"(10 - ({digit_sql(checksums.ACN_WEIGHTS, v)}) % 10) % 10 = CAST(substring({v}, 9, 1) AS INT)"


#: Type -> width and multiplier of an identifier made from an order's key.
MADE = {"TFN": (9, 7919), "ABN": (11, 104729), "MEDICARE": (10, 15485863), "BSB": (6, 7907), "ACN": (9, 32452843)}


def made(kind: str) -> Column:
    width, factor = MADE[kind]
    return F.lpad(((F.col("o_orderkey") * factor) % 10**width).cast("string"), width, "0")


def made_sql(kind: str) -> str:
    width, factor = MADE[kind]
    return f"lpad(CAST((o_orderkey * {factor}) % {10**width} AS VARCHAR), {width}, '0')"


def _check_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = made(kind)
        spaced = F.concat_ws(" ", F.substring(value, 1, 3), F.substring(value, 4, 99)) if kind != "BSB" else value
        return table(spark, sf_dir, "orders").select("o_orderkey", checksums.CHECKS[kind](spaced).alias("valid"), checksums.normalized(F.lit(kind), spaced).alias("normal"))

    return run


for _kind in MADE:
    _v = made_sql(_kind)
    _n = f"substring({_v}, 1, 3) || '-' || substring({_v}, 4)" if _kind == "BSB" else _v
    query(f"check_{_kind.lower()}", f"SELECT o_orderkey, {check_sql(_kind, _v)} AS valid, {_n} AS normal FROM orders")(_check_query(_kind))


_ANY = " ".join(f"WHEN length(v) IN ({n}) AND {check_sql(k, 'v')} THEN '{k}'" for k, n in (("TFN", "9"), ("ABN", "11"), ("MEDICARE", "10"), ("BSB", "6"), ("ACN", "9")))


@query(
    "check_any",
    f"SELECT o_orderkey, CASE {_ANY} END AS kind FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {made_sql('TFN')} WHEN 1 THEN {made_sql('ABN')} WHEN 2 THEN {made_sql('MEDICARE')} WHEN 3 THEN {made_sql('BSB')} ELSE {made_sql('ACN')} END AS v FROM orders)",
)
def check_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = made("ACN")
    for i, k in reversed(list(enumerate(("TFN", "ABN", "MEDICARE", "BSB")))):
        value = F.when(F.col("o_orderkey") % 5 == i, made(k)).otherwise(value)
    return table(spark, sf_dir, "orders").select("o_orderkey", checksums.any_valid(value).alias("kind"))


_KIND = "upper(regexp_replace(trim(pi_type), '[ -]', '_', 'g'))"


def kind_column() -> Column:
    return F.upper(F.regexp_replace(F.trim("pi_type"), "[ -]", "_"))


_MASK = """CASE WHEN n = 0 THEN v WHEN k = 'TFN' AND n >= 9 THEN left(v, 3) || '****' || right(v, 2)
    WHEN k = 'MEDICARE' AND n >= 10 THEN left(v, 2) || '******' || right(v, 2) WHEN k = 'CREDIT_CARD' AND n >= 12 THEN '************' || right(v, 4)
    WHEN k = 'EMAIL' AND len(string_split(v, '@')) = 2 AND length(string_split(v, '@')[1]) > 2 THEN left(v, 2) || '***@' || string_split(v, '@')[2]
    WHEN k = 'PHONE' AND n >= 10 THEN left(v, 4) || '****' || right(v, 2) WHEN n > 2 THEN left(v, 1) || repeat('*', n - 2) || right(v, 1) ELSE repeat('*', n) END"""
_DISPLAY_CASE = " ".join(f"WHEN k = '{k}' THEN '{v}'" for k, v in masking.DISPLAY.items())
_RISK_CASE = " ".join(f"WHEN k = '{k}' THEN {w}" for k, w in patterns.RISK_WEIGHTS.items())


@query(
    "masked_values",
    f"""SELECT finding_id, {_MASK} AS masked, CASE {_DISPLAY_CASE} ELSE k END AS display,
        CASE WHEN w >= 90 THEN 'HIGH' WHEN w >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS risk
        FROM (SELECT *, CASE {_RISK_CASE} ELSE 0 END AS w FROM (SELECT finding_id, match_text AS v, length(match_text) AS n, {_KIND} AS k FROM findings WHERE match_text IS NOT NULL AND pi_type IS NOT NULL))""",
)
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("match_text").isNotNull() & F.col("pi_type").isNotNull())
    k = kind_column()
    return t.select("finding_id", masking.masked(F.col("match_text"), k).alias("masked"), masking.display(k).alias("display"), detect.type_risk(k).alias("risk"))


# Joins, aggregates, sets --------------------------------------------------------------------------------------------


@query(
    "co_occurrences",
    f"""WITH f AS (SELECT DISTINCT coalesce(repo_url, '') || ':' || file_path AS file, {_KIND} AS kind, line_no AS line FROM findings
                   WHERE file_path IS NOT NULL AND pi_type IS NOT NULL AND line_no IS NOT NULL)
        SELECT a.file, a.kind, CAST(a.line AS BIGINT) AS line, b.kind AS other_kind, CAST(min(abs(a.line - b.line)) AS BIGINT) AS distance
        FROM f a JOIN f b ON a.file = b.file AND a.kind <> b.kind AND abs(a.line - b.line) <= 10 GROUP BY ALL""",
)
def co_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings")
    file = F.when(F.col("file_path").isNotNull(), F.concat(F.coalesce("repo_url", F.lit("")), F.lit(":"), "file_path"))
    return pairs.co_occurrences(t.select(file.alias("file"), kind_column().alias("kind"), "line_no"), "file", "kind", "line_no", 10)


@query(
    "expected_found",
    f"""WITH e AS (SELECT DISTINCT {_KIND} AS kind, match_text FROM findings WHERE validated),
             f AS (SELECT DISTINCT {_KIND} AS kind, match_text FROM findings WHERE confidence >= 0.5)
        SELECT coalesce(e.kind, f.kind) AS kind, coalesce(e.match_text, f.match_text) AS match_text,
               CASE WHEN e.r IS NOT NULL AND f.r IS NOT NULL THEN 'TP' WHEN e.r IS NOT NULL THEN 'FN' ELSE 'FP' END AS outcome
        FROM (SELECT *, 1 AS r FROM e) e FULL JOIN (SELECT *, 1 AS r FROM f) f ON e.kind IS NOT DISTINCT FROM f.kind AND e.match_text IS NOT DISTINCT FROM f.match_text""",
)
def expected_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").withColumn("kind", kind_column())
    return pairs.expected_against_found(t.where("validated"), t.where("confidence >= 0.5"), ["kind", "match_text"])


@query(
    "detected_cases",
    rf"""WITH hit AS (SELECT DISTINCT item_id FROM (SELECT item_id, unnest(regexp_extract_all(text, {quoted(patterns.MATCHERS['TFN'])})) AS v FROM eval_items)
            WHERE {ACCEPTED_SQL['TFN']})
         SELECT item_id, pi_type, is_actual_pi, (hit.item_id IS NOT NULL AND pi_type = 'TFN') AS detected FROM eval_items LEFT JOIN hit USING (item_id)""",
)
def detected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a flag whether a matcher of their own type found something; ADDRESS has no matcher, so it is never detected."""
    cases = table(spark, sf_dir, "eval_items")
    kinds = F.array(*[F.when(F.size(detect.matches(F.col("text"), kind)) > 0, F.lit(kind)) for kind in patterns.MATCHERS])
    found = cases.select("item_id", F.explode(F.array_compact(kinds)).alias("pi_type"))
    return pairs.detected_cases(cases, found, "item_id", "pi_type").select("item_id", "pi_type", "is_actual_pi", "detected")


@query(
    "counts_by_type_and_risk",
    f"""SELECT dimension, member, count(*) AS n FROM (SELECT 'type' AS dimension, {_KIND} AS member FROM findings UNION ALL SELECT 'risk', risk_level FROM findings) GROUP BY ALL""",
)
def counts_by_type_and_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.explode(F.array(F.struct(F.lit("type").alias("dimension"), kind_column().alias("member")), F.struct(F.lit("risk").alias("dimension"), F.col("risk_level").alias("member"))))
    return table(spark, sf_dir, "findings").select(both.alias("x")).groupBy("x.dimension", "x.member").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_totals",
    """SELECT count(*) AS n_scans, CAST(sum(total_files) AS BIGINT) AS total_files, CAST(sum(files_scanned) AS BIGINT) AS scanned_files,
              CAST(sum(skipped_files) AS BIGINT) AS skipped_files, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, count(error_text) AS n_failed FROM scans""",
)
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scans").agg(
        F.count(F.lit(1)).alias("n_scans"), F.sum("total_files").alias("total_files"), F.sum("files_scanned").alias("scanned_files"),
        F.sum("skipped_files").alias("skipped_files"), F.sum("total_bytes").alias("total_bytes"), F.count("error_text").alias("n_failed"),
    )


_ACTUAL, _SEEN = "coalesce(validated, false)", "coalesce(confidence, 0) >= 0.5"
_RATES = """, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
    coalesce(2 * (coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) * coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)) / nullif(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) + coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 0), 0) AS f1,
    coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 0) AS accuracy"""
_COUNTS = f"count(*) FILTER (WHERE {_ACTUAL} AND {_SEEN}) AS tp, count(*) FILTER (WHERE NOT {_ACTUAL} AND {_SEEN}) AS fp, count(*) FILTER (WHERE NOT {_ACTUAL} AND NOT {_SEEN}) AS tn, count(*) FILTER (WHERE {_ACTUAL} AND NOT {_SEEN}) AS fn"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as labelled cases: really personal if validated, detected if confident."""
    t = table(spark, sf_dir, "findings")
    return t.select(
        F.coalesce("validated", F.lit(False)).alias("actual"), (F.coalesce("confidence", F.lit(0.0)) >= 0.5).alias("seen"), kind_column().alias("kind"), "risk_level", "detector_name"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "specificity", "accuracy")})


_ROUNDED = "SELECT * REPLACE (round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(specificity, 9) AS specificity, round(accuracy, 9) AS accuracy)"


@query("confusion_overall", f"{_ROUNDED} FROM (SELECT * {_RATES} FROM (SELECT {_COUNTS} FROM findings))")
def confusion_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluate(judged(spark, sf_dir), "actual", "seen"))


@query(
    "confusion_by_group",
    f"""{_ROUNDED} FROM (SELECT * {_RATES} FROM (
        SELECT detector_name, 'all' AS dimension, 'all' AS member, {_COUNTS} FROM findings GROUP BY detector_name
        UNION ALL SELECT detector_name, 'kind', {_KIND}, {_COUNTS} FROM findings GROUP BY ALL
        UNION ALL SELECT detector_name, 'risk_level', risk_level, {_COUNTS} FROM findings GROUP BY ALL))""",
)
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluate_sets(judged(spark, sf_dir), "actual", "seen", "detector_name", "kind", "risk_level"))


@query(
    "best_detectors",
    f"""WITH r AS (SELECT * {_RATES} FROM (SELECT detector_name, {_COUNTS} FROM findings WHERE detector_name IS NOT NULL GROUP BY detector_name)),
             l AS (SELECT detector_name, unnest(['precision', 'recall', 'f1', 'accuracy']) AS metric, unnest([precision, recall, f1, accuracy]) AS value FROM r)
        SELECT metric, detector_name, round(value, 9) AS value FROM l WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, detector_name) = 1""",
)
def best_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = evaluate.evaluate(judged(spark, sf_dir).where(F.col("detector_name").isNotNull()), "actual", "seen", "detector_name")
    return evaluate.best_detectors(rates, "detector_name").withColumn("value", F.round("value", 9))


@query(
    "quality_grades",
    f"""SELECT kind, CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END AS grade
        FROM (SELECT kind, f1 * 0.5::DOUBLE + precision * 0.3::DOUBLE + recall * 0.2::DOUBLE AS s FROM (SELECT * {_RATES} FROM (SELECT {_KIND} AS kind, {_COUNTS} FROM findings GROUP BY 1)))""",
)
def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = evaluate.evaluate(judged(spark, sf_dir), "actual", "seen", "kind")
    return rates.select("kind", evaluate.grade(F.col("precision"), F.col("recall"), F.col("f1")).alias("grade"))


@query(
    "portfolio",
    """SELECT *, CASE WHEN n_critical > 5 THEN 'CRITICAL' WHEN n_high > 10 THEN 'HIGH' WHEN n_medium > 15 THEN 'MEDIUM' ELSE 'LOW' END AS portfolio_risk
       FROM (SELECT count(*) FILTER (WHERE risk_level = 'CRITICAL') AS n_critical, count(*) FILTER (WHERE risk_level = 'HIGH') AS n_high,
                    count(*) FILTER (WHERE risk_level = 'MEDIUM') AS n_medium, count(*) FILTER (WHERE risk_level = 'LOW') AS n_low FROM findings)""",
)
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.portfolio(table(spark, sf_dir, "findings"), "risk_level")


@query(
    "pass_rates",
    f"""SELECT kind, detector_name, count(*) AS cases, count(*) FILTER (WHERE a = d) AS passed, count(*) FILTER (WHERE NOT a AND d) AS false_positives,
               count(*) FILTER (WHERE a AND NOT d) AS misses, round(count(*) FILTER (WHERE a = d) / count(*)::DOUBLE, 9) AS pass_rate
        FROM (SELECT {_KIND} AS kind, detector_name, {_ACTUAL} AS a, {_SEEN} AS d FROM findings) GROUP BY ROLLUP (kind, detector_name)""",
)
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pass_summary(judged(spark, sf_dir), "actual", "seen", "kind", "detector_name").withColumn("pass_rate", F.round("pass_rate", 9))


@query(
    "detection_by_type",
    f"""SELECT {_KIND} AS kind, count(*) AS n, round(count(*) FILTER (WHERE {_SEEN}) / count(*)::DOUBLE, 9) AS detection_rate, round(coalesce(avg(confidence), 0), 6) AS mean_confidence FROM findings GROUP BY 1""",
)
def detection_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings")
    seen = F.count_if(F.coalesce("confidence", F.lit(0.0)) >= 0.5)
    return t.groupBy(kind_column().alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(seen / F.count(F.lit(1)), 9).alias("detection_rate"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence")
    )


@query(
    "running_mean",
    """SELECT scan_id, round(avg(duration_ns / 1000000000.0::DOUBLE) OVER (PARTITION BY repo_url ORDER BY scan_started, scan_id ROWS UNBOUNDED PRECEDING), 6) AS mean_seconds
       FROM scans WHERE duration_ns IS NOT NULL""",
)
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "scans").where(F.col("duration_ns").isNotNull()).select("scan_id", "repo_url", "scan_started", (F.col("duration_ns") / 1e9).alias("s"))
    return evaluate.running_mean(t, "repo_url", "scan_started", "scan_id", "s").select("scan_id", F.round("mean", 6).alias("mean_seconds"))


@query(
    "report_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE validated) AS n_validated, count(*) FILTER (WHERE context_modifier <= 0.1) AS n_test, count(DISTINCT {_KIND}) AS n_types,
               round(coalesce(count(*) FILTER (WHERE validated) / nullif(count(*), 0)::DOUBLE, 0), 9) AS validation_rate FROM findings""",
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "findings").agg(
        n.alias("total"), F.count_if("validated").alias("n_validated"), F.count_if(F.col("context_modifier") <= 0.1).alias("n_test"), F.count_distinct(kind_column()).alias("n_types"),
        F.round(evaluate.ratio(F.count_if("validated"), n), 9).alias("validation_rate"),
    )


@query("top_files", "SELECT file_path, count(*) AS n_findings FROM findings WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten files with most findings: a top-k report."""
    t = table(spark, sf_dir, "findings").where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_findings"))
    return t.orderBy(F.desc("n_findings"), "file_path").limit(10)


@query(
    "sorted_findings",
    "SELECT finding_id, file_path, line_no, col_no, pi_type FROM findings ORDER BY file_path NULLS FIRST, line_no NULLS FIRST, col_no NULLS FIRST, pi_type NULLS FIRST, finding_id",
)
def sorted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "findings").select("finding_id", "file_path", "line_no", "col_no", "pi_type").orderBy("file_path", "line_no", "col_no", "pi_type", "finding_id")


@query("matches_only_rules", "SELECT match_text FROM findings WHERE detector_name = 'gitleaks-detector' EXCEPT SELECT match_text FROM findings WHERE detector_name = 'pattern-detector'")
def matches_only_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings")
    pick = lambda d: t.where(F.col("detector_name") == d).select("match_text")
    return pick("gitleaks-detector").subtract(pick("pattern-detector"))


@query("matches_of_both", "SELECT match_text FROM findings WHERE detector_name = 'gitleaks-detector' INTERSECT SELECT match_text FROM findings WHERE detector_name = 'pattern-detector'")
def matches_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings")
    pick = lambda d: t.where(F.col("detector_name") == d).select("match_text")
    return pick("gitleaks-detector").intersect(pick("pattern-detector"))


# Sinks and streams --------------------------------------------------------------------------------------------------


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings under the names that reports use."""
    t = table(spark, sf_dir, "findings")
    return t.select(
        "finding_id", "repo_url", F.coalesce("file_path", F.lit("")).alias("file"), F.col("line_no").alias("line"), F.col("col_no").alias("col"), kind_column().alias("kind"),
        F.col("match_text").alias("value"), "context", "validated", "confidence", "risk_level", (F.col("context_modifier") <= 0.1).alias("is_test"),
    )


_RULE_CASE = " ".join(f"WHEN k = '{k}' THEN '{i}'" for i, k, _ in reports.SARIF_RULES)
_LEVEL_CASE = " ".join(f"WHEN k = '{k}' THEN '{lv}'" for _, k, lv in reports.SARIF_RULES)
_INDEX_CASE = " ".join(f"WHEN k = '{k}' THEN {n}" for n, (_, k, _) in enumerate(reports.SARIF_RULES))


@query(
    "sarif_fields",
    f"""SELECT finding_id, CASE {_RULE_CASE} ELSE 'PI999' END AS rule_id, CASE {_INDEX_CASE} ELSE -1 END AS rule_index, CASE {_LEVEL_CASE} ELSE 'note' END AS level,
        CASE risk_level WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END AS risk_level,
        replace(file_path, chr(92), '/') AS uri FROM (SELECT *, {_KIND} AS k FROM findings)""",
)
def sarif_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kind_column()
    return table(spark, sf_dir, "findings").select(
        "finding_id", reports.rule_id(k).alias("rule_id"), reports.rule_index(k).alias("rule_index"), reports.default_level(k).alias("level"),
        reports.risk_level(F.col("risk_level")).alias("risk_level"), reports.uri(F.col("file_path")).alias("uri"),
    )


_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(':', coalesce(file_path, ''), k, CAST(line_no AS VARCHAR), match_text)))"


@query(
    "fingerprints",
    f"""SELECT finding_id, lower(hex(encode(substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || lower(hex((('0x' || substr(d, 17, 2))::INT & 63) | 128)) || substr(d, 19, 2) || '-' || substr(d, 21, 12)))) AS fingerprint
        FROM (SELECT finding_id, {_SHA} AS d FROM (SELECT *, {_KIND} AS k FROM findings))""",
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reported(spark, sf_dir)
    return t.select("finding_id", reports.fingerprint(F.col("file"), F.col("kind"), F.col("line"), F.col("value")).alias("fingerprint"))


@query("sarif_logs")
def sarif_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_report(reported(spark, sf_dir), "sundew", "0.1.0", ["repo_url"])


_NOW = "2026-01-01 00:00:00"


def _at():
    from datetime import datetime

    return datetime(2026, 1, 1)


@query(
    "csv_findings",
    f"""SELECT '{_NOW}' AS "Timestamp", 'all' AS "Repository", 'main' AS "Branch", coalesce(file_path, '') AS "File Path", CAST(coalesce(line_no, 0) AS VARCHAR) AS "Line",
        CAST(coalesce(col_no, 0) AS VARCHAR) AS "Column", coalesce(k, '') AS "PI Type", CASE {_DISPLAY_CASE} ELSE coalesce(k, '') END AS "PI Type Display",
        CASE WHEN coalesce(validated, false) THEN 'true' ELSE 'false' END AS "Validated", 'false' AS "Test Data", printf('%.2f', coalesce(confidence, 0)) AS "Confidence Score",
        coalesce(risk_level, 'UNKNOWN') AS "Risk Level", '0.00' AS "Risk Score", {_MASK} AS "Masked Value", '0.00' AS "Impact Score", '0.00' AS "Likelihood Score",
        '0.00' AS "Exposure Score", '' AS "Risk Category", 'unknown' AS "Environment", 'false' AS "APRA Relevant", 'false' AS "Privacy Act Issue", 'false' AS "Notifiable Breach"
        FROM (SELECT *, coalesce(match_text, '') AS v, length(coalesce(match_text, '')) AS n FROM (SELECT *, coalesce({_KIND}, '') AS k FROM findings))""",
)
def csv_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.csv_rows(reported(spark, sf_dir), "all", "main", _at())


_SUM = " UNION ALL ".join(
    f"SELECT '{m}' AS \"Metric\", CAST({c} AS VARCHAR) AS \"Value\", CASE WHEN total = 0 THEN '0.0%' ELSE printf('%.1f%%', {c} / total::DOUBLE * 100) END AS \"Percentage\" FROM c"
    for m, c in (("Critical Risk", "n_c"), ("High Risk", "n_h"), ("Medium Risk", "n_m"), ("Low Risk", "n_l"), ("Validated PI", "n_v"), ("Test Data", "n_t"))
)


@query(
    "csv_summary",
    f"""WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS n_c, count(*) FILTER (WHERE risk_level = 'HIGH') AS n_h, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS n_m,
            count(*) FILTER (WHERE risk_level = 'LOW') AS n_l, count(*) FILTER (WHERE validated) AS n_v, count(*) FILTER (WHERE context_modifier <= 0.1) AS n_t FROM findings)
        SELECT 'Repository' AS "Metric", 'all' AS "Value", '' AS "Percentage" UNION ALL SELECT 'Branch', 'main', '' UNION ALL SELECT 'Scan Date', '{_NOW}', ''
        UNION ALL SELECT 'Scan Duration', '1.50 seconds', '' UNION ALL SELECT 'Total Findings', CAST(total AS VARCHAR), '100.0%' FROM c UNION ALL {_SUM}""",
)
def csv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary_rows(reported(spark, sf_dir), "all", "main", _at(), 1.5)


@query(
    "windowed_counts",
    """SELECT time_bucket(INTERVAL 1 hour, ts) AS start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS stop, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"])


# Proximity ----------------------------------------------------------------------------------------------------------


def m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


_TYPES = (("test", proximity.TEST_DATA), ("label", proximity.LABEL), ("database", proximity.DATABASE), ("form", proximity.FORM), ("log", proximity.LOG), ("config", proximity.CONFIG),
          ("variable", proximity.VARIABLE), ("documentation", proximity.DOCUMENTATION))
_CONFIDENCE = " + ".join(
    f"CASE WHEN {m('context', p)} THEN {v}::DOUBLE ELSE 0 END"
    for p, v in ((proximity.LABEL, 0.8), (proximity.DATABASE, 0.6), (proximity.FORM, 0.6), (proximity.LOG, 0.4), (proximity.CONFIG, 0.3), (proximity.DOCUMENTATION, -0.3), (proximity.VARIABLE, -0.2))
)
_STRONG = " + ".join(f"CASE WHEN contains(lower(context), '{w}') THEN 0.2::DOUBLE ELSE 0 END" for w in proximity.STRONG_TEST)
_HITS = f"len(regexp_extract_all(context, {quoted(proximity.TEST_DATA)}))"


@query(
    "context_types",
    f"""SELECT finding_id, CASE {' '.join(f"WHEN {m('context', p)} THEN '{n}'" for n, p in _TYPES)} ELSE 'production' END AS context_type,
        round(least(greatest({_CONFIDENCE}, 0), 1), 6) AS confidence, round(CASE WHEN {_HITS} = 0 THEN 0 ELSE least(1, least(1, {_HITS} * 0.3::DOUBLE) + {_STRONG}) END, 6) AS test_confidence
        FROM findings WHERE context IS NOT NULL""",
)
def context_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("context").isNotNull())
    c = F.col("context")
    return t.select(
        "finding_id", proximity.context_type(c).alias("context_type"), F.round(proximity.context_confidence(c), 6).alias("confidence"),
        F.round(proximity.test_confidence(c), 6).alias("test_confidence"),
    )


@query(
    "context_labels",
    f"""SELECT finding_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(context, {quoted(proximity.LABEL)}), lambda x: lower(trim(regexp_replace(regexp_replace(x, '\\s+$', ''), '[:=]+$', '')))))), '|') AS labels
        FROM findings""",
)
def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "findings").select("finding_id", F.array_join(F.array_sort(F.transform(proximity.labels(F.col("context")), F.lower)), "|").alias("labels"))


_NEAR = "substring(context, greatest(i - 200, 0) + 1, least(i + n + 200, length(context)) - greatest(i - 200, 0))"
_STRUCT_CASE = " ".join(f"WHEN {m('s', p)} THEN '{k}'" for k, p in proximity.STRUCTURES.items())


@query(
    "structures",
    f"""SELECT finding_id, k AS structure, CASE WHEN k = 'json' THEN length(s) - length(replace(replace(s, chr(123), ''), '[', '')) WHEN k IN ('xml', 'html') THEN (length(s) - length(replace(s, '<', ''))) // 2
          WHEN k = 'yaml' THEN list_max(list_transform(string_split(s, chr(10)), lambda x: length(x) - length(ltrim(replace(x, chr(9), ' '))))) // 2 ELSE 0 END AS nesting
        FROM (SELECT finding_id, s, CASE {_STRUCT_CASE} ELSE 'plain_text' END AS k FROM (SELECT finding_id, {_NEAR} AS s FROM (
            SELECT finding_id, context, greatest(instr(context, match_text) - 1, 0) AS i, length(match_text) AS n FROM findings WHERE context IS NOT NULL AND match_text IS NOT NULL)))""",
)
def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("context").isNotNull() & F.col("match_text").isNotNull())
    at = F.greatest(F.instr("context", F.col("match_text")) - 1, F.lit(0))
    s = proximity.structure(F.col("context"), at, at + F.length("match_text"))
    return t.select("finding_id", s.alias("s")).select("finding_id", F.col("s.type").alias("structure"), F.col("s.nesting").alias("nesting"))


_SEM = "0.5::DOUBLE"
for _words, _gain in ((proximity.PERSON_WORDS, 0.1), (("ssn",), 0.2), (proximity.DOUBT_WORDS, -0.2)):
    _SEM += "".join(f" + CASE WHEN contains(s, '{w}') THEN {_gain}::DOUBLE ELSE 0 END" for w in _words)
for _words, _gain, _ in proximity.GROUP_WORDS.values():
    _SEM += f" + CASE WHEN {m('s', patterns.any_of(_words))} THEN {_gain}::DOUBLE ELSE 0 END"
_HINTS = ", ".join(f"CASE WHEN {m('s', patterns.any_of(w))} THEN '{k}' END" for k, w in proximity.TYPE_HINTS.items())


@query(
    "semantics",
    f"""SELECT finding_id, round(least(greatest({_SEM}, 0), 1), 6) AS confidence, array_to_string(list_filter([{_HINTS}], lambda x: x IS NOT NULL), '|') AS types
        FROM (SELECT finding_id, lower(substring(context, greatest(i - 100, 0) + 1, i - greatest(i - 100, 0)) || substring(context, i + n + 1, 100)) AS s FROM (
            SELECT finding_id, context, greatest(instr(context, match_text) - 1, 0) AS i, length(match_text) AS n FROM findings WHERE context IS NOT NULL AND match_text IS NOT NULL))""",
)
def semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("context").isNotNull() & F.col("match_text").isNotNull())
    at = F.greatest(F.instr("context", F.col("match_text")) - 1, F.lit(0))
    s = proximity.semantics(F.col("context"), at, at + F.length("match_text"))
    return t.select("finding_id", s.alias("s")).select("finding_id", F.round("s.confidence", 6).alias("confidence"), F.array_join("s.types", "|").alias("types"))


_AROUND = "substring(context, greatest(i - {n}, 0) + 1, i - greatest(i - {n}, 0)) || match_text || substring(context, i + n + 1, {n})"
_WHY_TEST = " ".join(f"WHEN contains(lower(near), '{'demo ' if w == 'demo' else w}') THEN '{w} data indicator'" for w in proximity.TEST_REASONS)
_CONTEXTS = (
    ("documentation", m("win", proximity.DOCUMENTATION)), ("database", m("win", proximity.DATABASE)),
    ("log", f"({m('win', proximity.LOG)} AND {m('win', patterns.any_of(proximity.STRONG_LOG))})"), ("config", f"({m('win', proximity.CONFIG)} AND {m('lower(win)', patterns.any_of(proximity.STRONG_CONFIG))})"),
    ("label", m("win", proximity.LABEL)), ("form", m("win", proximity.FORM)), ("variable", m("win", proximity.VARIABLE)),
)
_COUNT_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_FOUND_LABELS = f"list_filter(list_transform(regexp_extract_all(win, {quoted(proximity.LABEL)}), lambda x: lower(trim(regexp_replace(regexp_replace(x, '\\s+$', ''), '[:=]+$', '')))), lambda x: x <> '')"
_BEHIND = f"list_transform(list_filter({_FOUND_LABELS}, lambda x: contains(lower(bef), x)), lambda x: {_COUNT_WORDS.format('substr(lower(bef), length(bef) - instr(reverse(lower(bef)), reverse(x)) + 2)')} + 1)"
#: Each finding's analysis: score, reason, context, is_test, distance.
ANALYSIS = f"""
    WITH p AS (SELECT finding_id, confidence, risk_level, context, match_text, greatest(instr(context, match_text) - 1, 0) AS i, length(match_text) AS n FROM findings WHERE context IS NOT NULL AND match_text IS NOT NULL),
         w AS (SELECT *, {_AROUND.format(n=30)} AS near, CASE WHEN length(context) < 100 THEN context ELSE {_AROUND.format(n=50)} END AS win, substring(context, greatest(i - 50, 0) + 1, i - greatest(i - 50, 0)) AS bef FROM p),
         c AS (SELECT *, {m('near', proximity.TEST_DATA)} AS is_test, CASE {' '.join(f"WHEN {t} THEN '{k}'" for k, t in _CONTEXTS)} ELSE 'production' END AS ctx, {_COUNT_WORDS.format('bef')} AS nw,
                      least({_COUNT_WORDS.format('bef')}, coalesce(list_min({_BEHIND}), {_COUNT_WORDS.format('bef')})) AS near_label FROM w),
         d AS (SELECT *, CASE WHEN ctx = 'production' THEN 5 WHEN ctx <> 'label' THEN 1 WHEN length(trim(bef)) < 20 OR nw = 0 THEN 1 WHEN near_label = nw OR near_label > 5 THEN 5 ELSE near_label END AS far FROM c),
         a AS (SELECT *, CASE WHEN is_test THEN 0.1::DOUBLE ELSE CASE ctx {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in proximity.BASE_SCORES.items())} ELSE 0.5::DOUBLE END
                      * CASE WHEN ctx = 'label' AND far > 2 THEN greatest(0.7::DOUBLE, 1 - (far - 2) * 0.05::DOUBLE) ELSE 1 END END AS score FROM d)
"""


@query(
    "proximity_analysis",
    ANALYSIS
    + f"""SELECT finding_id, round(score, 9) AS score, CASE WHEN is_test THEN CASE {_WHY_TEST} ELSE 'test data indicator' END ELSE CASE ctx {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in proximity.REASONS.items())}
            ELSE 'general context' END END AS reason, CASE WHEN is_test THEN 'test' ELSE ctx END AS context, is_test, CAST(CASE WHEN NOT is_test THEN far END AS INT) AS distance FROM a""",
)
def proximity_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("context").isNotNull() & F.col("match_text").isNotNull())
    at = F.greatest(F.instr("context", F.col("match_text")) - 1, F.lit(0))
    a = proximity.analysis(F.col("context"), F.col("match_text"), at, at + F.length("match_text"))
    return t.select("finding_id", a.alias("a")).select("finding_id", "a.*").withColumn("score", F.round("score", 9))


@query(
    "enhanced_findings",
    ANALYSIS
    + """SELECT finding_id, round(confidence * score, 9) AS confidence, CASE WHEN is_test THEN 0.1::DOUBLE ELSE round(score, 9) END AS context_modifier, CASE WHEN is_test THEN 'LOW' ELSE risk_level END AS risk_level,
            substring(context, greatest(i - 25, 0) + 1, i - greatest(i - 25, 0)) AS before, substring(context, i + n + 1, 25) AS after FROM a""",
)
def enhanced_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("context").isNotNull() & F.col("match_text").isNotNull())
    e = proximity.enhanced(F.col("context"), F.col("match_text"), F.col("confidence"), F.col("risk_level"))
    out = t.select("finding_id", e.alias("e")).select("finding_id", "e.*")
    return out.withColumns({c: F.round(c, 9) for c in ("confidence", "context_modifier")})


_WORDS = "regexp_extract_all(lower({}), '[0-9A-Za-z_]+')"
_BACK, _AHEAD = _WORDS.format("substring(context, greatest(i - 100, 0) + 1, i - greatest(i - 100, 0))"), _WORDS.format("substring(context, i + n + 1, 100)")


@query(
    "nearest_keywords",
    f"""SELECT finding_id, d AS distance, CASE WHEN d IS NULL THEN NULL WHEN d = t THEN 'tfn' WHEN d = a THEN 'abn' ELSE 'info' END AS keyword,
        len(list_filter({_WORDS.format('context')}, lambda w: w IN ('tfn', 'abn', 'info'))) AS n_keywords FROM (
        SELECT *, least(t, a, f) AS d FROM (SELECT finding_id, context, {', '.join(
            f"CASE WHEN list_position(list_reverse({_BACK}), '{w}') > 0 THEN list_position(list_reverse({_BACK}), '{w}') WHEN list_position({_AHEAD}, '{w}') > 0 THEN list_position({_AHEAD}, '{w}') END AS {x}"
            for w, x in (('tfn', 't'), ('abn', 'a'), ('info', 'f')))}
        FROM (SELECT finding_id, context, greatest(instr(context, match_text) - 1, 0) AS i, length(match_text) AS n FROM findings WHERE context IS NOT NULL AND match_text IS NOT NULL)))""",
)
def nearest_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("context").isNotNull() & F.col("match_text").isNotNull())
    at = F.greatest(F.instr("context", F.col("match_text")) - 1, F.lit(0))
    k = proximity.nearest_keyword(F.col("context"), ["tfn", "abn", "info"], at, at + F.length("match_text"))
    n = proximity.count_keywords(F.col("context"), ["tfn", "abn", "info"])
    return t.select("finding_id", k.alias("k"), n.alias("n_keywords")).select("finding_id", F.col("k.distance").alias("distance"), F.col("k.keyword").alias("keyword"), "n_keywords")


# Generated cases ----------------------------------------------------------------------------------------------------


@query("generated_cases")
def generated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of three detectors on generated cases: as many of each type as there are customers."""
    made = generate.cases(spark, table(spark, sf_dir, "customer").count()).withColumn("id", F.xxhash64("case_id", "kind", "value"))
    cases = durable(made)  # five uses of a wide union
    raw = detect.detect(cases, "id", "filename", "code", gates=False)
    found = {
        "patterns": raw,
        "context": context.validated(detect.detect(cases, "id", "filename", "code")),
        "plain": context.plainly_filtered(raw),
    }
    judged = None
    for name, f in found.items():
        hits = f.where(F.col("confidence") > 0.5).select(F.col("id").alias("_id"), F.col("kind").alias("_kind")).distinct()
        joined = cases.join(hits, (F.col("id") == F.col("_id")) & (F.col("kind") == F.col("_kind")), "left")
        one = joined.select(F.lit(name).alias("detector"), "is_actual", F.col("_id").isNotNull().alias("detected"), "kind", "context")
        judged = one if judged is None else judged.unionByName(one)
    return evaluate.evaluate_sets(judged, "is_actual", "detected", "detector", "kind", "context")


# SQL of whole detection: candidates with positions, the ordered fold, gates and checks ------------------------------


def _candidates_sql(number: int, kind: str) -> str:
    """Accepted matches of one kind with their offsets: pieces between the matches are as long as they are apart."""
    pattern = quoted(patterns.MATCHERS[kind])
    value = f"regexp_extract(vals[j], {quoted(patterns.ACN_DIGITS)}, 0)" if kind == "ACN" else "vals[j]"
    return f"""SELECT * FROM (SELECT id, {number} AS k, '{kind}' AS kind, {value} AS v, s, s + length(vals[j]) AS e FROM (
        SELECT id, vals, j, list_sum(list_transform(gaps[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:j - 1], lambda x: length(x))), 0) AS s FROM (
            SELECT id, vals, gaps, unnest(range(1, len(vals) + 1)) AS j FROM (
                SELECT id, regexp_extract_all(text, {pattern}) AS vals, regexp_split_to_array(text, {pattern}) AS gaps FROM t WHERE regexp_matches(text, {pattern}))))) WHERE {ACCEPTED_SQL[kind]}"""


_CLEAN = r"regexp_replace(v, '[\t\n\f\r /\-]', '', 'g')"


def _valid_sql(kind: str, digits: str) -> str:
    return f"WHEN kind = '{kind}' THEN CASE WHEN regexp_full_match(c, '{digits}') THEN {check_sql(kind, 'c')} ELSE false END"


_VALID = " ".join(_valid_sql(k, d) for k, d in (("TFN", "[0-9]{9}"), ("ABN", "[0-9]{11}"), ("MEDICARE", "[0-9]{10,11}"), ("BSB", "[0-9]{6}"), ("ACN", "[0-9]{9}")))


def detect_sql(source: str, key: str, path: str, gates: bool = True) -> str:
    """Common table expressions up to ``found``: what ``detect`` gives, with all lines of the text and the line's number."""
    parts = " UNION ALL ".join(_candidates_sql(i, k) for i, k in enumerate(patterns.MATCHERS))
    test, mock = has_sql(window_sql(3, 3), patterns.TEST_WORDS), has_sql(window_sql(2, 2), patterns.MOCK_WORDS)
    example = f"(regexp_matches(lines[line], '//|#|/\\*|\\*/') AND {has_sql('lines[line]', patterns.EXAMPLE_WORDS)})"
    name = "regexp_extract(file, '[^/]*$')"
    modifier = f"CASE WHEN regexp_matches({name}, {quoted(patterns.any_of(_TRIMMED))}) OR {glob_sql(name, patterns.TEST_PATHS + patterns.MOCK_PATHS)} THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END"
    gate = f"WHERE NOT ((context_modifier > 0.1 AND {test}) OR {example} OR {mock})" if gates else ""
    return f"""WITH t AS (SELECT * FROM (SELECT {key} AS id, coalesce({path}, '') AS file, text FROM {source}) WHERE text IS NOT NULL AND strlen(text) <= {patterns.MAX_FILE_SIZE}
            AND NOT (regexp_matches({name}, {quoted(patterns.any_of(patterns.EXCLUDED_PATHS))}) OR {glob_sql(name, patterns.EXCLUDED_PATHS)})),
        candidates AS ({parts}),
        ordered AS (SELECT id, list([struct_pack(kind := kind, v := v, s := s, e := e)] ORDER BY k, s) AS l FROM candidates GROUP BY id),
        folded AS (SELECT id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda r: (x[1].s >= r.s AND x[1].s < r.e) OR (x[1].e > r.s AND x[1].e <= r.e))) > 0
            THEN acc ELSE list_concat(acc, x) END) AS l FROM ordered),
        kept AS (SELECT id, m.kind AS kind, m.v AS v, CAST(m.s AS INT) AS s, CAST(m.e AS INT) AS e FROM (SELECT id, unnest(l) AS m FROM folded)),
        placed AS (SELECT kept.*, file, text, {_CLEAN} AS c, length(left(text, s)) - length(replace(left(text, s), chr(10), '')) + 1 AS line, string_split(text, chr(10)) AS lines, {modifier} AS context_modifier
            FROM kept JOIN t USING (id)),
        judged AS (SELECT *, CASE {_VALID} END AS ok, CASE {' '.join(f"WHEN kind = '{k}' THEN {w}" for k, w in patterns.RISK_WEIGHTS.items())} ELSE 0 END AS w FROM placed {gate}),
        found AS (SELECT id, file, kind, v AS value, s AS start, e AS stop, CAST(line AS INT) AS line, text, lines, context_modifier,
            CAST(s - CASE WHEN line > 1 THEN length(array_to_string(lines[1:line - 1], chr(10))) + 1 ELSE 0 END + 1 AS INT) AS col,
            substring(text, greatest(s - 50, 0) + 1, s - greatest(s - 50, 0)) AS context_before, substring(text, e + 1, 50) AS context_after,
            CASE WHEN ok IS NULL THEN 0.8::DOUBLE WHEN ok THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS confidence, coalesce(ok, false) AS validated,
            CASE WHEN w >= 90 THEN 'HIGH' WHEN w >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 'pattern-detector' AS detector_name FROM judged)
    """


ORACLE["detect_findings"] = detect_sql(SNIPPETS, "finding_id", "file_path") + "SELECT * EXCLUDE (text, lines) FROM found"
ORACLE["detect_files"] = detect_sql("(SELECT file_id, rel_path, file_text AS text FROM files)", "file_id", "rel_path") + "SELECT * EXCLUDE (text, lines) FROM found"
_ALL = ("id", "file", "kind", "value", "risk_level", "confidence", "context_modifier", "detector_name")
ORACLE["detect_all"] = (
    detect_sql(SNIPPETS, "finding_id", "file_path")
    + f"""SELECT {', '.join(_ALL)} FROM found UNION ALL SELECT r.id, p.file_path, kind, value, risk_level, 0.9::DOUBLE, CASE WHEN regexp_matches(lower(file_path), 'test|spec|mock') THEN 0.1::DOUBLE
        WHEN regexp_matches(lower(file_path), 'example|sample') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 'gitleaks-detector' FROM ({ORACLE['rule_findings']}) r JOIN {SNIPPETS} p ON r.id = p.finding_id"""
)
_OPEN_QUOTE = "len(regexp_extract_all({s}, '(?:^|[^\\\\]){q}')) % 2 = 1"
_BEFORE_COL = "replace(replace(left(lines[line], greatest(col - 1, 0)), chr(39) || chr(39), chr(39) || ' ' || chr(39)), chr(34) || chr(34), chr(34) || ' ' || chr(34))"
_SHAPE_TEXT = window_sql(5, 6)
ORACLE["detect_validated"] = (
    detect_sql(SNIPPETS, "finding_id", "file_path")
    + f""", second AS (SELECT *, confidence AS detector_confidence,
            ({' OR '.join(f"(instr(lines[line], {quoted(x)}) > 0 AND instr(lines[line], {quoted(x)}) - 1 < col)" for x in patterns.COMMENT_SIGNS)}) AS in_comment,
            ({_OPEN_QUOTE.format(s=_BEFORE_COL, q="''")} OR {_OPEN_QUOTE.format(s=_BEFORE_COL, q='"')}) AS in_string,
            CASE {' '.join(f"WHEN lower(regexp_extract(file, '\\.([^./]*)$', 1)) = '{k}' THEN '{v}'" for k, v in patterns.LANGUAGES.items())} ELSE 'unknown' END AS language,
            ({has_sql('file', patterns.TEST_FILE_WORDS)} OR {has_sql(window_sql(5, 6), patterns.TEST_INDICATORS)}) AS is_test_data, {has_sql(window_sql(5, 6), patterns.MOCK_INDICATORS)} AS is_mock_data,
            CASE {_CONTEXT_CASE} ELSE false END AS has_context, {has_sql(window_sql(5, 6), patterns.FAKE_INDICATORS)} AS fake,
            CASE WHEN regexp_matches(value, {quoted(patterns.CODE_SHAPES['sequential'])}) THEN 'sequential' WHEN regexp_matches(value, {quoted(patterns.CODE_SHAPES['uuid'])}) THEN 'uuid'
                WHEN regexp_matches(value, {quoted(patterns.CODE_SHAPES['hash'])}) THEN 'hash' WHEN regexp_matches(lower({_SHAPE_TEXT}), 'const|var|let|=') THEN 'variable' ELSE 'none' END AS code_shape FROM found)
        SELECT * EXCLUDE (text, lines, fake, confidence), CASE WHEN has_context THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
            CASE WHEN has_context THEN 'Valid context found' ELSE 'Pattern match' END AS reason FROM second WHERE NOT (in_comment AND fake) AND code_shape NOT IN ('uuid', 'hash')"""
)
