"""Queries of the problems tagged llm, with SQL for DuckDB where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.llm import history, leak, personal, repetition, secrets, source_files, tokens, variants
from sundew.session import table

TEXTS = ["match_text", "context", "context_before", "context_after"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "findings"), "finding_id", TEXTS).select("finding_id")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with the credentials in their texts replaced."""
    return secrets.redacted(table(spark, sf_dir, "findings"), "finding_id", TEXTS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files.not_hand_written(table(spark, sf_dir, "files")).select("file_id")


def p4_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository, its hand-written source files: text rows that are nothing else."""
    files = table(spark, sf_dir, "files")
    flagged = source_files.not_hand_written(files).select("file_id").distinct()
    kept = files.where(F.col("file_text").isNotNull()).join(flagged, "file_id", "left_anti")
    return kept.select("file_id", "repo_url", "rel_path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "findings"), "finding_id", "pi_type", TEXTS)


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with the personal details in their texts replaced by their kind."""
    return personal.masked(table(spark, sf_dir, "findings"), "finding_id", "pi_type", TEXTS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.pivot_table(table(spark, sf_dir, "findings"), table(spark, sf_dir, "scans"))
    return history.found_before(rows, rows)


def p6_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that stay in the accepted history after all batches."""
    rows = history.pivot_table(table(spark, sf_dir, "findings"), table(spark, sf_dir, "scans"))
    return rows.join(history.found_before(rows, rows), "finding_id", "left_anti").select("finding_id", "place", "line", "match")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = variants.copies(table(spark, sf_dir, "findings"), "finding_id", "pi_type", "match_text")
    return pairs.select(F.col("a").alias("finding_id_a"), F.col("b").alias("finding_id_b"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group of copies: its first finding, its number of copies and of spellings."""
    return variants.collapsed(table(spark, sf_dir, "findings"), "finding_id", "pi_type", "match_text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode(p8_ids(spark, sf_dir), "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also quotes with up to two changed, missing or added words in each sixteen."""
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edits=2, repetitions=12, samples=5)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents")).where(~F.col("retained")).select("doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of repeated text of each document."""
    return repetition.repetition(table(spark, sf_dir, "documents"))


QUERIES = {
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_hand_written": p4_hand_written,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p6_found": p6_found,
    "p6_accepted": p6_accepted,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_near": p9_near,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}

#: Canonical form of match_text as in ``variants.canonical``.
CANONICAL = r"""
    WITH base AS (
        SELECT finding_id, regexp_replace(lower(pi_type), '[^\p{L}\p{N}]+', '', 'g') AS kind, match_text AS t,
               list_filter(regexp_split_to_array(match_text, '[;,{}\n]'), lambda s: regexp_matches(s, '[\p{L}\p{N}]')) AS seg
        FROM findings WHERE pi_type IS NOT NULL AND match_text IS NOT NULL
    ), keyed AS (
        SELECT finding_id, kind, CASE
            WHEN len(seg) >= 2 AND len(list_filter(seg, lambda s: NOT regexp_matches(s, '^[^\p{L}\p{N}]*[\p{L}_][\p{L}_ ]*[''"]?\s*[=:]'))) = 0
                THEN '1' || array_to_string(list_sort(list_transform(seg, lambda s: regexp_replace(lower(s), '[^\p{L}\p{N}]+', '', 'g'))), '|')
            WHEN regexp_matches(t, '^[\p{L}\s,;''"<>().\[\]-]+$')
                THEN '2' || array_to_string(list_sort(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda s: s <> '')), ' ')
            ELSE '3' || regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g') END AS canon
        FROM base
    )
"""

#: One finding per row with what decides whether another is the same: place, line, canonical form, kind, digits, order.
PLACED = r"""
    WITH base AS (
        SELECT finding_id, coalesce(epoch_us(scan_started), 9223372036854775807) AS started, repo_url, line_no AS line, match_text AS t,
               regexp_extract(regexp_replace(repo_url, '(?:\.git)?/*$', ''), '([^/:]+)$', 1) AS name, regexp_replace(replace(trim(file_path), '\', '/'), '/{2,}|/(?:\./)+', '/', 'g') AS path,
               list_filter(regexp_split_to_array(match_text, '[;,{}\n]'), lambda s: regexp_matches(s, '[\p{L}\p{N}]')) AS seg
        FROM findings LEFT JOIN (SELECT scan_id, scan_started FROM scans) USING (scan_id)
        WHERE repo_url IS NOT NULL AND file_path IS NOT NULL AND line_no IS NOT NULL AND match_text IS NOT NULL
    ), keyed AS (
        SELECT finding_id, started, line, repo_url, regexp_replace(CASE WHEN regexp_matches(path, '^(?:/|[A-Za-z]:/)') AND length(name) > 0 AND instr(path, '/' || name || '/') > 0
                   THEN substr(path, instr(path, '/' || name || '/') + length(name) + 2) ELSE path END, '^(?:\./)+', '') AS file,
            CASE WHEN len(seg) >= 2 AND len(list_filter(seg, lambda s: NOT regexp_matches(s, '^[^\p{L}\p{N}]*[\p{L}_][\p{L}_ ]*[''"]?\s*[=:]'))) = 0
                THEN array_to_string(list_sort(list_transform(seg, lambda s: regexp_replace(lower(s), '[^\p{L}\p{N}]+', '', 'g'))), '|')
            WHEN regexp_matches(t, '^[\p{L}\s,;''"<>().\[\]-]+$')
                THEN array_to_string(list_sort(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda s: s <> '')), ' ')
            ELSE regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g') END AS canon,
            CASE WHEN regexp_matches(t, '^[^\p{L}\p{N}]*\p{L}[\p{L}''’]+(?:\s*,\s*|\s+)\p{L}[\p{L}''’]+(?:\s+\p{L}[\p{L}''’]+)?[^\p{L}\p{N}]*$') THEN 1
            WHEN regexp_matches(t, '^[^\p{L}\p{N}]*[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+[^\p{L}\p{N}]*$') THEN 2
            WHEN regexp_matches(t, '^[^\p{L}\p{N}]*\d{1,5}\p{L}?(?:\s*/\s*\d{1,5})?\s+\p{L}[\p{L}\s,;.''’-]*(?:\d{4})?[^\p{L}\p{N}]*$') THEN 3 END AS kind
        FROM base
    ), placed AS (SELECT *, regexp_replace(canon, '\D+', '', 'g') AS digits, string_split(canon, ' ') AS parts FROM keyed)
"""

#: Words of a text as ``words.flat`` sees them, for texts whose entities are the usual ones.
WORDS_SQL = r"""regexp_extract_all(lower(replace(replace(replace(replace(replace(replace(regexp_replace({}, '</?[A-Za-z][^<>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)),
    '&nbsp;', ' '), '&amp;', '&')), '[\p{{L}}\p{{N}}]+')"""

#: Words of each document without list numbers, one row per document.
LISTED_SQL = r"""SELECT doc_id, flatten(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\r\n|[\r\n\x{85}\x{2028}\x{2029}]'),
    lambda u: regexp_extract_all(lower(regexp_replace(u, '^[\s>*•|+-]*(?:\d{1,6}[.):]|[a-zA-Z][.)]|\(\d{1,6}\)|[ivxIVX]{1,6}[.)])(\s)', '\1')), '[\p{L}\p{N}]+'))) AS w FROM documents WHERE text IS NOT NULL"""

ORACLE = {
    "p6_found": PLACED
    + """SELECT DISTINCT b.finding_id FROM placed b JOIN placed a ON a.repo_url = b.repo_url AND a.file = b.file AND abs(a.line - b.line) <= 25
           AND (a.started < b.started OR (a.started = b.started AND a.finding_id < b.finding_id))
        WHERE a.canon = b.canon OR (a.kind = b.kind AND a.digits = b.digits AND CASE WHEN a.kind <> 1 THEN damerau_levenshtein(a.canon, b.canon) = 1
            ELSE len(a.parts) = len(b.parts) AND len(list_filter(range(1, len(a.parts) + 1), lambda i: len(list_filter(range(1, len(b.parts) + 1), lambda j:
                list_concat(a.parts[:i - 1], a.parts[i + 1:]) = list_concat(b.parts[:j - 1], b.parts[j + 1:]) AND damerau_levenshtein(a.parts[i], b.parts[j]) = 1)) > 0)) > 0 END)""",
    "p7_groups": CANONICAL
    + """SELECT min(finding_id) AS group_id, count(*) AS copies, count(DISTINCT f.match_text) AS spellings FROM keyed JOIN findings f USING (finding_id) GROUP BY kind, canon""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text, true AS whole FROM documents",
    "p9_found": f"""
        WITH i AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents WHERE text IS NOT NULL),
             iw AS (SELECT DISTINCT item_id, array_to_string(w[n:n + 15], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 14)) AS n FROM i WHERE len(w) >= 16)),
             dw AS (SELECT DISTINCT doc_id, array_to_string(w[n:n + 15], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 14)) AS n FROM d WHERE len(w) >= 16))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
    "p10_found": f"""
        WITH d AS ({LISTED_SQL}), s AS (SELECT doc_id, n, array_to_string(w[n:n + 7], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 6)) AS n FROM d WHERE len(w) >= 8)),
             r AS (SELECT doc_id, n FROM (SELECT doc_id, n, count(*) OVER (PARTITION BY doc_id, s) AS c FROM s) WHERE c > 1),
             p AS (SELECT doc_id, count(DISTINCT n + k) AS covered FROM (SELECT doc_id, n, unnest(range(0, 8)) AS k FROM r) GROUP BY doc_id)
        SELECT doc_id FROM d JOIN p USING (doc_id) WHERE covered >= 0.4 * len(w)""",
    "p7_found": CANONICAL
    + """, grouped AS (SELECT finding_id, min(finding_id) OVER (PARTITION BY kind, canon) AS a FROM keyed)
    SELECT a AS finding_id_a, finding_id AS finding_id_b FROM grouped WHERE a <> finding_id""",
}
