"""Queries of the general problems 1 and 2, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.operators import hot_keys, nested
from sundew.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavy keys of a shard plan for tasks of a fiftieth of the rows, of both columns."""
    return hot_keys.heavy_keys(table(spark, sf_dir, "findings"), ["file_path", "repo_url"], 0.02).select("key_kind", "key_value")


def p1_file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stored file path: rows, validated rows and span of lines."""
    findings = table(spark, sf_dir, "findings").select("file_path", "validated", "line_no")
    # map tasks combine these, so a hot path sends one row per task; shards would send them all
    return (
        findings.where(F.col("file_path").isNotNull())
        .groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("n_findings"), F.count_if("validated").alias("n_validated"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    )


def p1_repo_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per repository beside its scans: fragment-replicate join of the hot side with one row per repository."""
    findings = table(spark, sf_dir, "findings").select("repo_url", "finding_id", "line_no")
    scans = (
        table(spark, sf_dir, "scans").groupBy("repo_url").agg(F.count(F.lit(1)).alias("n_scans"), F.sum("files_scanned").alias("n_files"))
    )
    plan = hot_keys.plan_shards(findings, "repo_url")
    joined = hot_keys.fragment_replicate_join(findings, scans, "repo_url", plan)
    return joined.groupBy("repo_url").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.max("line_no").alias("last_line"),
        F.max("n_scans").alias("n_scans"),
        F.max("n_files").alias("n_files"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_items(table(spark, sf_dir, "sarif_reports"), table(spark, sf_dir, "scan_results"))


def p2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.finding_table(table(spark, sf_dir, "scan_results")).select(
        "result_id", "position", "variant", "pi_type", "match_text", "file_path", "line_no", "validated", "validation_error"
    )


def p2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.stat_table(table(spark, sf_dir, "scan_results"))


def p2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each structural variant of each SARIF node kind has."""
    nodes = nested.shred(table(spark, sf_dir, "sarif_reports"), "report_id", "body")
    return nodes.groupBy("kind", "variant").agg(F.count(F.lit(1)).alias("n_nodes"))


def p2_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of SARIF results that have a location."""
    nodes = nested.shred(table(spark, sf_dir, "sarif_reports"), "report_id", "body")
    return nested.subtype_table(nested.routed(nodes).where(F.col("subtype") == "located_result"), "result").drop("variant", "rest")


def p2_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of SARIF locations in a file."""
    nodes = nested.shred(table(spark, sf_dir, "sarif_reports"), "report_id", "body")
    return nested.subtype_table(nodes, "location", has=["+uri"]).drop("variant", "rest")


def p2_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SARIF reports say beside the typed tables, as JSON per node."""
    nodes = nested.shred(table(spark, sf_dir, "sarif_reports"), "report_id", "body", rest=True)
    return nodes.where(F.col("rest").isNotNull()).select("record_id", "kind", "positions", "rest")


QUERIES = {
    "p1_found": p1_found,
    "p1_file_results": p1_file_results,
    "p1_repo_results": p1_repo_results,
    "p2_found": p2_found,
    "p2_findings": p2_findings,
    "p2_stats": p2_stats,
    "p2_variants": p2_variants,
    "p2_results": p2_results,
    "p2_locations": p2_locations,
    "p2_rest": p2_rest,
}

#: SARIF bodies unwrapped and shredded: reports, then runs, results and locations with their positions from 0.
_STRIP = r"trim(ltrim(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), chr(65279)), ' ' || chr(9) || chr(10) || chr(13))"
_FENCE = "CASE WHEN starts_with({0}, '```') AND ends_with({0}, '```') AND length({0}) > 6 THEN CASE WHEN regexp_matches(substr({0}, 4, 1), '[\\[{{\"]') THEN substr({0}, 4, length({0}) - 6) ELSE regexp_replace(substr({0}, 4, length({0}) - 6), '^[^\\n]*\\n', '') END ELSE {0} END"


def _unwrap_sql(depth: int = 4) -> str:
    """Common table expressions w0 to w<depth>: each takes one wrapping off; ``o`` is the object once it is reached."""
    parts = ["w0 AS (SELECT report_id, body AS t, CAST(NULL AS JSON) AS o FROM sarif_reports WHERE body IS NOT NULL)"]
    for i in range(depth):
        parts.append(f"""s{i} AS (SELECT report_id, o, {_STRIP.format('t')} AS t FROM w{i}), f{i} AS (SELECT report_id, o, {_FENCE.format('t')} AS t FROM s{i}),
            j{i} AS (SELECT report_id, o, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM f{i}),
            k{i} AS (SELECT report_id, o, CASE WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN json_extract(j, '$[0]') ELSE j END AS j FROM j{i}),
            w{i + 1} AS (SELECT report_id, CASE WHEN o IS NULL AND json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') END AS t, coalesce(o, CASE WHEN json_type(j) = 'OBJECT' THEN j END) AS o FROM k{i})""")
    return ", ".join(parts)


def _children_sql(source: str, keys: str, node: str, field: str, number: str, child: str) -> str:
    """Objects under a field of a node with their positions; a bare object is its only element."""
    items = f"CASE json_type(json_extract({node}, '$.{field}')) WHEN 'ARRAY' THEN CAST(json_extract({node}, '$.{field}') AS JSON[]) WHEN 'OBJECT' THEN [json_extract({node}, '$.{field}')] ELSE [] END"
    return f"""(SELECT * FROM (SELECT {keys}, unnest(range(0, len(l))) AS {number}, unnest(l) AS {child} FROM (SELECT {keys}, {items} AS l FROM {source})) WHERE json_type({child}) = 'OBJECT')"""


SHREDDED = f"""WITH {_unwrap_sql()}, reports AS (SELECT report_id, o FROM w4 WHERE o IS NOT NULL),
    runs AS {_children_sql('reports', 'report_id', 'o', 'runs', 'run_no', 'run')},
    results AS {_children_sql('runs', 'report_id, run_no', 'run', 'results', 'result_no', 'result')},
    locations AS {_children_sql('results', 'report_id, run_no, result_no', 'result', 'locations', 'location_no', 'location')}
"""


def _path_sql(node: str, *path: str) -> str:
    """Text at a path of objects; other types as their JSON."""
    at = f"json_extract({node}, '$.{'.'.join(path)}')"
    return f"CASE WHEN json_type({at}) = 'NULL' THEN NULL WHEN json_type({at}) = 'VARCHAR' THEN json_extract_string({at}, '$') ELSE CAST({at} AS VARCHAR) END"


def _number_sql(node: str, *path: str) -> str:
    at = f"json_extract({node}, '$.{'.'.join(path)}')"
    return f"CASE WHEN json_type({at}) IN ('UBIGINT', 'BIGINT') THEN CAST({at} AS BIGINT) END"


def _variant_sql(kind: str, node: str) -> str:
    """The variant of a node by the grammar: the shape of each field, then the scalars that it has."""
    fields, scalars = nested.SARIF_GRAMMAR[kind]
    parts = []
    for name in fields:
        j = f"json_extract({node}, '$.{name}')"
        some = f"len(list_filter(CAST({j} AS JSON[]), lambda x: json_type(x) = 'OBJECT')) > 0"
        parts.append(
            f"'{name}:' || CASE WHEN {j} IS NULL THEN 'absent' ELSE CASE json_type({j}) WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN "
            f"CASE WHEN json_array_length({j}) = 0 THEN 'empty' WHEN {some} THEN 'array' ELSE 'hollow' END ELSE 'other' END END"
        )
    for name, path in scalars.items():
        t = f"json_type(json_extract({node}, '$.{'.'.join(path)}'))"
        has = f"{t} IN ('UBIGINT', 'BIGINT')" if name in nested.NUMBERS else f"{t} = 'BOOLEAN'" if name in nested.FLAGS else f"{t} <> 'NULL'"
        parts.append(f"CASE WHEN {has} THEN '+{name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


_NODES = {"report": ("reports", "o"), "run": ("runs", "run"), "result": ("results", "result"), "location": ("locations", "location"), "invocation": ("invocations", "invocation"), "fix": ("fixes", "fix")}
_URI = _path_sql("location", "physicalLocation", "artifactLocation", "uri")


ORACLE = {
    "p2_found": SHREDDED
    + f"""SELECT 'result' AS record_kind, report_id AS record_id, CAST(run_no AS INT) AS parent_no, CAST(result_no AS INT) AS child_no, CAST(location_no AS INT) AS leaf_no, coalesce({_URI}, '') AS item_key FROM locations
        UNION ALL SELECT 'result', report_id, run_no, result_no, -1, '' FROM results ANTI JOIN locations USING (report_id, run_no, result_no)
        UNION ALL SELECT 'finding', result_id, -1, i - 1, -1, coalesce(findings[i].pi_type, '') FROM (SELECT result_id, findings, unnest(range(1, len(findings) + 1)) AS i FROM scan_results) WHERE findings[i] IS NOT NULL
        UNION ALL SELECT 'stat', result_id, -1, -1, -1, unnest(map_keys(stats.findings_by_type)) FROM scan_results""",
    "p2_variants": SHREDDED
    + f""", invocations AS {_children_sql('runs', 'report_id, run_no', 'run', 'invocations', 'n', 'invocation')}, fixes AS {_children_sql('results', 'report_id, run_no, result_no', 'result', 'fixes', 'n', 'fix')}
        SELECT kind, variant, count(*) AS n_nodes FROM ({' UNION ALL '.join(f"SELECT '{k}' AS kind, {_variant_sql(k, node)} AS variant FROM {source}" for k, (source, node) in _NODES.items())}) GROUP BY ALL""",
    "p2_results": SHREDDED
    + f"""SELECT report_id AS record_id, CAST(run_no AS INT) AS run_no, CAST(result_no AS INT) AS result_no, {_path_sql('result', 'ruleId')} AS rule, {_path_sql('result', 'level')} AS level,
        {_path_sql('result', 'message', 'text')} AS message FROM results SEMI JOIN locations USING (report_id, run_no, result_no)""",
    "p2_locations": SHREDDED
    + f"""SELECT report_id AS record_id, CAST(run_no AS INT) AS run_no, CAST(result_no AS INT) AS result_no, CAST(location_no AS INT) AS location_no, {_URI} AS uri,
        {_number_sql('location', 'physicalLocation', 'region', 'startLine')} AS line, {_number_sql('location', 'physicalLocation', 'region', 'startColumn')} AS "column",
        {_path_sql('location', 'logicalLocation', 'name')} AS logical FROM locations WHERE {_URI} IS NOT NULL""",
    "p1_found": """
        WITH t AS (SELECT count(*) AS total FROM findings)
        SELECT 'file_path' AS key_kind, file_path AS key_value FROM findings, t WHERE file_path IS NOT NULL
        GROUP BY file_path, total HAVING count(*) >= 0.02 * total
        UNION ALL
        SELECT 'repo_url', repo_url FROM findings, t WHERE repo_url IS NOT NULL
        GROUP BY repo_url, total HAVING count(*) >= 0.02 * total""",
    "p1_file_results": """
        SELECT file_path, count(*) AS n_findings, count(*) FILTER (WHERE validated) AS n_validated,
               min(line_no) AS first_line, max(line_no) AS last_line
        FROM findings WHERE file_path IS NOT NULL GROUP BY file_path""",
    "p1_repo_results": """
        WITH s AS (SELECT repo_url, count(*) AS n_scans, CAST(sum(files_scanned) AS BIGINT) AS n_files FROM scans GROUP BY 1)
        SELECT f.repo_url, count(*) AS n_findings, max(line_no) AS last_line, max(n_scans) AS n_scans, max(n_files) AS n_files
        FROM findings f JOIN s ON f.repo_url = s.repo_url GROUP BY f.repo_url""",
    "p2_findings": """
        SELECT result_id, CAST(i - 1 AS INT) AS position,
               CASE WHEN f.validation IS NULL THEN 'plain' WHEN f.validation.validation_error IS NOT NULL THEN 'failed'
                    ELSE 'validated' END AS variant,
               f.pi_type AS pi_type, f.match_text AS match_text, f.file_path AS file_path, f.line_no AS line_no,
               f.validation.validated AS validated, f.validation.validation_error AS validation_error
        FROM (SELECT result_id, i, findings[i] AS f
              FROM (SELECT result_id, findings, unnest(range(1, len(findings) + 1)) AS i FROM scan_results))
        WHERE f IS NOT NULL""",
    "p2_stats": """
        SELECT result_id, 'findings_by_type' AS map_name, e.key AS entry_key, e.value AS entry_count
        FROM (SELECT result_id, unnest(map_entries(stats.findings_by_type)) AS e FROM scan_results)
        UNION ALL
        SELECT result_id, 'findings_by_risk', e.key, e.value
        FROM (SELECT result_id, unnest(map_entries(stats.findings_by_risk)) AS e FROM scan_results)""",
}
