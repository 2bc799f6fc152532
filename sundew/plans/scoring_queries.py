"""Queries of the scores over the stored findings, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.operators import pairs
from sundew.plans import scoring
from sundew.plans.engine_queries import _KIND, kind_column, quoted
from sundew.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def scored_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings with the signals of a score: their confidence as the score of their context, their own checks."""
    t = table(spark, sf_dir, "findings")
    return t.select(
        "finding_id",
        kind_column().alias("kind"),
        F.col("match_text").alias("value"),
        F.coalesce("file_path", F.lit("")).alias("file"),
        F.coalesce("context", F.lit("")).alias("content"),
        F.col("confidence").alias("proximity_score"),
        F.when(F.col("context_modifier") <= 0.1, "test").otherwise("production").alias("proximity_context"),
        F.lit(None).cast("double").alias("ml_confidence"),
        F.lit(None).cast("boolean").alias("ml_valid"),
        F.col("validated").alias("check_valid"),
        F.lit(0.95).alias("check_confidence"),
        F.lit(None).cast("double").alias("co_occurrence"),
    )


def _case(key: str, table: dict, default: str) -> str:
    return f"CASE {' '.join(f'WHEN {key} = {quoted(k)} THEN {v}::DOUBLE' for k, v in table.items())} ELSE {default} END"


_SIGNS = ", ".join(
    [f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN '{n}' END" for n, p in scoring.ENVIRONMENT_SIGNS.items()]
    + [f"CASE WHEN contains(lower(content), '{w}') THEN '{n}' END" for w, n in scoring.CONTENT_SIGNS.items()]
)
_ENVIRONMENT = " * ".join(f"CASE WHEN list_contains(signs, '{n}') THEN {v}::DOUBLE ELSE 1 END" for n, v in scoring.ENVIRONMENT.items())


def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.score(scored_inputs(spark, sf_dir))
    rounded = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("proximity_factor", "validation_factor", "environment_factor", "type_weight", "score")]
    return s.select("finding_id", *rounded, "level", F.size("adjustments").alias("n_adjustments"), "error")


QUERIES["confidence_scores"] = confidence_scores
ORACLE["confidence_scores"] = f"""
    WITH i AS (SELECT finding_id, {_KIND} AS kind, match_text AS value, coalesce(file_path, '') AS file, coalesce(context, '') AS content, coalesce(file_path, '') || ' ' || coalesce(context, '') AS t,
                      CASE WHEN confidence IS NULL THEN 0.5::DOUBLE ELSE least(greatest(confidence * CASE WHEN context_modifier <= 0.1 THEN 0.2::DOUBLE ELSE 1 END, 0), 1) END AS p, CASE WHEN validated THEN 0.95::DOUBLE ELSE 0 END AS v FROM findings),
         s AS (SELECT *, [{_SIGNS}] AS signs, {_case('kind', scoring.TYPE_WEIGHTS, '0.5::DOUBLE')} AS w,
                      CASE WHEN coalesce(kind, '') = '' THEN 'finding type is required' WHEN coalesce(value, '') = '' THEN 'finding match is required'
                           WHEN kind NOT IN ({', '.join(map(quoted, scoring.SCORED_TYPES))}) THEN 'unsupported PI type: ' || kind END AS error FROM i),
         e AS (SELECT *, least(greatest({_ENVIRONMENT}, 0), 2) AS env FROM s),
         f AS (SELECT *, CASE WHEN error IS NULL THEN least(greatest((p * 0.4::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE + v * 0.3::DOUBLE) * w * env, 0), 1) END AS score FROM e)
    SELECT finding_id, round(p + 1e-9, 6) AS proximity_factor, round(v + 1e-9, 6) AS validation_factor, round(env + 1e-9, 6) AS environment_factor, round(w + 1e-9, 6) AS type_weight, round(score + 1e-9, 6) AS score,
           CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' END AS level,
           CAST((env <> 1)::INT + (w < 1)::INT + (v = 0)::INT AS INT) AS n_adjustments, error FROM f"""


def co_occurrence_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings")
    file = F.when(F.col("file_path").isNotNull(), F.concat(F.coalesce("repo_url", F.lit("")), F.lit(":"), "file_path"))
    near = pairs.co_occurrences(t.select(file.alias("file"), kind_column().alias("kind"), "line_no"), "file", "kind", "line_no", 10)
    return scoring.co_occurrence_factors(near).withColumn("factor", F.round("factor", 6))


_BOOST = " ".join(f"WHEN a.kind = '{k}' AND b.kind = '{o}' THEN {v}::DOUBLE" for k, row in scoring.CO_OCCURRENCE.items() for o, v in row.items())
QUERIES["co_occurrence_factors"] = co_occurrence_factors
ORACLE["co_occurrence_factors"] = f"""
    WITH f AS (SELECT DISTINCT coalesce(repo_url, '') || ':' || file_path AS file, {_KIND} AS kind, line_no AS line FROM findings WHERE file_path IS NOT NULL AND pi_type IS NOT NULL AND line_no IS NOT NULL),
         p AS (SELECT a.file, a.kind, a.line, b.kind AS other, min(abs(a.line - b.line)) AS d, any_value(CASE {_BOOST} ELSE 1 END) AS boost
               FROM f a JOIN f b ON a.file = b.file AND a.kind <> b.kind AND abs(a.line - b.line) <= 10 GROUP BY ALL)
    SELECT file, kind, CAST(line AS BIGINT) AS line, round(least(product(1 + (boost - 1) * pow(0.9::DOUBLE, greatest(d - 1, 0))), 1.6::DOUBLE), 6) AS factor FROM p GROUP BY ALL"""


def risk_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with invented but fixed surroundings, so that every branch of the risk model is taken."""
    i, c = F.col("finding_id"), F.col
    t = table(spark, sf_dir, "findings").where(F.col("match_text").isNotNull() & F.col("file_path").isNotNull())
    pick = lambda n, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(i / n) % len(options) + 1).cast("int"))
    return t.select(
        "finding_id", kind_column().alias("kind"), c("match_text").alias("value"), c("file_path").alias("file"), "context", F.coalesce("validated", F.lit(False)).alias("validated"),
        (i % 2 == 0).alias("is_public"), (i % 7 * 300).cast("int").alias("stars"), (i % 5 * 60).cast("int").alias("forks"), (i % 9 * 8).cast("int").alias("contributors"),
        c("detected_at").alias("last_commit"), pick(3, "main", "dev").alias("default_branch"), (i % 3 == 0).alias("has_cicd"), (i % 11 * 150000).alias("file_size"),
        (i % 4 == 1).alias("is_production"), (i % 6 == 5).alias("is_test_file"), (i % 5 == 2).alias("is_configuration"), (i % 5 != 2).alias("is_source"),
        pick(2, "banking", "retail", "technology", "mining").alias("industry"), pick(5, "large", "medium", "small").alias("org_size"), (i % 8 < 3).alias("regulated"),
        (i % 10 < 4).alias("has_security_team"), pick(4, "high", "medium", "low").alias("maturity"), (i % 6).cast("int").alias("incidents"), F.lit(None).cast("timestamp").alias("last_incident"),
        F.when(i % 4 == 0, F.array(F.lit("BSB"), F.lit("NAME"), F.lit("EMAIL"))).alias("co_types"),
    )


NOW = "2026-07-01 00:00:00"


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.risk(risk_inputs(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return r.select("finding_id", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("impact", "likelihood", "exposure", "risk")], "affected", "risk_level", "category")


def _in(types: tuple[str, ...]) -> str:
    return f"kind IN ({', '.join(map(quoted, types))})"


def _any(words: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {quoted(w)})" for w in words) + ")"


def _if(condition: str, value: object, other: object) -> str:
    return f"(CASE WHEN {condition} THEN {value} ELSE {other} END)::DOUBLE"


def _pick(n: int, *options: str) -> str:
    return f"[{', '.join(map(quoted, options))}][(finding_id // {n}) % {len(options)} + 1]"


QUERIES["risk_scores"] = risk_scores
ORACLE["risk_scores"] = f"""
    WITH a AS (SELECT finding_id, finding_id AS i, {_KIND} AS kind, match_text AS value, file_path AS file, context, coalesce(validated, false) AS validated, finding_id % 2 = 0 AS pub, finding_id % 7 * 300 AS stars,
            finding_id % 5 * 60 AS forks, finding_id % 9 * 8 AS people, detected_at AS last_commit, {_pick(3, 'main', 'dev')} AS branch, finding_id % 3 = 0 AS cicd, finding_id % 11 * 150000 AS size,
            finding_id % 4 = 1 AS prod, finding_id % 6 = 5 AS test, finding_id % 5 = 2 AS conf, {_pick(2, 'banking', 'retail', 'technology', 'mining')} AS industry, {_pick(5, 'large', 'medium', 'small')} AS org,
            finding_id % 8 < 3 AS reg, finding_id % 10 < 4 AS team, {_pick(4, 'high', 'medium', 'low')} AS maturity, finding_id % 6 AS incidents, CASE WHEN finding_id % 4 = 0 THEN 3 ELSE 0 END AS others
            FROM findings WHERE match_text IS NOT NULL AND file_path IS NOT NULL),
    b AS (SELECT *, CASE WHEN size > 1048576 THEN 100 WHEN conf THEN 10 ELSE 1 END * greatest(others, 1) AS records FROM a),
    c AS (SELECT *, CAST(CASE WHEN prod THEN floor((CASE WHEN test THEN 0 ELSE records END) * 1.5) ELSE CASE WHEN test THEN 0 ELSE records END END * CASE WHEN pub THEN least(1 + forks // 100, 10) ELSE 1 END AS BIGINT) AS affected,
            least({_case('kind', scoring.FINANCIAL, '0.3::DOUBLE')} * CASE WHEN records > 1000 THEN 2.0 WHEN records > 100 THEN 1.5 WHEN records > 10 THEN 1.2 ELSE 1 END::DOUBLE, 1) AS financial,
            least(greatest({_if('reg', 0.8, 0.5)}, {_if(_in(scoring.FINANCIAL_TYPES), 0.9, 0)}, {_if(_in(scoring.IDENTITY_TYPES), 0.85, 0)}) * {_case('industry', scoring.INDUSTRIES, '1::DOUBLE')}, 1) AS regulatory,
            least(0.5::DOUBLE * {_if('pub', 1.3, 1)} * {_if('stars > 100', 1.2, 1)} * {_if('stars > 1000', 1.5, 1)} * {_if('incidents > 0', '1 + 0.1::DOUBLE * incidents', 1)} * {_if(_in(scoring.HIGH_VALUE), 1.3, 1)}, 1) AS reputational FROM b),
    d AS (SELECT *, least({_case('kind', scoring.SENSITIVITY, '0.5::DOUBLE')} * 0.25 + financial * 0.25 + regulatory * 0.25 + reputational * 0.15::DOUBLE
              + CASE WHEN affected <= 0 THEN 0 WHEN affected <= 10 THEN 0.3 WHEN affected <= 100 THEN 0.6 WHEN affected <= 1000 THEN 0.8 ELSE 1 END::DOUBLE * 0.1::DOUBLE, 1) AS impact,
            least(least(greatest(1 - (0.5::DOUBLE + {_if('pub', -0.3, 0)} + {_if('test', 0.3, 0)} + {_if('conf', -0.2, 0)} + {_if('NOT conf', 0.1, 0)} + {_if(_any(scoring.KNOWN_PATHS, 'file'), -0.1, 0)}
                + {_if('validated', -0.2, 0)} + {_if('others > 2', -0.1, 0)}), 0), 1)
              * (0.5 + 0.5 * least(0.5::DOUBLE + {_if(_in(scoring.HIGH_VALUE), 0.2, 0)} + {_if('stars > 1000', 0.1, 0)} + {_if('reg', 0.2, 0)}, 1))
              * {_if('pub', 1.5, 1)} * {_if('NOT pub AND team', 0.7, 1)} * {_if('pub', 1.3, 1)} * {_if('NOT pub AND NOT cicd AND reg', 0.6, 1)} * {_if('incidents > 0', 'least(1 + 0.15::DOUBLE * incidents, 2)', 1)}
              * {_if(f"last_commit < TIMESTAMPTZ '{NOW}+00' - INTERVAL 365 DAY", 1.2, 1)} * {_if('prod', 1.5, 1)} * {_if(_any(scoring.SENSITIVE_PATHS, 'file'), 1.2, 1)}, 1) AS likelihood,
            coalesce(floor((epoch(TIMESTAMPTZ '{NOW}+00') - floor(epoch(last_commit))) / 86400), 0) AS days,
            CASE WHEN {_any(scoring.ENCRYPTION_WORDS, 'context')} THEN 0.3 WHEN length(value) >= 20 AND value LIKE '%=' THEN 0.6 WHEN validated THEN 1.2 ELSE 1 END::DOUBLE AS enc,
            CASE WHEN pub THEN CASE WHEN stars > 1000 THEN 1.5 WHEN stars > 100 THEN 1.3 ELSE 1.1 END ELSE CASE org WHEN 'large' THEN 0.8 WHEN 'medium' THEN 0.6 ELSE 0.4 END END::DOUBLE AS vis FROM c),
    e AS (SELECT *, least(least(({_if('pub', 0.9, 0.5)} + {_if("branch = 'main'", 0.1, 0)} + {_if(_any(scoring.COMMON_PATHS, 'file'), 0.05, 0)} + {_if('size > 102400', 0.05, 0)}) * {_if('test', 0.5, 1)}, 1) * vis
              * CASE WHEN days > 180 THEN 1.3 WHEN days > 90 THEN 1.2 WHEN days > 30 THEN 1.1 ELSE 1 END::DOUBLE * enc
              * (1 - 0.5 * {_if('pub', 0.1, f"least(0.5::DOUBLE + {_if('team', 0.2, 0)} + {_if('reg', 0.2, 0)} + {_if('cicd', 0.1, 0)} + CASE maturity WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.1 ELSE -0.1 END::DOUBLE, 1)")})
              * {_if(_in(scoring.HIGH_VALUE), 1.2, 1)} * {_if('people > 10', 1.1, 1)} * {_if('people > 50', 1.2, 1)} * {_if('forks > 10', 1.1, 1)} * {_if('forks > 100', 1.3, 1)}, 1) AS exposure FROM d),
    f AS (SELECT *, least(impact * likelihood * exposure, 1) AS risk FROM e)
    SELECT finding_id, round(impact + 1e-9, 5) AS impact, round(likelihood + 1e-9, 5) AS likelihood, round(exposure + 1e-9, 5) AS exposure, round(risk + 1e-9, 5) AS risk, affected,
        CASE WHEN risk >= 0.8 THEN 'CRITICAL' WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
        CASE WHEN {_in(scoring.FINANCIAL_TYPES)} AND (others > 0 OR financial > 0.7) THEN 'FINANCIAL_FRAUD' WHEN {_in(scoring.IDENTITY_TYPES)} AND (others > 0 OR pub) THEN 'IDENTITY_THEFT' WHEN test THEN 'OPERATIONAL'
             WHEN reg AND regulatory > 0.6 THEN 'REGULATORY_BREACH' WHEN affected > 100 THEN 'PRIVACY_BREACH' ELSE 'OPERATIONAL' END AS category FROM f"""
