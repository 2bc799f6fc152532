"""Queries of evaluation reports, score trails, keyword extraction and report parts, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.functions import patterns, proximity
from sundew.operators import context, detect, evaluate
from sundew.plans import scoring
from sundew.plans.engine_queries import _ACTUAL, _COUNTS, _KIND, _LANGUAGE_CASE, _RATES, _SEEN, judged, kind_column, quoted, reported
from sundew.plans.scoring_queries import scored_inputs
from sundew.session import table
from sundew.sinks import reports

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# Keywords of contexts -----------------------------------------------------------------------------------------------

_W = r"list_filter(regexp_split_to_array(context, '[ \t\n\f\r]+'), lambda w: w <> '')"
_IN = lambda ws: "[" + ", ".join(map(quoted, ws)) + "]"
KEYWORD_SQL = {
    "database": f"""list_concat(list_filter(list_transform(w, lambda x: upper(trim(x, '(),''"'))), lambda x: list_contains({_IN(proximity.SQL_WORDS)}, x)),
        list_filter(list_transform(w, lambda x: lower(x)), lambda x: {' OR '.join(f"contains(x, '{n}')" for n in proximity.SQL_NAMES)}))""",
    "log": f"list_filter(list_transform(w, lambda x: upper(trim(x, ':'))), lambda x: list_contains({_IN(proximity.LOG_LEVELS)}, x))",
    "config": "list_filter(list_transform(list_filter(w, lambda x: contains(x, '=')), lambda x: split_part(x, '=', 1)), lambda x: x <> '')",
    "variable": f"""list_concat(list_transform(list_filter(w, lambda x: list_contains({_IN(proximity.DECLARATIONS)}, lower(x))), lambda x: lower(x)),
        list_filter(list_transform(list_filter(range(1, len(w)), lambda i: list_contains({_IN(proximity.DECLARATIONS)}, lower(w[i]))), lambda i: trim(w[i + 1], '=')), lambda x: x <> ''))""",
    "documentation": "list_filter(list_transform(w, lambda x: trim(x, '/*-#')), lambda x: strlen(x) > 2)",
    "form": "list_filter([" + ", ".join(f"CASE WHEN contains(lower(context), '{w}') THEN '{w}' END" for w in proximity.FORM_WORDS)
    + ", " + ", ".join(f"CASE WHEN contains(context, chr(123)) AND contains(context, chr(125)) THEN '{w}' END" for w in ("json", "structured")) + "], lambda x: x IS NOT NULL)",
}


@query(
    "context_keywords",
    f"""SELECT finding_id, {', '.join(f"array_to_string(list_sort(list_distinct({e})), '|') AS {k}_words" for k, e in KEYWORD_SQL.items())}
        FROM (SELECT finding_id, context, {_W} AS w FROM findings WHERE context IS NOT NULL)""",
)
def context_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("context").isNotNull())
    return t.select("finding_id", *[F.array_join(proximity.keywords_of_type(F.col("context"), k), "|").alias(f"{k}_words") for k in KEYWORD_SQL])


# Evaluation ---------------------------------------------------------------------------------------------------------


@query(
    "dataset_stats",
    """SELECT 'all' AS dimension, 'all' AS member, count(*) AS n FROM eval_items UNION ALL SELECT 'suite', suite, count(*) FROM eval_items GROUP BY suite
       UNION ALL SELECT 'pi_type', pi_type, count(*) FROM eval_items GROUP BY pi_type UNION ALL SELECT 'is_actual_pi', CAST(is_actual_pi AS VARCHAR), count(*) FROM eval_items GROUP BY is_actual_pi""",
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dataset_stats(table(spark, sf_dir, "eval_items"), "suite", "pi_type", "is_actual_pi")


@query("selected_cases", "SELECT item_id, suite FROM eval_items WHERE pi_type IN ('TFN', 'ABN') AND is_actual_pi")
def selected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_cases(table(spark, sf_dir, "eval_items"), pi_type=["TFN", "ABN"], is_actual_pi=True).select("item_id", "suite")


_R9 = lambda *c: ", ".join(f"round({x}, 9) AS {x}" for x in c)


@query(
    "quality_by_language",
    f"""SELECT language, tp, fp, fn, {_R9('precision', 'recall', 'f1')} FROM (SELECT * {_RATES} FROM (SELECT CASE {_LANGUAGE_CASE} ELSE 'unknown' END AS language, {_COUNTS}
        FROM (SELECT *, lower(regexp_extract(file_path, '\\.([^./]*)$', 1)) AS e FROM findings WHERE file_path IS NOT NULL) GROUP BY 1))""",
)
def quality_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").where(F.col("file_path").isNotNull())
    cases = t.select(
        F.coalesce("validated", F.lit(False)).alias("actual"), (F.coalesce("confidence", F.lit(0.0)) >= 0.5).alias("seen"), context.language(F.col("file_path")).alias("language")
    )
    rates = evaluate.evaluate(cases, "actual", "seen", "language")
    return rates.select("language", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "quality_assessment",
    f"""SELECT kind, round((f1 * 0.5::DOUBLE + precision * 0.3::DOUBLE + recall * 0.2::DOUBLE) * 100, 6) AS score,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {c} >= {least}::DOUBLE THEN '{n}' END" for c, (n, least, _, _) in evaluate.JUDGED.items())}], lambda x: x IS NOT NULL), '|') AS strengths,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {c} <= {most}::DOUBLE THEN '{n}' END" for c, (_, _, n, most) in evaluate.JUDGED.items())}], lambda x: x IS NOT NULL), '|') AS weaknesses,
        CASE WHEN precision > recall + 0.15::DOUBLE THEN 'recall' WHEN recall > precision + 0.15::DOUBLE THEN 'precision' WHEN f1 < 0.7::DOUBLE THEN 'both' ELSE 'edge cases' END AS tune
        FROM (SELECT * {_RATES} FROM (SELECT {_KIND} AS kind, {_COUNTS} FROM findings GROUP BY 1))""",
)
def quality_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = evaluate.assessment(evaluate.evaluate(judged(spark, sf_dir), "actual", "seen", "kind"))
    return a.select("kind", F.round("grade_score", 6).alias("score"), F.array_join("strengths", "|").alias("strengths"), F.array_join("weaknesses", "|").alias("weaknesses"), "tune")


@query(
    "context_accuracy",
    """SELECT samples, "right", round("right" / nullif(samples, 0)::DOUBLE, 9) AS accuracy FROM (SELECT count(*) AS samples,
        count(*) FILTER (WHERE CASE WHEN c = 'test' THEN n = 0 ELSE n > 0 END) AS "right"
        FROM (SELECT finding_id, CASE WHEN context_modifier <= 0.1 THEN 'test' ELSE 'production' END AS c, CASE WHEN validated THEN 1 ELSE 0 END AS n FROM findings))""",
)
def context_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings")
    samples = t.select(F.when(F.col("context_modifier") <= 0.1, "test").otherwise("production").alias("c"), F.when(F.col("validated"), 1).otherwise(0).alias("n"))
    return evaluate.context_accuracy(samples, "c", "n").withColumn("accuracy", F.round("accuracy", 9))


_SIZE_CLASS = "CASE WHEN total_files < 100 THEN 'low' WHEN total_files < 1000 THEN 'medium' ELSE 'high' END"


@query(
    "by_complexity",
    f"""SELECT complexity, count(*) AS samples, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(s), 6) AS mean_seconds,
        round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp) + sum(fn), 0)::DOUBLE, 0), 9) AS accuracy
        FROM (SELECT {_SIZE_CLASS} AS complexity, duration_ns / 1000000000.0::DOUBLE AS s, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM scans LEFT JOIN
              (SELECT scan_id, count(*) FILTER (WHERE {_ACTUAL} AND {_SEEN}) AS tp, count(*) FILTER (WHERE NOT {_ACTUAL} AND {_SEEN}) AS fp, count(*) FILTER (WHERE {_ACTUAL} AND NOT {_SEEN}) AS fn
               FROM findings GROUP BY scan_id) USING (scan_id)) GROUP BY complexity""",
)
def by_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans as samples, their complexity by their number of files, their outcome by their findings."""
    a, d = F.coalesce("validated", F.lit(False)), F.coalesce("confidence", F.lit(0.0)) >= 0.5
    counts = table(spark, sf_dir, "findings").groupBy("scan_id").agg(F.count_if(a & d).alias("tp"), F.count_if(~a & d).alias("fp"), F.count_if(a & ~d).alias("fn"))
    n = F.col("total_files")
    scans = table(spark, sf_dir, "scans").select("scan_id", F.when(n < 100, "low").when(n < 1000, "medium").otherwise("high").alias("complexity"), (F.col("duration_ns") / 1e9).alias("s"))
    samples = scans.join(counts, "scan_id", "left").fillna(0, ["tp", "fp", "fn"])
    return evaluate.by_complexity(samples, "complexity", "s").withColumns({"mean_seconds": F.round("mean_seconds", 6), "accuracy": F.round("accuracy", 9)})


@query(
    "scan_throughput",
    """SELECT scan_id, round(coalesce(files_scanned / nullif(duration_ns / 1000000000.0::DOUBLE, 0), 0), 6) AS per_second FROM scans""",
)
def scan_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "scans").select("scan_id", "files_scanned", (F.col("duration_ns") / 1e9).alias("s"))
    return evaluate.throughput(t, "files_scanned", "s").select("scan_id", F.round("per_second", 6).alias("per_second"))


@query(
    "business_rates",
    f"""SELECT kind, round(a, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall, round((a + coalesce(2 * p * r / nullif(p + r, 0), 0)) / 2, 9) AS overall FROM (
        SELECT kind, coalesce(tp / nullif(tp + fp + fn, 0)::DOUBLE, 0) AS a, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r
        FROM (SELECT {_KIND} AS kind, {_COUNTS} FROM findings GROUP BY 1))""",
)
def business_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = evaluate.business_rates(evaluate.evaluate(judged(spark, sf_dir), "actual", "seen", "kind").select("kind", "tp", "fp", "fn"))
    return b.select("kind", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "overall")])


@query(
    "precision_by_type",
    f"""WITH e AS (SELECT DISTINCT {_KIND} AS kind, match_text FROM findings WHERE validated), f AS (SELECT {_KIND} AS kind, match_text, avg(confidence) AS c FROM findings WHERE confidence >= 0.5 GROUP BY ALL),
             b AS (SELECT coalesce(e.kind, f.kind) AS kind, e.r AS er, f.r AS fr, f.c AS c FROM (SELECT *, 1 AS r FROM e) e
                   FULL JOIN (SELECT *, 1 AS r FROM f) f ON e.kind IS NOT DISTINCT FROM f.kind AND e.match_text IS NOT DISTINCT FROM f.match_text)
        SELECT kind, count(er) AS expected, count(fr) AS found, count(*) FILTER (WHERE er IS NOT NULL AND fr IS NOT NULL) AS "right",
               round(avg(c) FILTER (WHERE er IS NOT NULL AND fr IS NOT NULL), 6) AS mean_confidence,
               round(coalesce(count(*) FILTER (WHERE er IS NOT NULL AND fr IS NOT NULL) / nullif(count(er), 0)::DOUBLE, 0), 9) AS detection_rate,
               round(coalesce(count(*) FILTER (WHERE er IS NOT NULL AND fr IS NOT NULL) / nullif(count(fr), 0)::DOUBLE, 0), 9) AS precision FROM b GROUP BY kind""",
)
def precision_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "findings").withColumn("kind", kind_column())
    out = evaluate.detection_by_type(t.where("validated"), t.where("confidence >= 0.5"), "kind", ["kind", "match_text"], "confidence")
    return out.withColumns({"mean_confidence": F.round("mean_confidence", 6), "detection_rate": F.round("detection_rate", 9), "precision": F.round("precision", 9)})


_BASE = f"(SELECT detector_name, {_KIND} AS kind, risk_level, validated, confidence FROM findings WHERE detector_name IS NOT NULL)"
_SETS = [("all", "'all'"), ("kind", "kind"), ("risk_level", "risk_level")]
_NAMES = ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "specificity", "accuracy")
_SCORE = "(f1 * 0.5::DOUBLE + precision * 0.3::DOUBLE + recall * 0.2::DOUBLE)"


@query(
    "detailed_report",
    f"""WITH r AS (SELECT * {_RATES} FROM ({' UNION ALL '.join(f"SELECT detector_name, '{d}' AS dimension, {m} AS member, {_COUNTS} FROM {_BASE} GROUP BY ALL" for d, m in _SETS)})),
             w AS (SELECT * FROM r WHERE dimension = 'all'),
             l AS (SELECT detector_name, unnest(['precision', 'recall', 'f1', 'accuracy']) AS metric, unnest([precision, recall, f1, accuracy]) AS value FROM w)
        SELECT section, detector, dimension, member, metric, round(value, 6) AS value, label FROM (
            {' UNION ALL '.join(f"SELECT 'dataset' AS section, NULL AS detector, '{d}' AS dimension, {m} AS member, 'n' AS metric, count(*)::DOUBLE AS value, NULL AS label FROM {_BASE} GROUP BY ALL" for d, m in _SETS)}
            UNION ALL SELECT 'rates', detector_name, dimension, member, unnest([{', '.join(map(quoted, _NAMES))}]), unnest([{', '.join(f'{n}::DOUBLE' for n in _NAMES)}]), NULL FROM r
            UNION ALL SELECT 'best', detector_name, NULL, NULL, metric, value, NULL FROM (SELECT * FROM l WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, detector_name) = 1)
            UNION ALL SELECT 'grade', detector_name, NULL, NULL, 'score', {_SCORE} * 100,
                CASE WHEN {_SCORE} >= 0.9 THEN 'A' WHEN {_SCORE} >= 0.8 THEN 'B' WHEN {_SCORE} >= 0.7 THEN 'C' WHEN {_SCORE} >= 0.6 THEN 'D' ELSE 'F' END FROM w)""",
)
def detailed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.detailed_report(judged(spark, sf_dir), "actual", "seen", "detector_name", "kind", "risk_level").withColumn("value", F.round("value", 6))


# Score trails -------------------------------------------------------------------------------------------------------


def _scored_sql() -> str:
    from sundew.plans import scoring_queries

    return scoring_queries.ORACLE["confidence_scores"].rsplit("SELECT finding_id, round(p", 1)[0]


_PARTS = {"proximity": ("p", 0.4), "ml_validation": ("0.5::DOUBLE", 0.3), "algorithmic_validation": ("v", 0.3), "environment": ("env", 1.0), "co_occurrence": ("1.0::DOUBLE", 1.0), "pi_type_weight": ("w", 1.0)}


@query(
    "score_breakdowns",
    _scored_sql() + f"""SELECT finding_id, unnest([{', '.join(map(quoted, _PARTS))}]) AS name, round(unnest([{', '.join(f'({e})::DOUBLE' for e, _ in _PARTS.values())}]) + 1e-9, 6) AS score,
        unnest([{', '.join(f'{w}::DOUBLE' for _, w in _PARTS.values())}]) AS weight FROM f""",
)
def score_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.score(scored_inputs(spark, sf_dir)).select("finding_id", scoring.breakdown().alias("b"))
    return s.select("finding_id", F.explode("b.components").alias("c")).select("finding_id", "c.name", F.round(F.col("c.score") + 1e-9, 6).alias("score"), "c.weight")


@query(
    "audit_trails",
    _scored_sql() + """SELECT finding_id, n AS position, ['proximity', 'ml_validation', 'algorithmic_validation', 'environment_analysis', 'co_occurrence_analysis', 'aggregation'][n] AS component,
        TIMESTAMP '2026-01-01 00:00:00' + INTERVAL (n - 1) MILLISECOND AS at, round([p, 0.5::DOUBLE, v, env, 1.0::DOUBLE, score][n] + 1e-9, 6) AS score,
        CASE WHEN n <= 3 THEN ['0.40', '0.30', '0.30'][n] WHEN n = 4 THEN CASE WHEN env < 1 THEN 'reduced' WHEN env > 1 THEN 'increased' ELSE 'neutral' END WHEN n = 5 THEN 'neutral'
             ELSE CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' ELSE '' END END AS detail
        FROM (SELECT *, unnest(CAST(range(1, 7) AS INT[])) AS n FROM f)""",
)
def audit_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = scoring.audit_trail(F.lit("2026-01-01 00:00:00").cast("timestamp"))
    s = scoring.score(scored_inputs(spark, sf_dir)).select("finding_id", F.posexplode(trail).alias("i", "e"))
    d = F.col("e.details")
    detail = F.coalesce(d["weight"], F.when(d["multiplier"].isNotNull(), d["impact"]), d["risk_level"])
    return s.select("finding_id", (F.col("i") + 1).alias("position"), "e.component", F.col("e.timestamp").alias("at"), F.round(F.col("e.score") + 1e-9, 6).alias("score"), detail.alias("detail"))


# Parts of reports ---------------------------------------------------------------------------------------------------

_TYPE = r"coalesce(nullif(lower(regexp_extract(file, '\.([^./\\]*)$', 1)), ''), 'none')"
_ENV = r"CASE WHEN regexp_matches(lower(file), 'mock|stub|fake') THEN 'mock' WHEN test OR regexp_matches(lower(file), 'test|spec') THEN 'test' WHEN regexp_matches(lower(file), '\.(?:ya?ml|json|toml|ini|cfg|conf|config|env|properties)$') THEN 'config' ELSE 'production' END"
_MEMBERS = {"type": "k", "risk": "risk_level", "file_type": _TYPE, "environment": _ENV, "validated": "CAST(coalesce(validated, false) AS VARCHAR)"}


@query(
    "distributions",
    f"""WITH b AS (SELECT coalesce(file_path, '') AS file, {_KIND} AS k, risk_level, validated, coalesce(context_modifier <= 0.1, false) AS test FROM findings)
        SELECT dimension, member, n, round(n / (SELECT count(*) FROM b)::DOUBLE, 9) AS share FROM (
            {' UNION ALL '.join(f"SELECT '{d}' AS dimension, coalesce({m}, 'unknown') AS member, count(*) AS n FROM b GROUP BY ALL" for d, m in _MEMBERS.items())})""",
)
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distributions(reported(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(
    "top_risks",
    f"""SELECT risk_level, kind, n FROM (SELECT risk_level, {_KIND} AS kind, count(*) AS n FROM findings WHERE risk_level IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') GROUP BY ALL)
        ORDER BY list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], risk_level), n DESC, kind NULLS FIRST LIMIT 5""",
)
def top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pairs of level and type that weigh most: a top-k report."""
    return reports.top_risks(reported(spark, sf_dir))


@query("risk_lists", "SELECT risk_level AS list, finding_id FROM findings WHERE risk_level IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')")
def risk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the four risk lists of a report."""
    lists = reports.by_level(reported(spark, sf_dir))
    parts = [df.select(F.lit(level).alias("list"), "finding_id") for level, df in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "findings_with_risk",
    f"SELECT finding_id, {_KIND} AS kind, CASE WHEN finding_id % 3 <> 0 THEN round(coalesce(confidence, 0) * 0.5::DOUBLE, 9) END AS risk_score FROM findings",
)
def findings_with_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings beside a table of assessments that lacks every third one."""
    t = table(spark, sf_dir, "findings")
    risks = t.where(F.col("finding_id") % 3 != 0).select("finding_id", F.round(F.coalesce("confidence", F.lit(0.0)) * 0.5, 9).alias("risk_score"), F.lit("clash").alias("kind"))
    return reports.with_risk(reported(spark, sf_dir), risks, "finding_id").select("finding_id", "kind", "risk_score")


# Rules and identifiers on golden cases ------------------------------------------------------------------------------


@query(
    "rule_positions",
    " UNION ALL ".join(
        f"""SELECT finding_id AS id, '{r}' AS rule, v AS value, i AS start, length(left(text, i)) - length(replace(left(text, i), chr(10), '')) + 1 AS line FROM (
            SELECT finding_id, text, v, CAST(CASE WHEN n = 1 THEN instr(text, v) - 1 END AS INT) AS i FROM (
                SELECT finding_id, text, unnest(m) AS v, len(m) AS n FROM (SELECT finding_id, text, regexp_extract_all(text, {quoted(patterns.SECRET_RULES[r][0])}) AS m
                FROM (SELECT finding_id, concat_ws(chr(10), context_before, context, context_after) AS text FROM findings) WHERE regexp_matches(lower(text), {quoted(patterns.any_of(patterns.SECRET_RULES[r][1]))}))) WHERE n = 1)"""
        for r in ("aws-access-key-id", "github-pat", "private-key")
    ),
)
def rule_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the key rules match, for texts in which a rule matches once, as SQL has no position of a later match; repeats are
    tested against brute force."""
    t = table(spark, sf_dir, "findings")
    text = F.concat_ws("\n", "context_before", "context", "context_after")
    rules = {r: patterns.SECRET_RULES[r] for r in ("aws-access-key-id", "github-pat", "private-key")}
    found = detect.detect_rules(t.select("finding_id", "file_path", text.alias("text")), "finding_id", "file_path", "text", rules, ())
    once = found.groupBy("id", "rule").agg(F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("value", "start", "line")])
    return once.where(F.col("n") == 1).drop("n").select("id", "rule", "value", "start", "line")
