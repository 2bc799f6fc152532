"""Scores of findings as column expressions: confidence from weighted factors, and impact, likelihood and exposure.

Inputs are columns of one row (nullable where a signal may be missing); tables of weights are data, so that the same few
helpers (``lookup``, ``boosted``, ``summed``) evaluate all of them.  ``now`` is always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.functions import patterns
from sundew.functions.masking import lookup

# Weights, penalties and thresholds of the scores.
CONTEXT_PENALTIES = {"test": 0.2, "mock": 0.1, "sample": 0.2, "demo": 0.2, "fixture": 0.1, "documentation": 0.5, "debug": 0.7}
ENVIRONMENT = {
    "test": 0.2, "mock": 0.1, "sample": 0.2, "demo": 0.2, "fixture": 0.1, "example": 0.3, "documentation": 0.5, "debug": 0.7,
    "production": 1.2, "prod": 1.2, "live": 1.2, "release": 1.1,
}
ENVIRONMENT_SIGNS = {
    "test": r"(?i:\b(?:test|mock|sample|demo|fake|dummy|stub)\b|_test\.|test_)|/(?:test|tests|testing|spec|fixtures|mocks)/",
    "production": r"(?i:\b(?:prod|production|live|release)\b|prod_|production_)|/(?:prod|production|release)/",
    "mock": r"(?i:mock_)|_mock\.|\.mock\.",
    "fixture": r"(?i:\bfixture\b)|/fixtures/|\.fixture\.",
    "docs": r"(?i:\b(?:docs?|documentation|readme|guide|tutorial)\b)|/(?:docs|documentation)/|\.(?:md|rst)$|(?://|#|<!--).*example",
}
CONTENT_SIGNS = {"sample": "sample", "demo": "demo", "dummy": "dummy", "stub": "stub", "debug": "debug", "dev": "development", "staging": "staging"}
CO_OCCURRENCE = {
    "TFN": {"MEDICARE": 1.4, "NAME": 1.3, "ADDRESS": 1.3, "PHONE": 1.2, "EMAIL": 1.1, "ABN": 1.2},
    "MEDICARE": {"NAME": 1.2, "ADDRESS": 1.2, "PHONE": 1.1},
    "BSB": {"ACCOUNT": 1.3, "NAME": 1.2, "TFN": 1.2},
    "ABN": {"NAME": 1.2, "ADDRESS": 1.2, "PHONE": 1.1},
    "CREDIT_CARD": {"NAME": 1.3, "ADDRESS": 1.3, "PHONE": 1.2},
}
DECAY, MOST_BOOST = 0.9, 1.6
TYPE_WEIGHTS = {
    "TFN": 1.0, "MEDICARE": 0.95, "CREDIT_CARD": 0.9, "PASSPORT": 0.9, "ABN": 0.8, "DRIVER_LICENSE": 0.8, "BSB": 0.7, "ACCOUNT": 0.7,
    "NAME": 0.6, "ADDRESS": 0.6, "PHONE": 0.5, "EMAIL": 0.4, "IP_ADDRESS": 0.2,
}
FACTOR_WEIGHTS = {"proximity": 0.4, "ml": 0.3, "validation": 0.3}
SCORED_TYPES = tuple(TYPE_WEIGHTS)
SENSITIVITY = {
    "TFN": 1.0, "MEDICARE": 0.95, "CREDIT_CARD": 0.9, "PASSPORT": 0.9, "DRIVER_LICENSE": 0.85, "ABN": 0.6, "BSB": 0.7, "ACCOUNT": 0.8,
    "NAME": 0.5, "ADDRESS": 0.5, "PHONE": 0.4, "EMAIL": 0.3, "IP_ADDRESS": 0.2,
}
FINANCIAL = {"CREDIT_CARD": 1.0, "BSB": 0.8, "ACCOUNT": 0.8, "TFN": 0.7, "MEDICARE": 0.5, "PASSPORT": 0.6, "ABN": 0.3, "NAME": 0.2, "EMAIL": 0.1}
INDUSTRIES = {"banking": 1.3, "finance": 1.3, "healthcare": 1.2, "government": 1.2, "insurance": 1.1, "retail": 1.0, "technology": 0.9}
HIGH_VALUE = ("TFN", "CREDIT_CARD", "MEDICARE", "PASSPORT")
FINANCIAL_TYPES = ("TFN", "CREDIT_CARD", "BSB", "ACCOUNT")
IDENTITY_TYPES = ("TFN", "MEDICARE", "PASSPORT", "DRIVER_LICENSE")
KNOWN_PATHS = ("config", "conf", "settings", "env", ".env", "credentials", "secrets", "keys", "auth")
SENSITIVE_PATHS = ("prod", "production", "live", "payment", "billing", "financial", "customer", "user", "personal")
COMMON_PATHS = ("config", "conf", ".env", "settings", "src", "app", "lib", "pkg")
ENCRYPTION_WORDS = ("encrypted", "encrypt", "aes", "rsa", "hash", "bcrypt", "pbkdf2", "sha256", "base64")
ENCRYPTION = {"PLAIN_TEXT": 1.2, "UNKNOWN": 1.0, "POSSIBLY_ENCRYPTED": 0.6, "ENCRYPTED": 0.3}
VISIBILITY = {
    "PUBLIC_HIGH_VISIBILITY": 1.5, "PUBLIC_MEDIUM_VISIBILITY": 1.3, "PUBLIC_LOW_VISIBILITY": 1.1, "PRIVATE_LARGE_ORG": 0.8,
    "PRIVATE_MEDIUM_ORG": 0.6, "PRIVATE_SMALL_ORG": 0.4,
}
PUBLIC_FACTOR, PRODUCTION_FACTOR, SENSITIVE_PATH_FACTOR = 1.3, 1.5, 1.2
IMPACT_WEIGHTS = {"sensitivity": 0.25, "financial": 0.25, "regulatory": 0.25, "reputational": 0.15, "scale": 0.10}
RISK_WEIGHTS = (0.4, 0.3, 0.3)
SCALE_FACTORS = ((1000, 2.0), (100, 1.5), (10, 1.2))
REGULATORY_FLOORS = {"regulated": 0.8, "other": 0.5, "financial": 0.9, "identity": 0.85}
REPUTATION = {"stars over 100": 1.2, "stars over 1000": 1.5, "each incident": 0.1, "high value": 1.3}
PEOPLE_SHARES = ((0, 0.0), (10, 0.3), (100, 0.6), (1000, 0.8))
COMPLEXITY = {"public": -0.3, "test": 0.3, "configuration": -0.2, "source": 0.1, "known path": -0.1, "validated": -0.2, "other types": -0.1}
THREAT = {"high value": 0.2, "stars over 1000": 0.1, "regulated": 0.2, "incident in six months": 0.1}
REACH = {"main branch": 0.1, "common path": 0.05, "large file": 0.05}
ACCESS = {"public": 0.9, "private": 0.5, "test factor": 0.5}
MATURITY = {"high": 0.2, "medium": 0.1, "low": -0.1}
CONTROLS = {"public": 0.1, "private": 0.5, "security team": 0.2, "regulated": 0.2, "pipeline": 0.1, "share": 0.5}
AGE_FACTORS = ((180, 1.3), (90, 1.2), (30, 1.1))
EXPOSURE = {"high value": 1.2, "contributors over 10": 1.1, "contributors over 50": 1.2, "forks over 10": 1.1, "forks over 100": 1.3}
LIKELIHOOD = {"public": 1.5, "security team": 0.7, "open to all": 1.3, "regulated without pipeline": 0.6, "each incident": 0.15, "most incidents": 2.0, "stale": 1.2}

#: Columns that ``risk`` reads besides those of a finding, with their types.
RISK_INPUTS = """is_public boolean, stars int, forks int, contributors int, last_commit timestamp, default_branch string, has_cicd boolean,
    file_size long, is_production boolean, is_test_file boolean, is_configuration boolean, is_source boolean, industry string, org_size string,
    regulated boolean, has_security_team boolean, maturity string, incidents int, last_incident timestamp, co_types array<string>"""


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def boosted(base: Column, steps: list[tuple[Column, float | Column]]) -> Column:
    """``base`` times the factor of every condition that holds; null conditions don't."""
    return reduce(lambda x, s: x * F.when(s[0], s[1]).otherwise(1.0), steps, base)


def summed(base: float, steps: list[tuple[Column, float]]) -> Column:
    """``base`` plus the gain of every condition that holds."""
    return reduce(lambda x, s: x + F.when(s[0], s[1]).otherwise(0.0), steps, F.lit(base))


# Confidence ---------------------------------------------------------------------------------------------------------


def proximity_factor(score: Column, context: Column) -> Column:
    """0.5 without a score, else the score less the penalty of its context."""
    return F.when(score.isNull(), 0.5).otherwise(clamp(score * lookup(context, CONTEXT_PENALTIES, F.lit(1.0))))


def ml_factor(confidence: Column, valid: Column) -> Column:
    """0.5 without a model's answer; a fifth of its confidence if it says no."""
    return F.when(confidence.isNull(), 0.5).otherwise(clamp(confidence * F.when(valid, 1.0).otherwise(0.2)))


def validation_factor(valid: Column, confidence: Column) -> Column:
    """The check's confidence if it passed, else 0."""
    return F.when(valid, confidence).otherwise(0.0)


def environment_signs(path: Column, content: Column) -> Column:
    """Names of the environments that path and content speak of."""
    text, low = F.concat_ws(" ", path, content), F.lower(content)
    marks = [F.when(text.rlike(patterns.java(p)), F.lit(n)) for n, p in ENVIRONMENT_SIGNS.items()]
    marks += [F.when(F.contains(low, F.lit(w)), F.lit(n)) for w, n in CONTENT_SIGNS.items()]
    return F.array_distinct(F.array_compact(F.array(*marks)))


def environment_factor(path: Column, content: Column) -> Column:
    """Product of penalties and bonuses of the signs, at most 2; signs without a table entry count nothing."""
    signs = environment_signs(path, content)
    return clamp(boosted(F.lit(1.0), [(F.array_contains(signs, n), v) for n, v in ENVIRONMENT.items()]), 0.0, 2.0)


def co_occurrence_step(kind: Column, other: Column, distance: Column) -> Column:
    """Factor of one other type at a distance: its boost decays by a tenth per line beyond the first; 1 if none is set."""
    boost = F.lit(1.0)
    for k, row in CO_OCCURRENCE.items():
        boost = F.when(kind == k, lookup(other, row, F.lit(1.0))).otherwise(boost)
    return 1.0 + (boost - 1.0) * F.pow(F.lit(DECAY), F.greatest(distance - 1, F.lit(0)))


def co_occurrence_factors(pairs: DataFrame) -> DataFrame:
    """(file, kind, line, factor): the product over the types that ``operators.pairs.co_occurrences`` found, capped."""
    step = co_occurrence_step(F.col("kind"), F.col("other_kind"), F.col("distance"))
    return pairs.groupBy("file", "kind", "line").agg(F.least(F.product(step), F.lit(MOST_BOOST)).alias("factor"))


def type_weight(kind: Column) -> Column:
    return lookup(kind, TYPE_WEIGHTS, F.lit(0.5))


def aggregate_score(proximity: Column, ml: Column, validation: Column, weight: Column, environment: Column, co_occurrence: Column, weighted: bool = True) -> Column:
    w = FACTOR_WEIGHTS
    base = proximity * w["proximity"] + ml * w["ml"] + validation * w["validation"] if weighted else (proximity + ml + validation) / 3
    return clamp(base * weight * environment * co_occurrence)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.9, "CRITICAL").when(score >= 0.7, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def adjustments(environment: Column, co_occurrence: Column, weight: Column, validation: Column) -> Column:
    """array<struct<type, impact>>: what raised or lowered a score besides its weighted mean."""
    entry = lambda c, name, x: F.when(c, F.struct(F.lit(name).alias("type"), x.alias("impact")))
    return F.array_compact(
        F.array(
            entry(environment < 1, "environment_penalty", environment - 1.0),
            entry(environment > 1, "environment_bonus", environment - 1.0),
            entry(co_occurrence > 1, "co_occurrence_boost", co_occurrence - 1.0),
            entry(weight < 1, "pi_type_weight", weight - 1.0),
            entry(validation == 0, "validation_failure", F.lit(-0.5)),
        )
    )


#: Component -> (its factor's column, its weight's name or None for a multiplier).
COMPONENTS = {
    "proximity": ("proximity_factor", "proximity"), "ml_validation": ("ml_factor", "ml"), "algorithmic_validation": ("validation_factor", "validation"),
    "environment": ("environment_factor", None), "co_occurrence": ("co_occurrence_factor", None), "pi_type_weight": ("type_weight", None),
}


def breakdown() -> Column:
    """struct<final_score, components array<struct<name, score, weight>>, weights map, adjustments> of a scored finding."""
    weight = {n: 1.0 if w is None else FACTOR_WEIGHTS[w] for n, (_, w) in COMPONENTS.items()}
    parts = [F.struct(F.lit(n).alias("name"), F.col(c).alias("score"), F.lit(weight[n]).alias("weight")) for n, (c, _) in COMPONENTS.items()]
    weights = F.map_from_arrays(F.array(*[F.lit(n) for n in weight]), F.array(*[F.lit(w) for w in weight.values()]))
    return F.struct(F.col("score").alias("final_score"), F.array(*parts).alias("components"), weights.alias("weights"), F.col("adjustments"))


def audit_trail(at: Column) -> Column:
    """array<struct<component, timestamp, score, details map>> of a scored finding: its five analyses and the aggregation,
    a millisecond apart from ``at`` on."""
    text = lambda c, digits: F.format_string(f"%.{digits}f", c)

    def weighed(column: str, weight: str) -> list[Column]:
        w = FACTOR_WEIGHTS[weight]
        return [F.lit("weight"), F.lit(f"{w:.2f}"), F.lit("impact"), text(F.col(column) * w, 3)]

    def multiplied(column: str) -> list[Column]:
        x = F.col(column)
        return [F.lit("multiplier"), text(x, 3), F.lit("impact"), F.when(x < 1, "reduced").when(x > 1, "increased").otherwise("neutral")]

    entries = [
        ("proximity", "proximity_factor", weighed("proximity_factor", "proximity")),
        ("ml_validation", "ml_factor", weighed("ml_factor", "ml")),
        ("algorithmic_validation", "validation_factor", weighed("validation_factor", "validation")),
        ("environment_analysis", "environment_factor", multiplied("environment_factor")),
        ("co_occurrence_analysis", "co_occurrence_factor", multiplied("co_occurrence_factor")),
        ("aggregation", "score", [F.lit("final_score"), text(F.col("score"), 6), F.lit("risk_level"), F.coalesce("level", F.lit(""))]),
    ]
    made = []
    for i, (name, column, details) in enumerate(entries):
        when = F.timestamp_micros(F.unix_micros(at) + i * 1000)
        made.append(F.struct(F.lit(name).alias("component"), when.alias("timestamp"), F.col(column).cast("double").alias("score"), F.create_map(*details).alias("details")))
    return F.array(*made)


def input_error(kind: Column, value: Column) -> Column:
    """Why a finding can't be scored, or null."""
    return (
        F.when(F.coalesce(kind, F.lit("")) == "", "finding type is required")
        .when(F.coalesce(value, F.lit("")) == "", "finding match is required")
        .when(~kind.isin(*SCORED_TYPES), F.concat(F.lit("unsupported PI type: "), kind))
    )


def score(findings: DataFrame, use_ml: bool = True, use_proximity: bool = True, use_validation: bool = True) -> DataFrame:
    """Adds the six factors, ``score``, ``level``, ``adjustments`` and ``error`` (then no score) to findings with kind,
    value, file, content, proximity_score, proximity_context, ml_confidence, ml_valid, check_valid, check_confidence and
    co_occurrence (null stands for 1).  A factor that is switched off takes its neutral value: 0.5, 0.5, 0."""
    c = F.col
    factors = {
        "proximity_factor": proximity_factor(c("proximity_score"), c("proximity_context")) if use_proximity else F.lit(0.5),
        "ml_factor": ml_factor(c("ml_confidence"), c("ml_valid")) if use_ml else F.lit(0.5),
        "validation_factor": validation_factor(c("check_valid"), c("check_confidence")) if use_validation else F.lit(0.0),
        "environment_factor": environment_factor(c("file"), c("content")),
        "co_occurrence_factor": F.coalesce("co_occurrence", F.lit(1.0)),
        "type_weight": type_weight(c("kind")),
        "error": input_error(c("kind"), c("value")),
    }
    out = findings.withColumns(factors)
    total = aggregate_score(*[c(n) for n in ("proximity_factor", "ml_factor", "validation_factor", "type_weight", "environment_factor", "co_occurrence_factor")])
    out = out.withColumn("score", F.when(c("error").isNull(), total))
    more = adjustments(c("environment_factor"), c("co_occurrence_factor"), c("type_weight"), c("validation_factor"))
    return out.withColumns({"level": F.when(c("score").isNotNull(), confidence_level(c("score"))), "adjustments": more})


# Risk ---------------------------------------------------------------------------------------------------------------


def record_count() -> Column:
    base = F.when(F.col("file_size") > 1 << 20, 100).when(F.col("is_configuration"), 10).otherwise(1)
    return base * F.greatest(F.coalesce(F.size("co_types"), F.lit(0)), F.lit(1))


def affected_people(records: Column) -> Column:
    reach = F.least(1 + F.floor(F.coalesce("forks", F.lit(0)) / 100), F.lit(10))
    people = F.when(F.col("is_test_file"), 0).otherwise(records)
    people = F.when(F.col("is_production"), F.floor(people * PRODUCTION_FACTOR)).otherwise(people)
    return (people * F.when(F.col("is_public"), reach).otherwise(1)).cast("long")


def impact() -> dict[str, Column]:
    kind, stars, incidents = F.col("kind"), F.col("stars"), F.coalesce("incidents", F.lit(0))
    records = record_count()
    people = affected_people(records)
    scale = F.lit(1.0)
    for least, factor in reversed(SCALE_FACTORS):
        scale = F.when(records > least, factor).otherwise(scale)
    financial = clamp(lookup(kind, FINANCIAL, F.lit(0.3)) * scale)
    floors = REGULATORY_FLOORS
    floor = F.when(F.col("regulated"), floors["regulated"]).otherwise(floors["other"])
    floor = F.greatest(floor, F.when(kind.isin(*FINANCIAL_TYPES), floors["financial"]).otherwise(0.0), F.when(kind.isin(*IDENTITY_TYPES), floors["identity"]).otherwise(0.0))
    regulatory = clamp(floor * lookup(F.col("industry"), INDUSTRIES, F.lit(1.0)))
    r = REPUTATION
    steps = [(F.col("is_public"), PUBLIC_FACTOR), (stars > 100, r["stars over 100"]), (stars > 1000, r["stars over 1000"])]
    steps += [(incidents > 0, 1.0 + r["each incident"] * incidents), (kind.isin(*HIGH_VALUE), r["high value"])]
    reputational = clamp(boosted(F.lit(0.5), steps))
    share = F.lit(1.0)
    for most, part in reversed(PEOPLE_SHARES):
        share = F.when(people <= most, part).otherwise(share)
    parts = {"sensitivity": lookup(kind, SENSITIVITY, F.lit(0.5)), "financial": financial, "regulatory": regulatory, "reputational": reputational, "scale": share}
    total = clamp(reduce(lambda a, b: a + b, [parts[n] * w for n, w in IMPACT_WEIGHTS.items()]))
    return {"impact": total, "affected": people, "financial_impact": financial, "regulatory_impact": regulatory}


def likelihood(now: Column) -> Column:
    c, path = F.col, F.lower("file")
    others = F.coalesce(F.size("co_types"), F.lit(0))
    complexity = summed(
        0.5,
        [(c("is_public"), COMPLEXITY["public"]), (c("is_test_file"), COMPLEXITY["test"]), (c("is_configuration"), COMPLEXITY["configuration"]),
         (c("is_source") & ~c("is_configuration"), COMPLEXITY["source"]), (path.rlike(patterns.any_of(KNOWN_PATHS)), COMPLEXITY["known path"]),
         (c("validated"), COMPLEXITY["validated"]), (others > 2, COMPLEXITY["other types"])],
    )
    recent = c("last_incident") > F.add_months(now, -6)
    threats = [(c("kind").isin(*HIGH_VALUE), "high value"), (c("stars") > 1000, "stars over 1000"), (c("regulated"), "regulated"), (recent, "incident in six months")]
    threat = clamp(summed(0.5, [(t, THREAT[n]) for t, n in threats]))
    private = ~F.coalesce("is_public", F.lit(False))
    cicd, incidents = F.coalesce("has_cicd", F.lit(False)), F.coalesce("incidents", F.lit(0))
    steps = [
        (c("is_public"), LIKELIHOOD["public"]), (private & c("has_security_team"), LIKELIHOOD["security team"]), (c("is_public"), LIKELIHOOD["open to all"]),
        (private & ~cicd & c("regulated"), LIKELIHOOD["regulated without pipeline"]),
        (incidents > 0, F.least(1.0 + LIKELIHOOD["each incident"] * incidents, F.lit(LIKELIHOOD["most incidents"]))),
        (c("last_commit") < now - F.expr("INTERVAL 365 DAYS"), LIKELIHOOD["stale"]),
        (c("is_production"), PRODUCTION_FACTOR), (path.rlike(patterns.any_of(SENSITIVE_PATHS)), SENSITIVE_PATH_FACTOR),
    ]
    return clamp(boosted(clamp(1.0 - complexity) * (0.5 + 0.5 * threat), steps))


def visibility() -> Column:
    public = F.when(F.col("stars") > 1000, "PUBLIC_HIGH_VISIBILITY").when(F.col("stars") > 100, "PUBLIC_MEDIUM_VISIBILITY").otherwise("PUBLIC_LOW_VISIBILITY")
    private = F.when(F.col("org_size") == "large", "PRIVATE_LARGE_ORG").when(F.col("org_size") == "medium", "PRIVATE_MEDIUM_ORG").otherwise("PRIVATE_SMALL_ORG")
    return F.when(F.col("is_public"), public).otherwise(private)


def encryption() -> Column:
    """By words of the context, then by a long lower-cased match that ends as base64 does, then by validation."""
    value = F.lower("value")
    return (
        F.when(F.lower("context").rlike(patterns.any_of(ENCRYPTION_WORDS)), "ENCRYPTED")
        .when((F.length(value) >= 20) & value.endswith("="), "POSSIBLY_ENCRYPTED")
        .when(F.col("validated"), "PLAIN_TEXT")
        .otherwise("UNKNOWN")
    )


def exposure(now: Column) -> Column:
    c, path = F.col, F.lower("file")
    days = F.coalesce(F.floor((now.cast("long") - c("last_commit").cast("long")) / 86400), F.lit(0))
    reach = summed(
        0.0,
        [(c("default_branch").isin("main", "master"), REACH["main branch"]), (path.rlike(patterns.any_of(COMMON_PATHS)), REACH["common path"]), (c("file_size") > 100 * 1024, REACH["large file"])],
    )
    access = clamp((F.when(c("is_public"), ACCESS["public"]).otherwise(ACCESS["private"]) + reach) * F.when(c("is_test_file"), ACCESS["test factor"]).otherwise(1.0))
    k = CONTROLS
    private = summed(k["private"], [(c("has_security_team"), k["security team"]), (c("regulated"), k["regulated"]), (c("has_cicd"), k["pipeline"])])
    controls = F.when(c("is_public"), k["public"]).otherwise(clamp(private + lookup(c("maturity"), MATURITY, F.lit(0.0))))
    age = F.lit(1.0)
    for least, factor in reversed(AGE_FACTORS):
        age = F.when(days > least, factor).otherwise(age)
    base = access * lookup(visibility(), VISIBILITY, F.lit(1.0)) * age * lookup(encryption(), ENCRYPTION, F.lit(1.0)) * (1.0 - k["share"] * controls)
    steps = [(c("kind").isin(*HIGH_VALUE), "high value"), (c("contributors") > 10, "contributors over 10"), (c("contributors") > 50, "contributors over 50")]
    steps += [(c("forks") > 10, "forks over 10"), (c("forks") > 100, "forks over 100")]
    return clamp(boosted(base, [(test, EXPOSURE[n]) for test, n in steps]))


def risk_level(x: Column) -> Column:
    return F.when(x >= 0.8, "CRITICAL").when(x >= 0.6, "HIGH").when(x >= 0.4, "MEDIUM").otherwise("LOW")


def risk_category() -> Column:
    """What the risk is of, from the columns that ``risk`` has added."""
    c = F.col
    others = F.coalesce("co_types", F.array().cast("array<string>"))
    money = F.exists(others, lambda t: t.isin(*FINANCIAL_TYPES)) | (c("financial_impact") > 0.7)
    return (
        F.when(c("kind").isin(*FINANCIAL_TYPES) & money, "FINANCIAL_FRAUD")
        .when(c("kind").isin(*IDENTITY_TYPES) & ((F.size(others) >= 1) | c("is_public")), "IDENTITY_THEFT")
        .when(c("is_test_file"), "OPERATIONAL")
        .when(c("regulated") & (c("regulatory_impact") > 0.6), "REGULATORY_BREACH")
        .when(c("affected") > 100, "PRIVACY_BREACH")
        .otherwise("OPERATIONAL")
    )


def risk(findings: DataFrame, now: Column, multiplicative: bool = True) -> DataFrame:
    """Adds impact, likelihood, exposure, overall risk, its level and category to findings with kind, value, file,
    context, validated and the columns of ``RISK_INPUTS`` (nulls count as absent)."""
    out = findings.withColumns({**impact(), "likelihood": likelihood(now), "exposure": exposure(now)})
    three = [F.col(n) for n in ("impact", "likelihood", "exposure")]
    total = three[0] * three[1] * three[2] * sum(RISK_WEIGHTS) if multiplicative else reduce(lambda a, b: a + b, [x * w for x, w in zip(three, RISK_WEIGHTS)])
    out = out.withColumn("risk", clamp(total))
    ident = F.concat(F.lit("RISK-"), F.hex(F.xxhash64("file", "kind", "value")))
    return out.withColumns({"risk_level": risk_level(F.col("risk")), "category": risk_category(), "assessment_id": ident})
