import pytest
from pyspark.sql import functions as F

from sundew.plans import scoring as S


def test_co_occurrence(spark):
    cases = {
        "a": ([("TFN", "MEDICARE", 2)], 1.36),
        "b": ([("TFN", "ABN", 1)], 1.2),
        "c": ([("BSB", "ACCOUNT", 1)], 1.3),
        "d": ([("TFN", "MEDICARE", 1), ("TFN", "NAME", 1), ("TFN", "ADDRESS", 1)], 1.6),
        "e": ([("PHONE", "NAME", 1)], 1.0),
    }
    rows = [(f, k, 1, o, d) for f, (pairs, _) in cases.items() for k, o, d in pairs]
    df = spark.createDataFrame(rows, "file string, kind string, line long, other_kind string, distance long")
    got = {r.file: r.factor for r in S.co_occurrence_factors(df).collect()}
    assert got == pytest.approx({f: want for f, (_, want) in cases.items()})


def test_environment(spark):
    rows = [("src/production/config.go", "x", 1.2), ("user_test.go", "x", 0.2), ("a/mock_user.go", "x", 0.1), ("src/user.go", "x", 1.0), ("src/user.go", "demo", 0.04)]
    df = spark.createDataFrame(rows, "f string, c string, want double").select("want", S.environment_factor(F.col("f"), F.col("c")).alias("got"))
    assert [r.got for r in df.collect()] == pytest.approx([w for *_, w in rows])


def test_factors(spark):
    df = spark.createDataFrame([(None, None, None, None), (0.8, "test", 0.9, False), (0.8, "label", 0.9, True)], "p double, c string, m double, v boolean")
    got = df.select(S.proximity_factor(F.col("p"), F.col("c")).alias("p"), S.ml_factor(F.col("m"), F.col("v")).alias("m"), S.validation_factor(F.col("v"), F.lit(0.95)).alias("v")).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5, 0.0), (pytest.approx(0.16), pytest.approx(0.18), 0.0), (0.8, 0.9, 0.95)]


def scored(spark, kind, value):
    row = (kind, value, "src/a.go", "x", 0.9, "label", 0.9, True, True, 0.95, None)
    return spark.createDataFrame([row], "kind string, value string, file string, content string, proximity_score double, proximity_context string, ml_confidence double, ml_valid boolean, check_valid boolean, check_confidence double, co_occurrence double")


def test_score(spark):
    r = S.score(scored(spark, "TFN", "123456782")).first()
    assert r.score == pytest.approx(0.4 * 0.9 + 0.3 * 0.9 + 0.3 * 0.95) and r.level == "CRITICAL" and r.adjustments == []
    assert S.score(scored(spark, "ACN", "1")).first().error == "unsupported PI type: ACN"
    assert S.score(scored(spark, "TFN", "")).first().score is None
    off = S.score(scored(spark, "TFN", "1"), use_ml=False, use_proximity=False, use_validation=False).first()
    assert off.score == pytest.approx(0.35) and off.adjustments[0].type == "validation_failure"


def test_risk_bounds(spark):
    names = [f.name for f in spark.createDataFrame([], S.RISK_INPUTS).schema]
    empty = spark.createDataFrame([(None,) * len(names)] * 2, S.RISK_INPUTS)
    df = empty.select(F.lit("TFN").alias("kind"), F.lit("1").alias("value"), F.lit("prod/config.yml").alias("file"), F.lit("x").alias("context"), F.lit(True).alias("validated"), *names)
    for r in S.risk(df, F.lit("2026-01-01").cast("timestamp")).collect():
        assert all(0 <= x <= 1 for x in (r.impact, r.likelihood, r.exposure, r.risk) if x is not None)
        assert r.risk_level in ("LOW", "MEDIUM", "HIGH", "CRITICAL") and r.category
