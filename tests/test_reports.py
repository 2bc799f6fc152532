from datetime import datetime

from pyspark.sql import functions as F

from sundew.functions import proximity
from sundew.operators import evaluate
from sundew.plans import scoring
from sundew.sinks import reports


def test_keywords_of_type(spark):
    df = spark.createDataFrame([("SELECT tfn_no FROM people; // let x= 3",), ("let",), ("",), (None,), ('{"Name": 1} info: a=b =c',)], "t string")
    got = lambda k: [r.k for r in df.select(proximity.keywords_of_type(F.col("t"), k).alias("k")).collect()]
    assert got("database")[:4] == [["FROM", "SELECT", "tfn_no"], [], [], None]
    assert got("variable")[:3] == [["let", "x"], ["let"], []]
    assert got("log")[4] == ["INFO"] and got("config")[4] == ["a"] and got("form")[4] == ["json", "name", "structured"]
    assert got("documentation")[1] == ["let"] and got("production") == [[], [], [], None, []]


def test_assessment_and_context_accuracy(spark):
    rates = spark.createDataFrame([("a", 0.9, 0.9, 0.9), ("b", 0.5, 0.8, 0.61), ("c", 0.9, 0.5, 0.64), ("d", 0.6, 0.6, 0.6)], "n string, precision double, recall double, f1 double")
    got = {r.n: (r.grade, r.strengths, r.weaknesses, r.tune) for r in evaluate.assessment(rates).collect()}
    assert got["a"] == ("A", ["few false positives", "finds most", "well balanced"], [], "edge cases")
    assert got["b"][2:] == (["many false positives", "poorly balanced"], "precision") and got["c"][3] == "recall" and got["d"][3] == "both"
    samples = spark.createDataFrame([("test", 0), ("test", 1), ("production", 1), ("logging", 0), ("docs", 0), (None, 0)], "c string, n int")
    r = evaluate.context_accuracy(samples, "c", "n").first()
    assert (r.samples, r.right) == (6, 4) and evaluate.context_accuracy(samples.limit(0), "c", "n").first().accuracy == 0


def test_trail_and_breakdown(spark):
    row = ("TFN", "1", "prod.yml", "", 0.8, "production", None, None, True, 0.95, 1.3)
    df = spark.createDataFrame(
        [row, (None, *row[1:])],
        "kind string, value string, file string, content string, proximity_score double, proximity_context string, ml_confidence double, ml_valid boolean, check_valid boolean, check_confidence double, co_occurrence double",
    )
    s = scoring.score(df).select("kind", "score", "level", scoring.breakdown().alias("b"), scoring.audit_trail(F.lit(datetime(2026, 1, 1))).alias("t"))
    r = s.where("kind is not null").first()
    assert r.b.final_score == r.score and [c.name for c in r.b.components] == list(scoring.COMPONENTS) and r.b.weights["ml_validation"] == 0.3
    assert [e.timestamp.microsecond for e in r.t] == [i * 1000 for i in range(6)] and r.t[5].details["risk_level"] == r.level
    assert r.t[0].details == {"weight": "0.40", "impact": f"{0.8 * 0.4:.3f}"} and r.t[4].details["impact"] == "increased"
    assert s.where("kind is null").first().b.final_score is None


def test_sarif_with_risk(spark):
    import json

    fix = [("Rotate", "do it", "HIGH", "low", "now", "c"), ("Later", "some day", "LOW", "low", "2w", "c")]
    rows = [("f.go", 3, 5, "TFN", "123456782", "x", True, 0.9, "CRITICAL", 0.8, "c", 0.1, 0.2, 0.3, fix), ("g.go", 1, 1, "ABN", "1", "", False, 0.5, "LOW", None, None, None, None, None, None)]
    df = spark.createDataFrame(
        rows,
        "file string, line int, col int, kind string, value string, context string, validated boolean, confidence double, risk_level string, risk_score double, category string, impact double, "
        "likelihood double, exposure double, mitigations array<struct<title string, description string, priority string, effort string, timeline string, category string>>",
    ).withColumn("repository", F.lit("r"))
    body = json.loads(reports.sarif_report(df, "t", "1", ["repository"], risk=True, invocation={"started": "a", "finished": "b"}).first().body)
    run = body["runs"][0]
    by = {r["ruleId"]: r for r in run["results"]}
    tfn, abn = by["PI001"], by["PI003"]
    assert (tfn["level"], tfn["rank"], tfn["properties"]["riskAssessment"]["overallRisk"]) == ("error", 80.0, 0.8) and len(tfn["fixes"]) == 1
    change = tfn["fixes"][0]["artifactChanges"][0]["replacements"][0]
    assert change["deletedRegion"]["endColumn"] == 14 and change["insertedContent"]["text"] == "/* REDACTED - TFN */"
    assert "rank" not in abn and "fixes" not in abn and abn["level"] == "warning" and run["invocations"][0]["executionSuccessful"]


def test_report_parts(spark):
    rows = [("a/mock_x.go", "TFN", "HIGH", True, False), ("b.YML", "TFN", "HIGH", None, None), ("c", None, None, False, True)]
    df = spark.createDataFrame(rows, "file string, kind string, risk_level string, validated boolean, is_test boolean").withColumns({"line": F.lit(1), "col": F.lit(1)})
    got = {(r.dimension, r.member): r.n for r in reports.distributions(df).collect()}
    assert got[("environment", "mock")] == got[("environment", "config")] == got[("environment", "test")] == 1 and got[("type", "unknown")] == 1 == got[("file_type", "none")]
    assert [tuple(r) for r in reports.top_risks(df).collect()] == [("HIGH", "TFN", 2)]
    assert {k: v.count() for k, v in reports.by_level(df).items()} == {"CRITICAL": 0, "HIGH": 2, "MEDIUM": 0, "LOW": 0}
    page = reports.html_page(df.limit(0).withColumns({"value": F.lit("x"), "confidence": F.lit(0.1)}), "none")
    assert "All findings" in page and reports.percent(None) == "0.0%" and reports.risk_class(None) == "risk-unknown" and reports.date_text(datetime(2026, 1, 2), False) == "2026-01-02"


def test_rule_positions_against_brute_force(spark):
    import re

    from sundew.functions import patterns
    from sundew.operators import detect

    texts = ["tfn 123 456 782\nand tfn 123 456 782", "é ghp token ghp_" + "a1" * 18 + " x ghp_" + "a1" * 18 + "\n\n", "", None, "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("path", F.lit(None).cast("string"))
    got = sorted((r.id, r.rule, r.start, r.line, r.col, r.context) for r in detect.detect_rules(df, "id", "path", "text").collect())
    want = []
    for i, t in enumerate(texts):
        for rule, (pattern, keywords, _) in patterns.SECRET_RULES.items():
            if t and any(k in t.lower() for k in keywords):
                for m in re.finditer(patterns.python(pattern), t, re.ASCII):
                    line = t[: m.start()].count("\n") + 1
                    want.append((i, rule, m.start(), line, m.start() - (t.rfind("\n", 0, m.start()) + 1) + 1, t.split("\n")[line - 1]))
    assert got == sorted(want) and len({g[2] for g in got if g[0] == 0}) == 2


def test_running_mean_against_brute_force(spark):
    import random
    from datetime import timedelta

    r = random.Random(1)
    rows = [(i, r.choice(["hot", "hot", "x", None]), None if i % 17 == 0 else datetime(2026, 1, 1) + timedelta(hours=r.randrange(200)), None if i % 11 == 0 else r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, at timestamp, v double")
    got = {x.id: x["mean"] for x in evaluate.running_mean(df, "k", "at", "id", "v").collect()}
    order = lambda x: (x[2] is not None, x[2] or datetime.min, x[0])
    for row in rows:
        seen = [x[3] for x in rows if x[1] == row[1] and order(x) <= order(row) and x[3] is not None]
        assert (got[row[0]] is None) == (not seen) and (not seen or abs(got[row[0]] - sum(seen) / len(seen)) < 1e-12)
