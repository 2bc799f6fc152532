import json
from datetime import datetime

from pyspark.sql import functions as F

from sundew.operators import evaluate, pairs
from sundew.sinks import reports
from sundew.sources import config, repositories
from sundew.streaming import incremental


def test_addresses(spark):
    rows = [("https://github.com/o/r.git", ("o", "r"), True), ("git@github.com:o/r", ("o", "r"), False), ("o/r", ("o", "r"), False), ("https://github.com/o", None, False), ("https://x.example/a", None, True), ("", None, False), (None, None, None)]
    df = spark.createDataFrame([(u, v) for u, _, v in rows], "u string, valid boolean")
    got = df.select("u", repositories.owner_and_name(F.col("u")).alias("w"), repositories.valid_url(F.col("u")).alias("v"), "valid").collect()
    assert [tuple(r.w) if r.w else None for r in got] == [w for _, w, _ in rows]
    assert all(r.v == r.valid for r in got)


def test_tree(spark, tmp_path):
    for name, data in (("a.go", b"package a\n"), (".env", b"X=1"), ("bin.go", b"\0\1"), ("node_modules/x.js", b"1"), (".git/config", b"y")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    found = {r.path: r.text for r in repositories.discover(spark, str(tmp_path)).collect()}
    assert found == {"a.go": "package a\n", ".env": "X=1"}
    assert repositories.tree_stats(spark, str(tmp_path)).first().file_count == 4


def test_config(tmp_path):
    s = config.parse("scanner:\n  workers: 3 # few\n  names: [a, 'b']\nreport:\n  format: csv\n  list:\n    - x\n    - 2\n")
    assert s == {"scanner": {"workers": 3, "names": ["a", "b"]}, "report": {"format": "csv", "list": ["x", 2]}}
    config.save(config.DEFAULTS, str(tmp_path / "d" / "c.yml"))
    assert config.load(str(tmp_path / "d" / "c.yml"), {}) == config.DEFAULTS
    assert config.load(None, {"SUNDEW_SCANNER__WORKERS": "5"})["scanner"]["workers"] == 5
    assert config.problems({"report": {"format": "pdf"}, "scanner": {"min_confidence": 2}}) and not config.problems({})
    (tmp_path / "r.toml").write_text("[[rules]]\nid = 'a'\nregex = 'x+'\nkeywords = ['K']\n")
    assert config.load_rules(str(tmp_path / "r.toml")) == {"a": ("x+", ("k",), None)}


def findings(spark):
    rows = [("r", "a.go", 1, 2, "TFN", "123456782", "tfn 123456782", True, 0.9, "HIGH", False), ("r", "b<.go", 3, 1, "ACN", "1", "", False, 0.5, "LOW", True)]
    return spark.createDataFrame(rows, "repo string, file string, line int, col int, kind string, value string, context string, validated boolean, confidence double, risk_level string, is_test boolean")


def test_reports(spark, tmp_path):
    df = findings(spark)
    rows = reports.csv_rows(df, "r", "main", datetime(2026, 1, 1), context=True, metadata={"scan_id": "s", "seconds": 1.5}).collect()
    assert rows[0]["Masked Value"] == "123****82" and rows[0]["Confidence Score"] == "0.90" and rows[0]["Scan Duration (seconds)"] == "1.50"
    summary = {r.Metric: (r.Value, r.Percentage) for r in reports.summary_rows(df, "r", "m", datetime(2026, 1, 1), 2).collect()}
    assert len(summary) == 11 and summary["High Risk"] == ("1", "50.0%") and summary["Critical Risk"] == ("0", "0.0%")
    assert {r.Percentage for r in reports.summary_rows(df.limit(0), "r", "m", datetime(2026, 1, 1), 2).collect() if r.Metric == "Low Risk"} == {"0.0%"}
    log = json.loads(reports.sarif_report(df, "t", "1", ["repo"]).first().body)
    results = sorted(log["runs"][0]["results"], key=lambda r: r["ruleId"])
    assert [r["ruleId"] for r in results] == ["PI001", "PI999"] and "ruleIndex" not in results[0]
    assert len(log["runs"][0]["tool"]["driver"]["rules"]) == 12
    assert "b&lt;.go" in reports.html_page(df, "T")
    head = reports.scan_result(df, {"url": "r"}, datetime(2026, 1, 1), datetime(2026, 1, 2), {"scanned_files": 2}, "bad")
    assert head["stats"]["findings_by_type"] == {"TFN": 1, "ACN": 1} and head["error"] == "bad"
    reports.write_json(df, head, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "scan.json").read_text())["files_scanned"] == 2
    assert spark.read.json(str(tmp_path / "out" / "findings")).count() == 2
    reports.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_pairs(spark):
    rows = [("f", "A", 1), ("f", "B", 5), ("f", "B", 11), ("f", "C", 40), ("g", "A", 1), (None, "A", 1), ("f", None, 2), ("f", "A", 1)]
    df = spark.createDataFrame(rows, "file string, kind string, line int")
    got = {tuple(r) for r in pairs.co_occurrences(df, "file", "kind", "line", 10).collect()}
    assert got == {("f", "A", 1, "B", 4), ("f", "B", 5, "A", 4), ("f", "B", 11, "A", 10)}


def test_evaluation(spark):
    rows = [("d", True, True)] * 3 + [("d", True, False)] + [("d", False, True)] + [("e", False, False)]
    df = spark.createDataFrame(rows, "name string, a boolean, d boolean")
    r = evaluate.evaluate(df, "a", "d").first()
    assert (r.tp, r.fp, r.tn, r.fn) == (3, 1, 1, 1) and r.precision == 0.75 == r.recall
    e = evaluate.evaluate(df, "a", "d", "name").where("name = 'e'").first()
    assert e.precision == 0 == e.f1 and e.accuracy == 1
    assert evaluate.total(evaluate.evaluate(df, "a", "d"), evaluate.evaluate(df, "a", "d")).first().tp == 6
    b = evaluate.business_rates(spark.createDataFrame([(0, 0, 0), (8, 1, 1)], "tp long, fp long, fn long")).collect()
    assert b[0].overall == 0 and b[1].accuracy == 0.8


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a.go", "tfn 123456782"), (2, "a.go", "x")], "id long, path string, text string").write.parquet(src)
    stream = incremental.files_stream(spark, src, "id long, path string, text string")
    q = incremental.append_to(incremental.findings_stream(stream, "id", "path", "text"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["TFN"]
