import json
from datetime import datetime

from sundew.__main__ import main
from sundew.operators import detect
from sundew.plans import scan
from sundew.sinks import reports


def test_scan(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.go").write_text('package a\n// tax file\ntfn := "123456782"\nkey = "AKIA' + "A1" * 8 + '" // aws\n')
    (src / "b.bin").write_bytes(b"\0\1")
    head = scan.scan(spark, str(src), str(tmp_path / "out"), "repo", ("json", "csv", "sarif", "html"), datetime(2026, 1, 1))
    assert head["stats"]["findings_by_type"]["TFN"] >= 1 and head["stats"]["findings_by_type"]["AWS_ACCESS_KEY"] == 1
    assert head["stats"]["total_files"] == 2 and head["files_scanned"] == 1 and "error" not in head
    rows = spark.read.json(str(tmp_path / "out/json/findings")).collect()
    tfn = next(r for r in rows if r.kind == "TFN" and r.detector_name == "pattern-detector")
    aws = next(r for r in rows if r.kind == "AWS_ACCESS_KEY")
    assert (tfn.line, tfn.col, tfn.confidence) == (3, 9, 0.95) and (aws.line, aws.col) == (4, 8)
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == len(rows)
    body = json.loads(spark.read.json(str(tmp_path / "out/sarif")).first().body)
    assert len(body["runs"][0]["results"]) == len(rows)
    assert "Tax File Number" in (tmp_path / "out/report.html").read_text()
    bad = scan.scan(spark, str(tmp_path / "none"), str(tmp_path / "bad"))
    assert bad["error"] and json.loads((tmp_path / "bad/json/scan.json").read_text())["error"]
    assert scan.stats(spark, str(src)).first().total_files == 2
    near = scan.findings_of(spark.createDataFrame([("a.go", "mock tfn 123456782"), ("b.go", "tfn: 123456782")], "path string, text string"), rules=False, near=True)
    assert {(r.file, r.risk_level) for r in near.collect()} == {("a.go", "LOW"), ("b.go", "HIGH")}


def test_settings_reach_the_scan(spark, tmp_path):
    src = tmp_path / "src"
    (src / "deep").mkdir(parents=True)
    (src / "a.go").write_text('tfn := "123456782"\nbsb 123-456 // bad tfn 123456789\n')
    (src / "deep/b.go").write_text("abn 51 824 753 556 here\n")
    (src / ".c.go").write_text("medicare 2123456701\n")
    (src / "rules.toml").write_text('[[rules]]\nid = "ticket-id"\nregex = "T-[0-9]{4}"\ntags = ["low"]\n[allowlist]\nstopwords = ["T-0000"]\n')
    (src / "d.md").write_text("see T-1234, T-0000 and T-1234\n")

    def kinds(**settings):
        out = tmp_path / f"out{len(list(tmp_path.iterdir()))}"
        head = scan.scan(spark, str(src), str(out), "r", ("json",), datetime(2026, 1, 1), settings)
        assert "error" not in head, head
        return {(r.file, r.kind) for r in spark.read.schema(reports.SAVED).json(str(out / "json/findings")).collect()}

    every = kinds()
    assert {("a.go", "TFN"), ("deep/b.go", "ABN"), (".c.go", "MEDICARE")} <= every
    assert {f for f, _ in kinds(discovery={"exclude": ["**/deep/**"]})} == {f for f, _ in every} - {"deep/b.go"}
    assert not any(f == ".c.go" for f, _ in kinds(discovery={"include_hidden": False}))
    assert {f for f, _ in kinds(discovery={"include": ["deep/*.go"]})} == {"deep/b.go"}
    found = spark.createDataFrame([("d.md", "see T-1234, T-0000\nand T-1234")], "path string, text string")
    own = scan.findings_of(found, settings={"detectors": {"pattern": False, "rule_file": str(src / "rules.toml")}}).collect()
    assert [(r.kind, r.line, r.col, r.context, r.risk_level) for r in own] == [("SECRET_TICKET-ID", 1, 5, "see T-1234, T-0000", "LOW"), ("SECRET_TICKET-ID", 2, 5, "and T-1234", "LOW")]
    plain = spark.createDataFrame([("x.go", "v 123456789")], "path string, text string")
    on = lambda **d: [r.confidence for r in scan.findings_of(plain, settings={"detectors": {"rules": False, "context_validation": False, **d}, "scanner": {"min_confidence": 0.6}}).collect()]
    assert on() == [] and on(checksums=False) == [0.8]
    assert "no detector" in scan.scan(spark, str(src), str(tmp_path / "none"), settings={"detectors": {"pattern": False, "rules": False}})["error"]


def test_report_from_a_saved_result(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.go").write_text('tfn := "123456782"\n')
    scan.scan(spark, str(src), str(tmp_path / "out"), "repo", ("json",), datetime(2026, 1, 1))
    assert main(["report", str(tmp_path / "out/json"), "--output", str(tmp_path / "again"), "--format", "html", "csv", "sarif"]) == 0
    page = (tmp_path / "again/report.html").read_text()
    assert "123****82" in page and "123456782" not in page and "Validation rate" in page
    assert spark.read.option("header", True).csv(str(tmp_path / "again/csv")).count() == spark.read.json(str(tmp_path / "out/json/findings")).count()
    assert spark.read.json(str(tmp_path / "again/sarif")).count() == 1


def test_refused_files(spark):
    df = spark.createDataFrame([(1, "a", "x" * 50), (2, "b", "tfn 123456782"), (3, "c", None)], "id long, path string, text string")
    assert [(r.id, r.size) for r in detect.refused(df, "id", "path", "text", 20).collect()] == [(1, 50)]
    assert detect.detect(df, "id", "path", "text", max_bytes=5).count() == 0 < detect.detect(df, "id", "path", "text", max_bytes=None).count()


def test_command_line(tmp_path, capsys):
    assert main(["version"]) == 0 and "sundew" in capsys.readouterr().out
    assert main(["config", str(tmp_path / "c.yml")]) == 0 and (tmp_path / "c.yml").exists()
