import json

from sundew.operators import nested


def result(uris, **more):
    return {"ruleId": "R", "locations": [{"physicalLocation": {"artifactLocation": {"uri": u}}} for u in uris], **more}


def test_unwrap():
    body = json.dumps({"runs": []})
    for text in (body, "﻿" + body, json.dumps(body), json.dumps(json.dumps(body)), "```json\n" + body + "\n```", f"[{body}]", f"  {body}\n"):
        assert nested.unwrap(text) == {"runs": []}
    for text in (None, "", "  ", body[:-1], body + "x", "[]", "3", "null", '"text"', "[1, 2]"):
        assert nested.unwrap(text) is None


def test_any_depth_of_wrapping():
    text = json.dumps({"runs": []})
    for _ in range(14):
        text = json.dumps(text)
    assert nested.unwrap(text) == {"runs": []}


def test_subtypes_are_typed_and_keep_the_rest(spark):
    place = {"physicalLocation": {"artifactLocation": {"uri": "a", "index": 3}, "region": {"startLine": 4, "startColumn": "x"}}, "id": 7}
    body = {"runs": [{"results": [{"ruleId": "R", "message": {"text": "m", "markdown": "*m*"}, "locations": [place, "odd"], "extra": [1]}, {"locations": [None]}], "columnKind": "u"}]}
    df = spark.createDataFrame([(1, json.dumps(body))], "report_id long, body string")
    nodes = nested.shred(df, "report_id", "body", rest=True)
    at = nested.subtype_table(nodes, "location", has=["+uri"]).first()
    assert (at.record_id, at.run_no, at.result_no, at.location_no, at.uri, at.line, at.column) == (1, 0, 0, 0, "a", 4, None)
    assert json.loads(at.rest) == {"id": 7, "physicalLocation": {"artifactLocation": {"index": 3}, "region": {"startColumn": "x"}}}
    found = nested.subtype_table(nodes, "result", has=["locations:array"]).first()
    assert (found.rule, found.message) == ("R", "m") and json.loads(found.rest) == {"extra": [1], "locations": {"1": "odd"}, "message": {"markdown": "*m*"}}
    assert sorted(r.subtype for r in nested.routed(nodes).collect()) == ["file_location", "located_result", "unlocated_result"]
    assert json.loads(nodes.where("kind = 'run'").first().rest) == {"columnKind": "u"}
    assert dict(nested.subtype_table(nodes, "location").dtypes)["line"] == "bigint"


def test_items(spark):
    bare = result(["x"])
    bodies = [
        (1, json.dumps({"runs": [{"results": [result(["a", "b"]), None, result([])]}, None, {"results": {"locations": None}}]})),
        (2, json.dumps({"runs": {"results": {**bare, "locations": bare["locations"][0]}}})),
        (3, json.dumps({"runs": [{"results": [{"locations": [None, {"logicalLocation": {"name": "n"}}, {"physicalLocation": 3}]}]}]})),
        (4, '{"runs": [{"results": [{"locations": ['),
        (5, None),
        (6, json.dumps({"runs": [{"results": None}, {}, {"results": []}]})),
        (None, json.dumps({"runs": [{"results": [result(["a"])]}]})),
    ]
    df = spark.createDataFrame(bodies, "report_id long, body string")
    got = sorted(map(tuple, nested.sarif_items(df).collect()))
    assert got == sorted(
        [
            ("result", 1, 0, 0, 0, "a"), ("result", 1, 0, 0, 1, "b"), ("result", 1, 0, 2, -1, ""), ("result", 1, 2, 0, -1, ""),
            ("result", 2, 0, 0, 0, "x"), ("result", 3, 0, 0, 1, ""), ("result", 3, 0, 0, 2, ""),
        ]
    )
    variants = {r.variant for r in nested.shred(df, "report_id", "body").where("kind = 'result'").collect()}
    assert "locations:object,fixes:absent,+rule" in variants and "locations:null,fixes:absent" in variants
    assert nested.subtype_table(nested.shred(df, "report_id", "body"), "result", ["locations:array"], ["+rule"]).count() == 1


SCHEMA = """result_id long, findings array<struct<pi_type string, match_text string, file_path string, line_no int, col_no int,
    risk_level string, confidence double, validation struct<validated boolean, validation_error string>>>,
    stats struct<total_files int, skipped_files int, findings_by_type map<string, int>, findings_by_risk map<string, int>>"""


def test_native_records(spark):
    f = ("TFN", "1", "f", 1, 2, "LOW", 0.5, (False, "bad"))
    rows = [
        (1, [f, None, (None, None, None, None, None, None, None, None)], (1, 0, {"A": 1, "B": 2}, None)),
        (2, [], None),
        (3, None, (1, 0, {}, {"LOW": 1})),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "report_id long, body string")
    assert sorted(map(tuple, nested.nested_items(none, df).collect())) == [
        ("finding", 1, -1, 0, -1, "TFN"), ("finding", 1, -1, 2, -1, ""), ("stat", 1, -1, -1, -1, "A"), ("stat", 1, -1, -1, -1, "B"),
    ]
    assert [r.variant for r in nested.finding_table(df).orderBy("position").collect()] == ["failed", "plain"]
