import re

import pytest
from pyspark.sql import functions as F

from sundew.functions import checksums, masking, patterns, proximity, spans
from sundew.operators import context, detect, discovery

GOLDEN = {
    "TFN": (["123456782", "123 456 782", "876543210", "000000000"], ["123456789", "12345678", "1234567890", "12345678a", ""]),
    "ABN": (["33051775556", "48123123124", "88000014675"], ["12345678901", "1"]),
    "MEDICARE": (["2123456701", "2123456701/1", "3123456711"], ["1123456701", "7123456701", "2123456789"]),
    "BSB": (["062-000", "013-006", "034-002"], ["060-000", "061-000", "068-000"]),
    "ACN": (["004028077", "009661901"], ["004028078"]),
}


@pytest.mark.parametrize("kind", GOLDEN)
def test_checksums(spark, kind):
    good, bad = GOLDEN[kind]
    rows = [(v, True) for v in good] + [(v, False) for v in bad]
    df = spark.createDataFrame(rows, "v string, want boolean").select("want", checksums.CHECKS[kind](F.col("v")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_registry(spark):
    df = spark.createDataFrame([("062000", "BSB"), (None, "TFN"), ("x", "EMAIL")], "v string, k string")
    got = df.select(checksums.valid(F.col("k"), F.col("v")).alias("ok"), checksums.normalized(F.col("k"), F.col("v")).alias("n"), checksums.confidence(F.col("k"), F.col("v")).alias("c"), checksums.any_valid(F.col("v")).alias("a")).collect()
    assert [tuple(r) for r in got] == [(True, "062-000", 0.95, "BSB"), (None, None, 0.8, None), (None, "", 0.8, None)]


def test_dialect(spark):
    text = "é123 456 782 Haus Schüler a\rb"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.regexp_extract_all("t", F.lit(patterns.java(patterns.MATCHERS["TFN"])), F.lit(0)).alias("x"), F.col("t").rlike(patterns.java("a.b")).alias("y")).first()
    assert got.x == ["123 456 782"] and got.y
    assert re.findall(patterns.python(patterns.MATCHERS["TFN"]), text, re.ASCII) == ["123 456 782"]


def test_spans_and_positions(spark):
    text = "ab 12\n34 cd\n\n56"
    df = spark.createDataFrame([(text,), ("",), (None,), ("none",)], "t string")
    rows = [r.s for r in df.select(spans.spans(F.col("t"), "[0-9]+").alias("s")).collect()]
    assert [(x.value, x.start, x.stop) for x in rows[0]] == [(m[0], m.start(), m.end()) for m in re.finditer("[0-9]+", text)]
    assert rows[1] == [] and rows[2] is None and rows[3] == []
    where = df.limit(1).select(spans.line_of(F.col("t"), F.lit(13)).alias("line"), spans.column_of(F.col("t"), F.lit(13)).alias("col"), spans.line_window(spans.lines(F.col("t")), F.lit(2), 1, 9).alias("w")).first()
    assert (where.line, where.col, where.w) == (4, 1, text)


TEXTS = [
    (1, "a.go", 'acn: "123456780" and acn: 123456780'),
    (2, "a.go", "company ACN 004 085 616\nphone 0412 345 678, tfn 123-456-782 and abn 33 051 775 556"),
    (3, "a.go", "mail a.b@c.example from Fiora Ashton, licence A123456"),
    (4, "x_test.go", "// example: tfn 123456782"),
    (5, "a.go", "// example: tfn 123456782"),
    (6, "a.go", "stub tfn 123456782"),
    (7, "vendor/a.go", "tfn 123456782"),
    (8, "a.go", None),
    (9, "a.go", ""),
    (10, None, "medicare 2123 45670 1 é123456782ü"),
    (11, "a.go", "12345678901 " * 300),
]


def test_detect_equals_its_declared_form(spark):
    df = spark.createDataFrame(TEXTS, "id long, path string, text string")
    got = detect.detect(df, "id", "path", "text", gates=False, whole_path=True, min_confidence=0).select("id", "kind", "value", "start", "stop")
    want = detect.detect_declared(df.where("id <> 7"), "id", "path", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_detect(spark):
    df = spark.createDataFrame(TEXTS, "id long, path string, text string")
    by = {}
    for r in detect.detect(df, "id", "path", "text", whole_path=True).collect():
        by.setdefault(r.id, []).append(r)
    assert sorted(r.kind for r in by[1]) == ["ACN", "TFN", "TFN"]
    assert {r.kind for r in by[2]} == {"ACN", "PHONE", "TFN", "ABN"}
    assert {r.kind for r in by[3]} == {"EMAIL", "NAME", "DRIVER_LICENSE"}
    assert set(by) == {1, 2, 3, 10, 11}  # gates, excluded folder, null and empty texts
    tfn = next(r for r in by[2] if r.kind == "TFN")
    assert (tfn.line, tfn.col, tfn.validated, tfn.confidence, tfn.risk_level) == (2, 25, True, 0.95, "HIGH")
    assert len(by[11]) == 300
    kept = context.validated(detect.detect(df, "id", "path", "text", whole_path=True))
    assert {(r.kind, r.confidence) for r in kept.where("id = 2").collect()} == {("ACN", 0.8), ("PHONE", 0.95), ("TFN", 0.95), ("ABN", 0.95)}


def test_rules(spark):
    df = spark.createDataFrame([(1, "a.py", "aws AKIA" + "A1" * 8), (2, "a.py", "AKIB" + "A1" * 8), (3, "sample.py", "tfn 123456789 tfn 123456782"), (4, None, None)], "id long, path string, text string")
    got = {(r.id, r.kind, r.value, r.risk_level, r.context_modifier) for r in detect.detect_rules(df, "id", "path", "text").collect()}
    assert got == {(1, "AWS_ACCESS_KEY", "AKIA" + "A1" * 8, "HIGH", 1.0), (3, "TFN", "123456782", "MEDIUM", 0.3)}
    kinds = spark.createDataFrame([("my-tfn",), ("slack-hook",), ("some-card",)], "r string").select(detect.rule_kind(F.col("r")).alias("k")).collect()
    assert [r.k for r in kinds] == ["TFN", "SECRET_SLACK-HOOK", "CREDIT_CARD"]


def test_masking(spark):
    rows = [("123456782", "TFN", "123****82"), ("2123456701", "MEDICARE", "21******01"), ("4111111111111111", "CREDIT_CARD", "*" * 12 + "1111"), ("john@x.test", "EMAIL", "jo***@x.test"),
            ("jo@x.test", "EMAIL", "j*******t"), ("0412345678", "PHONE", "0412****78"), ("ab", "X", "**"), ("", "X", ""), ("abc", "X", "a*c"), (None, "X", None)]
    df = spark.createDataFrame(rows, "v string, k string, want string")
    assert all(r.got == r.want for r in df.select("want", masking.masked(F.col("v"), F.col("k")).alias("got")).collect())


def test_discovery(spark):
    rows = [("src/a.go", 1, True), ("a_test.go", 1, False), ("test/a.go", 1, False), ("x/vendor/a.go", 1, False), (".env", 1, True), ("Makefile", 1, True), ("a.exe", 1, False), ("a.go", 1 << 30, False), ("web\\app.ts", 1, True)]
    df = spark.createDataFrame(rows, "p string, n long, want boolean")
    assert all(r.got == r.want for r in df.select("want", discovery.included(F.col("p"), F.col("n")).alias("got")).collect())
    bins = [(b"abc\n", False), (b"a\0b", True), (b"\xff\xfe", True), (b"\x01" * 4 + b"abc", True), (b"", False), ("ü".encode(), False), (b"a" * 511 + "ü".encode(), True)]
    df = spark.createDataFrame([(bytearray(b), w) for b, w in bins], "c binary, want boolean")
    assert all(r.got == r.want for r in df.select("want", discovery.binary(F.col("c")).alias("got")).collect())


def test_proximity(spark):
    df = spark.createDataFrame([("tfn: 123456782",), ("mock tfn 123456782",), ("SELECT a FROM t WHERE id = 123456782",), ("x 123456782",)], "t string")
    at = F.instr("t", F.lit("123456782")) - 1
    rows = df.select(proximity.analysis(F.col("t"), F.lit("123456782"), at, at + 9).alias("a")).select("a.*").collect()
    assert [(r.context, r.score) for r in rows] == [("label", 0.9), ("test", 0.1), ("database", 0.8), ("production", 0.8)]
    assert rows[1].reason == "mock data indicator"


def test_slices_are_bounded_and_whole():
    import pyarrow as pa

    from sundew.session import slices

    texts = ["a" * 10, None, "b" * 100, "", "c" * 5, "d" * 5, "e" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = [p.column(1).to_pylist() for p in slices(batch, 1, 3, 12)]
    assert sum(parts, []) == texts and all(len(p) <= 3 and (len(p) == 1 or sum(len(x or "") for x in p) <= 12) for p in parts)
    assert list(slices(batch.slice(0, 0), 1)) == []
