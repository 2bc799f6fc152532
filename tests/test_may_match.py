import random
import re

from sundew.functions import patterns
from sundew.operators import detect, matchers


def test_no_match_is_left_out_beforehand():
    rng = random.Random(6)
    found = dict.fromkeys(patterns.MATCHERS, 0)
    compiled = {k: re.compile(patterns.python(p), re.ASCII) for k, p in patterns.MATCHERS.items()}
    parts = ["0", "04", "12", "34", "5", "123", "2123", "61", "+61", "1300", "(02)", " ", " ", "-", ".", "\t", "\n", "/", "acn", ":", "'", "A", "AB", "Fiora", "Ashton", "a@b.example", "04 12 34 56 78", "04-12-34-56-78", "0 4", "\v"]
    for _ in range(60_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 9)))
        for kind, pattern in compiled.items():
            for m in pattern.finditer(text):
                found[kind] += 1
                assert re.search(detect.MAY_MATCH, m[0]), (kind, m[0])
    assert all(found.values())


def test_phone_in_groups_of_two(spark):
    rows = [(1, "a.py", "call 04 12 34 56 78"), (2, "a.py", "call 04-12-34-56-78"), (3, "a.py", "call 04.1.2.3.4.5.6.7.8"), (4, "a.py", "at 04 12 34")]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    assert sorted(r.id for r in detect.detect(df, "id", "path", "text").where("kind = 'PHONE'").collect()) == [1, 2, 3]


def test_kernel_equals_column_expressions(spark):
    rng = random.Random(8)
    parts = ["0", "04", "12", "34", "5", "123", "2123", "61", "+61", "1300", "(02)", " ", " ", "-", ".", "\n", "/", "acn: ", "'", "AB", "Fiora ", "Ashton", "Test Data ", "a@b.example", "123 456 782", "51 824 753 556", "4428778132", "é"]
    rows = [(i, "a.py", "".join(rng.choices(parts, k=rng.randrange(0, 14)))) for i in range(4000)] + [(5000, None, None), (5001, "vendor/x.min.js", "123456782")]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    columns = ["id", "kind", "value", "start", "stop"]
    kernel = detect.detect(df, "id", "path", "text", gates=False).select(*columns).collect()
    declared = detect.detect_declared(df, "id", "path", "text").select(*columns).collect()
    assert sorted(map(tuple, kernel)) == sorted(map(tuple, declared))
    assert {r.kind for r in kernel} == set(patterns.MATCHERS)


def test_registered_matcher(spark):
    df = spark.createDataFrame([(1, "a.py", "badge QX-12 and QX-99"), (2, "a.py", "none")], "id long, path string, text string")
    matchers.register("BADGE", matchers.Matcher(r"\bQX-\d{2}\b", matchers.Check(strip="[^0-9]", never=("9",))))
    try:
        assert [(r.kind, r.value) for r in detect.detect(df, "id", "path", "text").collect()] == [("BADGE", "QX-12")]
        assert [r.value for r in detect.detect_declared(df, "id", "path", "text").collect()] == ["QX-12"]
    finally:
        del matchers.TABLE["BADGE"]
