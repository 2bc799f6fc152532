import re

import pytest

from sundew.functions import patterns, proximity
from sundew.plans import engine_queries as Q

CASES = {
    "ABN": "abn = 53 004 085 616",
    "MEDICARE": "card 2123 45670 1",
    "TFN": "tfn 123 456 782",
    "BSB": "bsb 062-001",
    "ACN": "ACN: 004 085 616",
    "PHONE": "call 0412 345 678",
    "EMAIL": "write to kim.lo@site.example",
    "DRIVER_LICENSE": "licence A123456",
    "NAME": "signed by Fiora Ashton",
}


def test_cases_of_every_type_are_looked_at(spark, tmp_path):
    rows = [(i, kind, True, text) for i, (kind, text) in enumerate(CASES.items())]
    rows += [(100 + i, kind, False, "nothing to be seen") for i, kind in enumerate(CASES)]
    rows += [(200, "EMAIL", True, CASES["PHONE"]), (201, "ADDRESS", True, "402 Pel Street"), (202, "TFN", True, None), (203, None, True, CASES["TFN"])]
    spark.createDataFrame(rows, "item_id long, pi_type string, is_actual_pi boolean, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = Q.detected_cases(spark, str(tmp_path)).collect()
    assert sorted(r.item_id for r in got) == sorted(r[0] for r in rows)
    assert {r.pi_type for r in got if r.detected} == set(CASES) and sum(r.detected for r in got) == len(CASES)


def test_contexts_with_backslashes_and_line_feeds(spark, tmp_path):
    lines = [r'say "a\"b', r"it\'s", r"'a\\' x", '"a" + "b', "plain", "a\\", 'x = "\n\\" + "y', "", "''", '""\\"', "select a\nfrom b", "a\n", "# note\nx: 1", "x\ny = test_value"]
    rows = [(100 * i + c, text, c) for i, text in enumerate(lines) for c in range(1, len(text) + 2)] + [(9001, lines[0], None), (9002, None, 3)]
    spark.createDataFrame(rows, "finding_id long, context string, col_no int").write.parquet(f"{tmp_path}/findings.parquet")
    odd = lambda s, q: sum(c == q and s[i - 1 : i] != "\\" for i, c in enumerate(s)) % 2 == 1
    want = {i: odd(text[: (c or 1) - 1], "'") or odd(text[: (c or 1) - 1], '"') for i, text, c in rows if text is not None}
    assert {r.finding_id: r.in_string for r in Q.string_context(spark, str(tmp_path)).collect()} == want
    types = {r.finding_id: r for r in Q.context_types(spark, str(tmp_path)).collect()}
    assert set(types) == set(want)
    order = dict(Q._TYPES)
    found = lambda kind, text: re.search(patterns.python(order[kind]).replace("$", r"\Z"), text, re.ASCII)
    weights = {"label": 0.8, "database": 0.6, "form": 0.6, "log": 0.4, "config": 0.3, "documentation": -0.3, "variable": -0.2}
    for i, text, _ in rows:
        if text is not None:
            assert types[i].context_type == next((k for k in order if found(k, text)), "production"), text
            assert types[i].confidence == pytest.approx(min(max(sum(v for k, v in weights.items() if found(k, text)), 0), 1))
            hits = len(re.findall(patterns.python(order["test"]), text, re.ASCII))
            strong = 0.2 * sum(w in text.lower() for w in proximity.STRONG_TEST)
            assert types[i].test_confidence == pytest.approx(min(1, min(1, hits * 0.3) + strong) if hits else 0)


def test_heads_that_are_not_plain(spark, tmp_path):
    texts = ["a", "a\0b", "é" * 10, "a" + "é" * 300, "\x01\x01b", "\x01bcd", "x" * 600 + "\0", ""]
    rows = [*enumerate(texts), (99, None)]
    spark.createDataFrame(rows, "file_id long, file_text string").write.parquet(f"{tmp_path}/files.parquet")

    def binary(head):
        try:
            head.decode()
        except UnicodeDecodeError:
            return True
        return 0 in head or sum(b < 32 and b not in (9, 10, 13) for b in head) * 10 > len(head) * 3

    got = {r.file_id: r.looks_binary for r in Q.binary_contents(spark, str(tmp_path)).collect()}
    assert got == {i: binary(t.encode()[:512]) for i, t in enumerate(texts)} and got[1] and got[3] and not got[2]


def test_addresses_of_every_host(spark, tmp_path):
    want = {
        "https://github.com/o/r.git": ("o", "r", True, True),
        "https://github.com/o/r": ("o", "r", True, True),
        "git@github.com:o/r.git": ("o", "r", False, False),
        "https://github.com/o": (None, None, False, True),
        "https://github.com/": (None, None, False, True),
        "o/r": ("o", "r", False, False),
        "https://h.example/o/r": (None, None, True, True),
    }
    rows = [*enumerate(want), (99, None)]
    spark.createDataFrame(rows, "clone_id long, url string").write.parquet(f"{tmp_path}/repositories.parquet")
    assert {r.url: (r.owner, r.name, r.valid, r.is_https) for r in Q.repository_addresses(spark, str(tmp_path)).collect()} == want
