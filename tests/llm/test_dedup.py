import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sundew.llm import history as H
from sundew.llm import variants as V
from sundew.llm.words import one_slip

GROUPS = [
    ["123 456 782", "123-456-782", "'123456782'", "123\t456\t782 "],
    ["bsb=396-215; account=66881925", "Account : 66881925 ;  BSB : 396215", '{"account": "66881925", "bsb": "396215"}', "'bsb'='396215','account'='6688-1925'", "BSB: 396 215, Account: 6688 1925"],
    ["Fiora Ashton", "ASHTON, Fiora", "<fiora  ashton>", "Ashton,Fiora;"],
    ["402 Pel Street, Sable Point WA 6294", "402  PEL  STREET,\nSABLE  POINT WA 6294", "402 Pel Street; Sable Point, WA, 6294"],
    ["a.b@c.example", "<A.B@C.EXAMPLE>"],
    ["b.a@c.example"], ["321654987"], ["bsb=215-396; account=66881925"], ["Fiora Ashtno"],
]


def test_canonical_groups(spark):
    rows = [(t, i) for i, g in enumerate(GROUPS) for t in g]
    got = spark.createDataFrame(rows, "t string, g int").select("g", V.canonical(F.col("t")).alias("c"), V.invariant(F.col("t")).alias("h")).collect()
    for a in got:
        for b in got:
            assert (a.c == b.c) == (a.g == b.g)
            assert a.g != b.g or a.h == b.h


def test_copies(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        g = rng.randrange(len(GROUPS))
        rows.append((i * 3 + 1, rng.choice(["TFN", " tfn", "Tfn"]), rng.choice(GROUPS[g]), g))
    rows += [(5000, None, "x", -1), (5001, "TFN", None, -1), (5002, "ABN", GROUPS[0][0], 100), (5003, "TFN", "", 200), (5004, "tfn", "--", 200)]
    df = spark.createDataFrame(rows, "id long, kind string, text string, a int")
    first: dict = {}
    for i, _, _, g in rows:
        if g >= 0:
            first.setdefault(g, i)
    want = sorted((first[g], i) for i, _, _, g in rows if g >= 0 and first[g] != i)
    assert sorted(map(tuple, V.copies(df, "id", "kind", "text").collect())) == want
    groups = {r.group_id: r.copies for r in V.collapsed(df, "id", "kind", "text").collect()}
    assert groups == {first[g]: sum(x[3] == g for x in rows) for g in first}
    assert V.copies(df.limit(0), "id", "kind", "text").count() == 0


@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_one_slip(a, b):
    def near(x):
        out = {x}
        for i in range(len(x) + 1):
            out |= {x[:i] + c + x[i:] for c in "abc"}
            out |= {x[:i] + x[i + 1 :]} | {x[:i] + c + x[i + 1 :] for c in "abc" if i < len(x)}
            if i + 1 < len(x):
                out.add(x[:i] + x[i + 1] + x[i] + x[i + 2 :])
        return out

    assert one_slip(a, b) == (b in near(a))


def make(n, seed):
    rng = random.Random(seed)
    names = ["Fiora Ashton", "Ashton, Fiora", "Fioar Ashton", "Fiora Ashtn", "Fiona Ashtun", "a.b@c.example", "a.c@c.example", "A-B@C.EXAMPLE", "402 Pel Street, WA 6294", "402 Pal Street, WA 6294", "403 Pel Street, WA 6294",
             "123456782", "123 456 782", "123456783", "ghp_abcdef", "ghp_abcdeg"]
    files = ["src/a.py", "./src/a.py", "src\\a.py", "/tmp/c-1/repo/src/a.py", "src/b.py"]
    rows = [(i, rng.randrange(30), "https://h.example/o/repo" if i % 5 else "https://h.example/o/other", rng.choice(files), rng.randrange(1, 120), rng.choice(names)) for i in range(n)]
    return rows + [(n, 1, None, "a", 1, "x"), (n + 1, 1, "r", None, 1, "x"), (n + 2, 1, "r", "a", None, "x"), (n + 3, 1, "r", "a", 1, None)]


def slip_apart(kind, a, b):
    """Do two canonical forms differ by exactly one slip?  Names are compared part by part, whatever the order."""
    if kind != 1:
        return a != b and one_slip(a, b)
    x, y = a.split(" "), b.split(" ")
    for part in list(x):
        if part in y:
            x.remove(part)
            y.remove(part)
    return len(x) == len(y) == 1 and one_slip(x[0], y[0])


def brute(spark, rows, starts):
    df = spark.createDataFrame(rows, "finding_id long, scan_id long, repo_url string, file_path string, line_no int, match_text string")
    keyed = df.dropna().select("*", V.canonical(F.col("match_text")).alias("c"), H.file_key(F.col("file_path"), F.col("repo_url")).alias("f")).collect()
    kind = lambda t: 2 if "@" in t else 3 if "Street" in t else 1 if " " in t and t[0].isalpha() else 0
    digits = lambda t: "".join(filter(str.isdigit, t))
    out = set()
    for y in keyed:
        for x in keyed:
            if (starts[x.scan_id], x.finding_id) < (starts[y.scan_id], y.finding_id) and (x.repo_url, x.f) == (y.repo_url, y.f) and abs(x.line_no - y.line_no) <= 25:
                k = kind(x.match_text)
                if x.c == y.c or (k and k == kind(y.match_text) and digits(x.c) == digits(y.c) and slip_apart(k, x.c, y.c)):
                    out.add(y.finding_id)
                    break
    return df, out


@pytest.mark.parametrize("seed", [1, 2])
def test_found_before_and_batches(spark, seed, tmp_path):
    rows = make(400, seed)
    starts = {i: datetime(2026, 1, 1) + timedelta(hours=(i * 7) % 30 // 2) for i in range(30)}
    df, want = brute(spark, rows, starts)
    scans = spark.createDataFrame(list(starts.items()), "scan_id long, scan_started timestamp")
    table = H.pivot_table(df, scans)
    assert {r.finding_id for r in H.found_before(table, table).collect()} == want
    seen = H.SeenTable(spark, str(tmp_path / "seen"))
    kept = set()
    at = sorted(set(starts.values()))
    for lo, hi in zip([at[0], at[5], at[9]], [at[5], at[9], at[-1] + timedelta(hours=1)]):
        ids = df.join(scans, "scan_id").where((F.col("scan_started") >= lo) & (F.col("scan_started") < hi)).select("finding_id")
        batch = table.join(ids, "finding_id", "left_semi")
        kept |= {r.finding_id for r in seen.accepted(batch).collect()}
        seen.append(batch)
    assert kept == {r.finding_id for r in table.collect()} - want
    assert H.found_before(table.limit(0), table).count() == 0 == H.found_before(table, table.limit(0)).count()


def findings(spark, rows):
    return spark.createDataFrame(rows, "finding_id long, scan_id long, repo_url string, file_path string, line_no int, match_text string")


def test_drift_chain_and_late_batch(spark, tmp_path):
    scans = spark.createDataFrame([(i, datetime(2026, 1, 10 + i)) for i in range(4)] + [(9, datetime(2026, 1, 1)), (8, None)], "scan_id long, scan_started timestamp")
    batch = lambda *rows: H.pivot_table(findings(spark, list(rows)), scans)
    seen = H.SeenTable(spark, str(tmp_path / "seen"))
    kept = []
    for i, line in enumerate((10, 30, 50)):  # each within reach of the one before only
        b = batch((i, i, "r/o/x", "a", line, "123456782"))
        kept += [r.finding_id for r in seen.accepted(b).collect()]
        seen.append(b)
    assert kept == [0]
    late = batch((7, 9, "r/o/x", "a", 10, "123 456 782"), (8, 9, "r/o/y", "a", 10, "123 456 782"), (5, 8, "r/o/y", "a", 11, "123456782"))
    assert [r.finding_id for r in seen.accepted(late).collect()] == [8]


def test_lookup_reads_the_buckets_of_the_batch_only(spark, tmp_path):
    scans = spark.createDataFrame([(1, datetime(2026, 1, 1))], "scan_id long, scan_started timestamp")
    seen = H.SeenTable(spark, str(tmp_path / "seen"))
    seen.append(H.pivot_table(findings(spark, [(i, 1, f"h/o/r{i}", "a", 1, f"n{i}") for i in range(50)]), scans))
    one = H.pivot_table(findings(spark, [(99, 1, "h/o/r7", "a", 1, "n7")]), scans)
    plan = seen.rows(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and seen.rows(one).count() <= 3 < seen.rows().count() == 50
    assert seen.accepted(one).count() == 0


def test_slips_as_columns(spark):
    words = ["", "a", "ab", "ba", "abc", "acb", "abd", "bc", "abcd", "badc", "ana li", "ana il", "ali na", "ana lie", "ann lie", "anna bo li", "ana bo li", "ana bo il", "li"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", H.slip_apart(F.col("a"), F.col("b")).alias("s")).collect():
        assert bool(r.s) == slip_apart(1 if " " in r.a + r.b else 0, r.a, r.b), r
