import random

import numpy as np

from sundew.llm import source_files as S

rng = random.Random(5)
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo") for b in ("ran", "sel", "tik", "mur", "dan", "pol")]


def code(n=30):
    return "".join(f"def {rng.choice(WORDS)}_{rng.choice(WORDS)}({rng.choice(WORDS)}):\n    return {rng.choice(WORDS)}.{rng.choice(WORDS)}({rng.randrange(999)})\n" for _ in range(n))


def test_generated():
    body = code(8)
    for head in ("# Code generated by xgen v1. DO NOT EDIT.\n", "// AUTOGENERATED FILE\n", "/* <auto-generated>\n * tool\n */\n", "# Copyright 2025\n\n# @generated SignedSource<<ab>>\n", "// Diese Datei wurde automatisch erzeugt (x)\n", "// This file was automatically created by the x compiler; local changes will be lost.\n", "# source: a.proto\n"):
        assert S.is_generated("src/a.py", head + body), head
    for head in ("BANNER = 'Code generated by x. DO NOT EDIT.'\n", "// prints the report generated by finance; do not edit totals by hand\n", "# Copyright 2025 the X authors. Internal use only.\n", ""):
        assert not S.is_generated("src/generated_report.py", head + body), head
    for path in ("package-lock.json", "a/go.sum", "poetry.lock", "web/yarn.lock", "target/generated-sources/x/Y.java", "a/b_pb2.py"):
        assert S.is_generated(path, "x\n"), path
    assert S.is_generated("p.go", "".join(f"  case {i}: goto yy{i * 3}; case {i + 900}: goto yy{i};\n" for i in range(20)))


def test_minified_and_data():
    mini = "!function(e,t){" + "if(e&&p>34)return;b.gs=function(){return 74};" * 20 + "}(this);\n"
    assert S.is_minified("/* x */\n" + mini) and not S.is_minified(code())
    assert not S.is_minified("var q = `SELECT " + ", ".join(WORDS * 3) + "`\n" + code(4))
    assert S.is_data("ROWS = [\n" + "  0xb0,0x04,0xfe,0x53,0x07,0x8e,\n" * 20 + "]\n")
    assert S.is_data("id,step,amount\n" + "".join(f"{i},{w},{i}.25\n" for i, w in enumerate(WORDS)))
    assert S.is_data("export default 'data:image/png;base64," + "aB3/" * 100 + "';\n")
    assert not S.is_data("WEIGHTS = [1, 4, 3, 7, 5]\n" + code()) and not S.is_data(code()) and not S.is_data("x")


def test_files(spark):
    library, own = code(), code()
    note = "# fastlib 2.1.0\n# Copyright (c) 2021 Someone. Released under the Apache License.\n"
    rows = [(1, "https://h.example/fastlib-project/fastlib", "src/fastlib.py", False, note + library)]
    rows += [(10 + i, f"https://h.example/o{i}/r{i}", f"src/util/helper{i}.py", None, library.replace("    ", "\t").replace("\n", "\r\n")) for i in range(3)]
    rows += [(20, "https://h.example/o/r9", "vendor/fastlib.py", False, note + code(2)), (21, "https://h.example/o/r1", "src/a.py", False, own), (21, "https://h.example/o/r1", "src/a.py", False, own)]
    rows += [(30, "https://h.example/o/r1", "a.js", True, None), (31, "https://h.example/o/r1", "a.png", True, None), (32, None, None, None, ""), (33, None, None, None, None)]
    rows += [(40 + i, f"https://h.example/o/r{i}", "src/x.py", False, "x = 1\n") for i in range(5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, repo_url string, rel_path string, is_binary boolean, file_text string, reason string")
    got = {r.file_id: r.reason for r in S.not_hand_written(df).collect()}
    assert got == {10: "vendored", 11: "vendored", 12: "vendored", 20: "vendored", 30: "data"}
    assert S.not_hand_written(df.limit(0)).count() == 0


def test_copies_within_one_owner_are_its_own(spark):
    text = code()
    near = [text.replace("return", "return ", 1) + f"x{i} = {i}\n" for i in range(4)]
    rows = [(i, f"https://h.example/one/r{i}", f"a{i}.py", False, text) for i in range(5)]
    df = spark.createDataFrame(rows, "file_id long, repo_url string, rel_path string, is_binary boolean, file_text string")
    assert S.not_hand_written(df).count() == 0
    rows = [(i, f"https://h.example/o{i}/r", f"a{i}.py", False, t) for i, t in enumerate(near)]  # no two alike
    df = spark.createDataFrame(rows, "file_id long, repo_url string, rel_path string, is_binary boolean, file_text string")
    assert {r.file_id for r in S.not_hand_written(df).collect()} == {0, 1, 2, 3}


def test_fingerprints_against_brute_force():
    r = np.random.default_rng(2)
    texts = [S.mix(r.integers(0, 6, n).astype(np.uint64)) for n in (0, 5, 23, 24, 25, 31, 32, 33, 200, 0, 90)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    of, prints = S.fingerprints(np.concatenate(texts), starts)
    for i, t in enumerate(texts):
        h = []
        for k in range(len(t) - S.K + 1):
            total = sum(int(c) * pow(int(S.BASE), j, 1 << 64) for j, c in enumerate(t[k : k + S.K])) % (1 << 64)
            h.append(int(S.mix(np.array([total], np.uint64))[0]))
        want = {min(h[k : k + S.W]) for k in range(len(h) - S.W + 1)} if len(h) > S.W else set(h)
        assert sorted(prints[of == i].tolist()) == sorted(want)
    alone = [set(S.fingerprints(t, np.array([0, len(t)]))[1].tolist()) for t in texts]
    assert alone == [set(prints[of == i].tolist()) for i in range(len(texts))]


def test_repository_key(spark):
    rows = [("https://H.example/O/r.git",), ("git@h.example:o/r",), ("h.example/o/r/",)]
    assert {r.k for r in spark.createDataFrame(rows, "u string").select(S.repository_key(S.F.col("u")).alias("k")).collect()} == {"h.example/o/r"}
