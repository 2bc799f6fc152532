import pytest

from sundew.llm import source_files as S

NOTICE = "// Code generated by xgen v1. DO NOT EDIT.\n"
BODY = "function add(a, b) {\n  return a + b;\n}\n"
LICENCE = "".join(f"// Licence line {i}.\n" for i in range(40))


@pytest.mark.parametrize("head", [LICENCE, "/*\n" + " words of a licence\n" * 30 + "*/\n\n", "#!/usr/bin/env node\n", "<?php\n", "'use strict';\n", '#!/usr/bin/env node\n"use strict"\n\n' + LICENCE, "<?php\ndeclare(strict_types=1);\n"])
def test_notices_behind_long_heads(head):
    assert S.is_generated("src/a.js", head + NOTICE + BODY)
    assert not S.is_generated("src/a.js", head + BODY) and not S.is_generated("src/a.js", head + BODY + NOTICE)
    assert not S.is_generated("src/a.js", head + f"const s = '{NOTICE.strip()}';\n" + BODY)


def test_library_notice_behind_a_shebang_and_nul_anywhere(spark):
    note = "# fastlib 2.1.0\n# Copyright (c) 2021 Someone. Released under the Apache License.\n"
    rows = [(1, "h.example/o/r", "a.py", False, "#!/usr/bin/env python\n" + note + "x = 1\n"), (2, "h.example/o/r", "b.py", False, "x = 1\n" * 200 + "\0"), (3, "h.example/o/r", "c.py", False, "x = 1\n" * 200)]
    df = spark.createDataFrame(rows, "file_id long, repo_url string, rel_path string, is_binary boolean, file_text string")
    assert {r.file_id: r.reason for r in S.not_hand_written(df).collect()} == {1: "vendored", 2: "data"}
