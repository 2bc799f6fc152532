from datetime import datetime

from pyspark.sql import functions as F

from sundew.llm import history as H
from sundew.llm import queries as Q

ROWS = [
    (1, 1, "https://h.example/o/r", "src/a.py", 10, "123 456 782"),
    (2, 2, "https://h.example/o/r", "src/a.py", 11, "123456782"),
    (3, 2, None, "src/a.py", 10, "123 456 782"),
    (4, 2, "https://h.example/o/r", None, 10, "123 456 782"),
    (5, 2, "https://h.example/o/r", "src/a.py", None, "Fiora Ashton"),
    (6, 2, "https://h.example/o/r", "src/a.py", 10, None),
    (7, 2, None, None, None, None),
    (8, 2, None, None, None, None),
]


def test_rows_with_nulls_are_accepted(spark, tmp_path):
    findings = spark.createDataFrame(ROWS, "finding_id long, scan_id long, repo_url string, file_path string, line_no int, match_text string")
    scans = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 2))], "scan_id long, scan_started timestamp")
    findings.write.parquet(f"{tmp_path}/findings.parquet")
    scans.write.parquet(f"{tmp_path}/scans.parquet")
    rows = {r.finding_id: r for r in Q.p6_accepted(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 3, 4, 5, 6, 7, 8]
    assert None not in rows[1] and all(tuple(rows[i])[1:] == (None, None, None) for i in range(3, 9))
    assert [r.finding_id for r in Q.p6_found(spark, str(tmp_path)).collect()] == [2]
    table = H.pivot_table(findings, scans)
    kept = H.accept(table.where(F.col("finding_id") > 2), table.where(F.col("finding_id") <= 2))
    assert sorted(r.finding_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8]
