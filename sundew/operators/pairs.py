"""Findings near each other: co-occurrence within a file and a distance, without pairs of all with all.

Lines are cut in ranges of the window's width; each finding meets only those of its own and the neighbouring ranges.
Per file, range and type the findings are first reduced to distinct lines, so a hot file's repeated lines count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_occurrences(findings: DataFrame, file: str, kind: str, line: str, window: int = 10) -> DataFrame:
    """(file, kind, line, other_kind, distance): per finding line and other type the nearest line of it within the window.

    Rows with a null file, type or line have none.  A type doesn't co-occur with itself.
    """
    at = (
        findings.where(F.col(file).isNotNull() & F.col(kind).isNotNull() & F.col(line).isNotNull())
        .select(F.col(file).alias("file"), F.col(kind).alias("kind"), F.col(line).cast("bigint").alias("line"))
        .distinct()
    )
    width = max(window, 1)
    own = at.withColumn("range", F.floor(F.col("line") / width))
    near = at.select(
        "file",
        F.col("kind").alias("other_kind"),
        F.col("line").alias("other_line"),
        F.explode(F.sequence(F.floor((F.col("line") - window) / width), F.floor((F.col("line") + window) / width))).alias("range"),
    )
    distance = F.abs(F.col("line") - F.col("other_line"))
    met = own.join(near, ["file", "range"]).where((F.col("kind") != F.col("other_kind")) & (distance <= window))
    return met.groupBy("file", "kind", "line", "other_kind").agg(F.min(distance).alias("distance"))


def detected_cases(cases: DataFrame, findings: DataFrame, case_id: str, kind: str) -> DataFrame:
    """Cases with a flag whether a finding of their own type was made in them."""
    hits = findings.select(F.col(case_id).alias("_case"), F.col(kind).alias("_kind")).distinct()
    joined = cases.join(hits, (cases[case_id] == hits["_case"]) & (cases[kind] == hits["_kind"]), "left")
    return joined.withColumn("detected", F.col("_case").isNotNull()).drop("_case", "_kind")


def expected_against_found(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both sides with their outcome, by one aggregation instead of a full outer join: TP (both), FN (expected only), FP (found only)."""
    e = expected.select(*keys).withColumns({"_e": F.lit(1), "_f": F.lit(0)})
    f = found.select(*keys).withColumns({"_e": F.lit(0), "_f": F.lit(1)})
    both = e.unionByName(f).groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_f").alias("_f"))
    outcome = F.when((F.col("_e") == 1) & (F.col("_f") == 1), "TP").when(F.col("_e") == 1, "FN").otherwise("FP")
    return both.select(*keys, outcome.alias("outcome"))
