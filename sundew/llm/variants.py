"""Duplicates hidden by formatting: progressive partition refinement (JVM expressions only).

Rows are first collapsed to distinct spellings (map-side combined counts).  Spellings are split into classes by cheap
invariants, the stripped length and the letter histogram, which no change of spacing, case, punctuation or field order
can alter.  Only classes with several spellings get the costlier key, the canonical form.  Groups are aggregated, never
collected; the join back to rows is an equi-join on 128 hash bits whose hot keys adaptive execution splits.

Cases: rows with a null key field have no copies; two empty (or all-punctuation) texts of one type are copies of each
other; repeated ids count as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Letters with the separators and wrappers that a person's or thing's name may have.
NAME_SHAPE = r"""^[\p{L}\s,;'"<>().\[\]-]+$"""
#: One segment of a key-value record: a label, then an equals sign or colon.
FIELD_SHAPE = r"""^[^\p{L}\p{N}]*[\p{L}_][\p{L}_ ]*['"]?\s*[=:]"""


def stripped(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), NOT_WORD, "")


def canonical(text: Column) -> Column:
    """The costly key: equal for texts that differ only in white space, case, punctuation or the order of fields.

    Key-value records sort their fields, names sort their parts, all else keeps its order.
    """
    segments = F.filter(F.split(text, r"[;,{}\n]"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    record = (F.size(segments) >= 2) & F.forall(segments, lambda s: s.rlike(FIELD_SHAPE))
    fields = F.array_join(F.array_sort(F.transform(segments, stripped)), "|")
    parts = F.filter(F.split(F.lower(text), NOT_WORD), lambda s: s != "")
    return F.when(record, fields).when(text.rlike(NAME_SHAPE), F.array_join(F.array_sort(parts), " ")).otherwise(stripped(text))


def invariant(text: Column) -> Column:
    """The cheap key: a hash of stripped length and letter histogram (as the sorted letters)."""
    plain = stripped(text)
    return F.xxhash64(F.length(plain), F.array_sort(F.split(plain, "")))


def refine(df: DataFrame, id_column: str, type_column: str, text_column: str) -> DataFrame:
    """(spelling_1, spelling_2, group_id, copies, spellings): one row per distinct spelling of a group.

    ``group_id`` is the least id of the group, ``copies`` its number of rows.
    """
    kind = stripped(F.col(type_column))
    base = df.where(F.col(type_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), kind.alias("kind"), F.col(text_column).alias("text")
    )
    spellings = base.groupBy("kind", "text").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = spellings.select(
        F.xxhash64(F.lit(1), "kind", "text").alias("spelling_1"),
        F.xxhash64(F.lit(2), "kind", "text").alias("spelling_2"),
        F.xxhash64("kind", invariant(F.col("text"))).alias("class_1"),
        "text",
        "first_id",
        "n",
    )
    sizes = first.groupBy("class_1").agg(F.count(F.lit(1)).alias("members"))
    second = first.join(sizes, "class_1").withColumn(
        "class_2", F.when(F.col("members") > 1, F.xxhash64(canonical(F.col("text")))).otherwise(F.lit(0))
    )
    groups = second.groupBy("class_1", "class_2").agg(
        F.min("first_id").alias("group_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("spellings")
    )
    return second.select("class_1", "class_2", "spelling_1", "spelling_2").join(groups, ["class_1", "class_2"]).drop("class_1", "class_2")


def collapsed(df: DataFrame, id_column: str, type_column: str, text_column: str) -> DataFrame:
    """One record per group: (group_id, copies, spellings)."""
    return refine(df, id_column, type_column, text_column).select("group_id", "copies", "spellings").distinct()


def copies(df: DataFrame, id_column: str, type_column: str, text_column: str) -> DataFrame:
    """(a, b): each row b that is not the first of its group, with the group's least id a."""
    groups = refine(df, id_column, type_column, text_column).where(F.col("copies") > 1).drop("copies", "spellings")
    kind = stripped(F.col(type_column))
    rows = df.where(F.col(type_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("b"),
        F.xxhash64(F.lit(1), kind, F.col(text_column)).alias("spelling_1"),
        F.xxhash64(F.lit(2), kind, F.col(text_column)).alias("spelling_2"),
    )
    return rows.join(groups, ["spelling_1", "spelling_2"]).where(F.col("b") != F.col("group_id")).select(F.col("group_id").alias("a"), "b")
