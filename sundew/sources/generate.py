"""Deterministic test data: identifiers with right or wrong check digits, licences, look-alikes, and snippets around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.functions import checksums as C

#: State -> shape of its licence numbers (A a letter, 9 a digit); fixed values.
LICENCES = {"NSW": "99999999", "QLD": "99999999", "VIC": "999999999", "SA": "A999999", "WA": "9999999", "TAS": "AA99999"}
#: Context -> code around a value, by printf-style template.
SNIPPETS = {
    "assignment": 'const %2$s = "%1$s"', "function": 'validate("%1$s")', "struct": 'Record{%2$s: "%1$s"}', "comment": "// example: %2$s %1$s",
    "test": 'assert.Equal(t, "%1$s", got) // test', "mock": 'mock_%2$s = "%1$s"', "log": "INFO: %2$s=%1$s accepted", "config": "%2$s: %1$s",
    "environment": "export %2$s='%1$s'", "query": "SELECT * FROM t WHERE %2$s = '%1$s'",
}


def payload(key: Column, width: int, salt: int = 0) -> Column:
    """``width`` digits that look random but follow from the key alone."""
    return F.lpad(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(10**width)).cast("string"), width, "0")


def _sum(text: Column, weights: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.substring(text, i + 1, 1).cast("int") * w for i, w in enumerate(weights)])


def identifier(kind: str, key: Column, valid: bool = True) -> Column:
    """A number of one type.  Every valid one passes its check; an invalid one has the right form but another check digit."""
    wrong = 0 if valid else 1
    if kind == "TFN":
        body = F.concat((F.pmod(F.xxhash64(key, F.lit(9)), F.lit(9)) + 1).cast("string"), payload(key, 7))
        s = _sum(body, C.TFN_WEIGHTS[:8]) % 11
        # no digit completes a sum of 10, so the eighth moves on by one
        moved = F.concat(F.substring(body, 1, 7), ((F.substring(body, 8, 1).cast("int") + 1) % 10).cast("string"))
        body = F.when(s == 10, moved).otherwise(body)
        return F.concat(body, ((_sum(body, C.TFN_WEIGHTS[:8]) % 11 + wrong) % 10).cast("string"))
    if kind == "ABN":
        body = payload(key, 9)
        head = 10 + F.pmod(-_sum(body, C.ABN_WEIGHTS[2:]), F.lit(89))
        last = ((F.substring(body, 9, 1).cast("int") + wrong) % 10).cast("string")
        return F.concat(head.cast("string"), F.substring(body, 1, 8), last)
    if kind == "MEDICARE":
        body = F.concat((F.pmod(F.xxhash64(key, F.lit(9)), F.lit(5)) + 2).cast("string"), payload(key, 7))
        return F.concat(body, ((_sum(body, C.MEDICARE_WEIGHTS) + wrong) % 10).cast("string"), F.lit("1"))
    if kind == "BSB":
        d = payload(key, 5)
        state = F.pmod(F.xxhash64(key, F.lit(9)), F.lit(6)) + 2 if valid else F.pmod(F.xxhash64(key, F.lit(9)), F.lit(2))
        return F.concat(F.substring(d, 1, 2), state.cast("string"), F.substring(d, 3, 3))
    if kind == "ACN":
        body = payload(key, 8)
        return F.concat(body, ((10 - _sum(body, C.ACN_WEIGHTS) % 10 + wrong) % 10).cast("string"))
    raise ValueError(f"no generator for {kind}")


def licence(state: str, key: Column) -> Column:
    """A driver licence number in the form of a state."""
    shape = LICENCES[state]
    letters = [F.char(65 + F.pmod(F.xxhash64(key, F.lit(i)), F.lit(26))) for i in range(shape.count("A"))]
    return F.concat(*letters, payload(key, shape.count("9")))


def look_alikes(key: Column) -> Column:
    """struct<uuid, hash, version, sequence>: values that detectors should not take for identifiers."""
    digest = F.md5(key.cast("string"))
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    version = F.concat_ws(".", *[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(20)).cast("string") for i in range(3)])
    return F.struct(F.concat_ws("-", *cut).alias("uuid"), digest.alias("hash"), version.alias("version"), F.lit("123456789").alias("sequence"))


def snippet(context: str, kind: str, value: Column) -> Column:
    """Code in one of the contexts around a value."""
    return F.format_string(SNIPPETS[context], value, F.lit(kind.lower()))


def cases(spark: SparkSession, n: int, kinds: tuple[str, ...] = tuple(C.CHECKS)) -> DataFrame:
    """Labelled cases: (case_id, kind, context, is_actual, value, code, filename), valid ones in real and test contexts alike."""
    base = spark.range(n).select(F.col("id").alias("case_id"))
    names = list(SNIPPETS)
    out = None
    for i, kind in enumerate(kinds):
        for valid in (True, False):
            value = identifier(kind, F.col("case_id") + i * n, valid)
            pick = F.pmod(F.col("case_id"), F.lit(len(names)))
            code, context = snippet(names[-1], kind, F.col("value")), F.lit(names[-1])
            for j, c in enumerate(names[:-1]):
                code, context = F.when(pick == j, snippet(c, kind, F.col("value"))).otherwise(code), F.when(pick == j, c).otherwise(context)
            made = base.withColumn("value", value).withColumns({"kind": F.lit(kind), "code": code, "context": context})
            real = F.lit(valid) & ~F.col("context").isin("comment", "test", "mock")
            made = made.select("case_id", "kind", "context", real.alias("is_actual"), "value", "code", F.lit("config.go").alias("filename"))
            out = made if out is None else out.unionByName(made)
    return out
