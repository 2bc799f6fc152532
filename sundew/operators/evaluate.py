"""Quality of detection: confusion counts, rates, grades, comparisons and summaries, all as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(actual: Column, detected: Column) -> list[Column]:
    return [
        F.count_if(actual & detected).alias("tp"),
        F.count_if(~actual & detected).alias("fp"),
        F.count_if(~actual & ~detected).alias("tn"),
        F.count_if(actual & ~detected).alias("fn"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, specificity and accuracy to tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.withColumns(
        {
            "precision": p,
            "recall": r,
            "f1": ratio(p * r * 2, p + r),
            "specificity": ratio(tn, tn + fp),
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        }
    )


def evaluate(cases: DataFrame, actual: str, detected: str, *groups: str) -> DataFrame:
    """Confusion counts and rates, overall or per group; one pass."""
    return with_rates(cases.groupBy(*groups).agg(*confusion(F.col(actual), F.col(detected))))


def evaluate_sets(cases: DataFrame, actual: str, detected: str, detector: str, *groups: str) -> DataFrame:
    """Overall and per each single group, for every detector, by grouping sets in one shuffle.

    Columns: detector, dimension (all or the group's name), member, counts and rates.
    """
    entries = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("member"))]
    entries += [F.struct(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("member")) for g in groups]
    wide = cases.select(detector, actual, detected, F.explode(F.array(*entries)).alias("_g"))
    return with_rates(wide.groupBy(detector, F.col("_g.dimension"), F.col("_g.member")).agg(*confusion(F.col(actual), F.col(detected))))


def best_detectors(rates: DataFrame, detector: str, metrics: tuple[str, ...] = ("precision", "recall", "f1", "accuracy")) -> DataFrame:
    """(metric, detector, value): the best per metric, the first name on ties; a metric of 0 everywhere has no best."""
    long = rates.unpivot([detector], list(metrics), "metric", "value").where(F.col("value") > 0)
    rank = F.min(F.struct((-F.col("value")).alias("v"), F.col(detector).alias("d")))
    return long.groupBy("metric").agg(rank.alias("b")).select("metric", F.col("b.d").alias(detector), (-F.col("b.v")).alias("value"))


def grade(precision: Column, recall: Column, f1: Column) -> Column:
    """A to F by half the F1, three tenths of the precision and two of the recall."""
    score = f1 * 0.5 + precision * 0.3 + recall * 0.2
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def business_rates(counts: DataFrame) -> DataFrame:
    """From tp, fp, fn: accuracy over all that was expected or found, precision, recall, F1 and their overall mean."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r, a = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tp, tp + fp + fn)
    f1 = ratio(p * r * 2, p + r)
    return counts.withColumns({"accuracy": a, "precision": p, "recall": r, "f1": f1, "overall": (a + f1) / 2})


def portfolio(findings: DataFrame, risk: str) -> DataFrame:
    """One row: findings per tier and the tier of the whole."""
    c = {t: F.count_if(F.col(risk) == t) for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
    counts = findings.agg(*[e.alias(f"n_{t.lower()}") for t, e in c.items()])
    tier = F.when(F.col("n_critical") > 5, "CRITICAL").when(F.col("n_high") > 10, "HIGH").when(F.col("n_medium") > 15, "MEDIUM").otherwise("LOW")
    return counts.withColumn("portfolio_risk", tier)


def pass_summary(cases: DataFrame, expected: str, detected: str, *groups: str) -> DataFrame:
    """Per group and overall (nulls): cases, passed ones (detected as expected), false positives, misses, rates."""
    e, d = F.col(expected), F.col(detected)
    agg = cases.rollup(*groups) if groups else cases.groupBy()
    out = agg.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(e == d).alias("passed"), F.count_if(~e & d).alias("false_positives"), F.count_if(e & ~d).alias("misses")
    )
    return out.withColumn("pass_rate", ratio(F.col("passed"), F.col("cases")))


def total(*metrics: DataFrame) -> DataFrame:
    """The sum of several tables of counts, rates computed anew."""
    added = reduce(DataFrame.unionByName, [m.select("tp", "fp", "tn", "fn") for m in metrics])
    return with_rates(added.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))


def select_cases(cases: DataFrame, **wanted: object) -> DataFrame:
    """The cases of a context, type, language, complexity...: each named column equals its value, or one of a list."""
    for column, value in wanted.items():
        cases = cases.where(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return cases


def dataset_stats(cases: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, member, n): the number of all cases, and per member of each dimension; one pass."""
    members = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("member")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dimensions]]
    return cases.select(F.explode(F.array(*members)).alias("x")).groupBy("x.dimension", "x.member").agg(F.count(F.lit(1)).alias("n"))


#: Rate -> (name of a strength, from which value on, name of a weakness, up to which value); fixed values.
JUDGED = {
    "precision": ("few false positives", 0.85, "many false positives", 0.60),
    "recall": ("finds most", 0.85, "misses many", 0.70),
    "f1": ("well balanced", 0.80, "poorly balanced", 0.65),
}


def assessment(rates: DataFrame) -> DataFrame:
    """Adds to precision, recall and f1 a score of 0 to 100, grade, strengths, weaknesses and what to tune: recall, precision,
    both or edge cases."""
    p, r, f1 = F.col("precision"), F.col("recall"), F.col("f1")
    strengths = F.array_compact(F.array(*[F.when(F.col(c) >= least, F.lit(name)) for c, (name, least, _, _) in JUDGED.items()]))
    weaknesses = F.array_compact(F.array(*[F.when((F.col(c) < least) & (F.col(c) <= most), F.lit(name)) for c, (_, least, name, most) in JUDGED.items()]))
    tune = F.when(p > r + 0.15, "recall").when(r > p + 0.15, "precision").when(f1 < 0.70, "both").otherwise("edge cases")
    return rates.withColumns({"grade_score": (f1 * 0.5 + p * 0.3 + r * 0.2) * 100, "grade": grade(p, r, f1), "strengths": strengths, "weaknesses": weaknesses, "tune": tune})


def context_accuracy(samples: DataFrame, context: str, expected: str) -> DataFrame:
    """One row (samples, right, accuracy): a test context should expect nothing, production and logging something, others
    are right either way.  ``expected`` is the number of expected finds."""
    some = F.coalesce(F.col(expected), F.lit(0)) > 0
    right = F.when(F.col(context) == "test", ~some).when(F.col(context).isin("production", "logging"), some).otherwise(True)
    out = samples.agg(F.count(F.lit(1)).alias("samples"), F.count_if(right).alias("right"))
    return out.withColumn("accuracy", ratio(F.col("right"), F.col("samples")))


def by_complexity(samples: DataFrame, complexity: str, seconds: str) -> DataFrame:
    """Per complexity: samples, tp, fp, fn summed, accuracy over all that was expected or found, mean seconds."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    out = samples.groupBy(complexity).agg(F.count(F.lit(1)).alias("samples"), *sums, F.avg(seconds).alias("mean_seconds"))
    return out.withColumn("accuracy", ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))


def throughput(counts: DataFrame, n: str, seconds: str) -> DataFrame:
    """Adds ``per_second``, 0 where no time passed."""
    return counts.withColumn("per_second", ratio(F.col(n), F.col(seconds)))


def detection_by_type(expected: DataFrame, found: DataFrame, kind: str, keys: list[str], confidence: str) -> DataFrame:
    """Per type: distinct expected and found keys, found ones that were expected, detection rate, precision and the mean
    confidence of these.  ``keys`` include the type."""
    e = expected.select(*keys).withColumns({"_e": F.lit(1), "_f": F.lit(0), "_c": F.lit(None).cast("double")})
    f = found.select(*keys, F.col(confidence).alias("_c")).withColumns({"_e": F.lit(0), "_f": F.lit(1)})
    both = e.unionByName(f).groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_f").alias("_f"), F.avg("_c").alias("_c"))
    hit = (F.col("_e") == 1) & (F.col("_f") == 1)
    out = both.groupBy(kind).agg(F.sum("_e").alias("expected"), F.sum("_f").alias("found"), F.count_if(hit).alias("right"), F.avg(F.when(hit, F.col("_c"))).alias("mean_confidence"))
    return out.withColumns({"detection_rate": ratio(F.col("right"), F.col("expected")), "precision": ratio(F.col("right"), F.col("found"))})


def detailed_report(cases: DataFrame, actual: str, detected: str, detector: str, *groups: str) -> DataFrame:
    """A whole evaluation in one long table (section, detector, dimension, member, metric, value, label): ``dataset`` counts,
    ``rates`` overall and per member of each group, ``best`` detector per metric, ``grade`` of each detector."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    one = cases.where(F.col(detector).isNotNull())
    rates = evaluate_sets(one, actual, detected, detector, *groups)
    names = ["tp", "fp", "tn", "fn", "precision", "recall", "f1", "specificity", "accuracy"]
    long = rates.select(detector, "dimension", "member", *[F.col(n).cast("double").alias(n) for n in names]).unpivot([detector, "dimension", "member"], names, "metric", "value")
    whole = rates.where(F.col("dimension") == "all")
    columns = ["section", "detector", "dimension", "member", "metric", "value", "label"]
    pick = lambda df, **c: df.select(*[c.get(n, F.col(n) if n in df.columns else text).alias(n) for n in columns])
    parts = [
        pick(dataset_stats(one, *groups), section=F.lit("dataset"), metric=F.lit("n"), value=F.col("n").cast("double")),
        pick(long, section=F.lit("rates"), detector=F.col(detector)),
        pick(best_detectors(whole, detector), section=F.lit("best"), detector=F.col(detector)),
        pick(assessment(whole).select(detector, "grade_score", "grade"), section=F.lit("grade"), detector=F.col(detector), metric=F.lit("score"), value=F.col("grade_score"), label=F.col("grade")),
    ]
    return reduce(DataFrame.unionByName, [p.withColumn("value", F.coalesce(F.col("value").cast("double"), number)) for p in parts])


def running_mean(samples: DataFrame, key: str, at: str, tie: str, value: str, slice_seconds: int = 86_400) -> DataFrame:
    """Adds ``mean``: of the values of a key up to the row, in order of ``at`` (null first) and ``tie``; null values don't count.

    A hot key isn't sorted in one task: rows are summed per slice of time, slices are summed up per key (as many rows as
    there are slices), and only a slice's own rows are sorted.
    """
    part = F.coalesce(F.floor(F.unix_micros(at) / (slice_seconds * 1_000_000)), F.lit(-(1 << 62)))
    rows = samples.withColumn("_slice", part)
    sums = rows.groupBy(key, "_slice").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    done = sums.select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    own = Window.partitionBy(key, "_slice").orderBy(F.col(at).asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({"_os": F.coalesce(F.sum(value).over(own), F.lit(0.0)), "_on": F.count(value).over(own)})
    joined = inner.join(done, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")))
    return joined.withColumn("mean", F.try_divide(F.col("_s") + F.col("_os"), F.col("_n") + F.col("_on"))).drop("_key", "_of", "_s", "_n", "_os", "_on", "_slice")
