import pytest
from pyspark.sql import functions as F

from sundew.functions import checksums
from sundew.sources import generate


@pytest.mark.parametrize("kind", list(checksums.CHECKS))
def test_identifiers(spark, kind):
    df = spark.range(2000)
    for valid in (True, False):
        got = df.select(generate.identifier(kind, F.col("id"), valid).alias("v")).select(checksums.CHECKS[kind](F.col("v")).alias("ok")).groupBy("ok").count().collect()
        assert [(r.ok, r["count"]) for r in got] == [(valid, 2000)]


def test_others(spark):
    r = spark.range(1).select(generate.licence("TAS", F.col("id")).alias("l"), generate.look_alikes(F.col("id")).alias("x")).first()
    assert len(r.l) == 7 and r.l[:2].isalpha() and len(r.x.uuid) == 36
    rows = generate.cases(spark, 20, ("TFN",)).collect()
    assert len(rows) == 40 and len({x.context for x in rows}) == 10 and all(x.value in x.code for x in rows)
    assert generate.cases(spark, 0).count() == 0
