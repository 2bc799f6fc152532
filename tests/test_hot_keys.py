from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sundew.operators import hot_keys


def test_packing_splits_heavy_keys_over_different_tasks():
    plan = hot_keys.pack([("hot", 700), ("warm", 150)], [10, 50, 90], 8)
    assert plan.total == 1000 and plan.target == 125
    assert len(plan.heavy["hot"]) == 6 == len(set(plan.heavy["hot"]))
    assert len(plan.heavy["warm"]) == 2
    load = Counter()
    for k, ts in plan.heavy.items():
        for t in ts:
            load[t] += plan.loads[k] / len(ts)
    for n, t in zip([10, 50, 90], plan.buckets):
        load[t] += n
    assert max(load.values()) <= 1.5 * plan.target


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=6), st.lists(st.integers(0, 50), min_size=1, max_size=30), st.integers(1, 9))
def test_packing_places_everything(heavy, light, tasks):
    plan = hot_keys.pack([(str(i), n) for i, n in enumerate(heavy)], light, tasks)
    assert all(0 < len(ts) <= tasks and len(set(ts)) == len(ts) for ts in plan.heavy.values())
    assert len(plan.buckets) == len(light) and all(0 <= t < tasks for t in plan.buckets)


def test_partition_representatives(spark):
    reps = hot_keys._representatives(7)
    rows = spark.createDataFrame([(r,) for r in reps], "r int").select(F.pmod(F.hash("r"), F.lit(7)).alias("p")).collect()
    assert [r.p for r in rows] == list(range(7))


def skewed(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", i % 7) for i in range(3000)] + [(9000, None, 1), (9001, None, None)]
    return spark.createDataFrame(rows, "id long, k string, v int")


def test_heavy_keys(spark):
    df = skewed(spark)
    got = {(r.key_kind, r.key_value) for r in hot_keys.heavy_keys(df, ["k", "v"], 0.02).collect()}
    n = df.count()
    want = {("k", k) for k, c in Counter(r.k for r in df.collect()).items() if k is not None and c >= 0.02 * n}
    want |= {("v", str(k)) for k, c in Counter(r.v for r in df.collect()).items() if k is not None and c >= 0.02 * n}
    assert got == want
    assert hot_keys.heavy_keys(df.limit(0), ["k"], 0.02).count() == 0


def test_join_and_aggregate_equal_the_plain_ones(spark):
    left, right = skewed(spark), spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("zz", 4), (None, 5)], "k string, v int")
    plan = hot_keys.plan_shards(left, "k")
    assert "hot" in plan.heavy
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = hot_keys.fragment_replicate_join(left, right, "k", plan, how)
        want = left.join(right.withColumnRenamed("v", "v_right"), "k", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), how
    agg = hot_keys.balanced_aggregate(left, "k", {"n": F.count(F.lit(1)), "m": F.max("id")}, {"n": F.sum("n"), "m": F.max("m")}, plan)
    want = left.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    assert sorted(map(tuple, agg.collect())) == sorted(map(tuple, want.collect()))


def test_empty_table(spark):
    empty = skewed(spark).limit(0)
    plan = hot_keys.plan_shards(empty, "k")
    assert not plan.heavy
    assert hot_keys.fragment_replicate_join(empty, empty, "k", plan).count() == 0


def test_plans_of_several_columns_from_one_count(spark):
    df = skewed(spark)
    plans = hot_keys.plan_columns(df, ["k", "v"], 51)
    assert plans["k"].loads["hot"] == 2000 and (plans["k"].total, plans["k"].nulls) == (3000, 2)
    assert (plans["v"].total, plans["v"].nulls) == (3001, 1) and sum(plans["v"].loads.values()) == 3001
