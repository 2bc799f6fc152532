"""Per-key work when a few keys hold most rows: fragment-replicate by estimated load.

1. ``key_loads`` counts rows per key.  Counting is algebraic, so each map task sends one partial row per key and a
   hot key costs no more than a cold one.
2. ``plan_shards`` packs the loads into tasks (longest processing time first).  A key above the fair share of one
   task is *heavy*: it is split into shards in proportion to its load.  All other keys are packed in hash buckets.
   At most ``tasks`` keys can be heavy, so what the driver holds and what is broadcast is bounded by ``tasks`` and
   ``BUCKETS_PER_TASK * tasks``, whatever the data's size.
3. ``fragment_replicate_join`` sends the rows of a heavy key to its shards by row hash and replicates the matching
   side to exactly those shards; ``balanced_aggregate`` aggregates per (key, shard) and then merges.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundew.session import shuffle_tasks

BUCKETS_PER_TASK = 16


def key_loads(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key_kind, key_value, load): how many rows each value of each of ``columns`` has, nulls included.

    One scan serves all columns.  An empty table gives no rows.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("key_kind"), F.col(c).cast("string").alias("key_value")) for c in columns]))
    return df.select(keys.alias("k")).select("k.*").groupBy("key_kind", "key_value").agg(F.count(F.lit(1)).alias("load"))


def heavy_keys(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """(key_kind, key_value, load, total): the non-null values that hold at least ``share`` of all rows of ``df``.

    These are heavy keys of the shard plans for tasks of at most that share, whose exact loads the plans hold; a plan has
    less than 1 / ``share`` + 1 of them.  Ties at the border are kept; no rows give no keys.
    """
    plans = plan_columns(df, columns, int(1 / share) + 1)
    rows = [(c, k, n, p.total + p.nulls) for c, p in plans.items() for k, n in sorted(p.loads.items()) if n >= share * (p.total + p.nulls)]
    return df.sparkSession.createDataFrame(rows, "key_kind string, key_value string, load long, total long")


@dataclass
class ShardPlan:
    """Where rows go: ``heavy`` maps a key to the tasks of its shards, ``buckets`` a light key's hash bucket to a task."""

    tasks: int
    target: int
    total: int = 0
    nulls: int = 0
    heavy: dict[str, list[int]] = field(default_factory=dict)
    loads: dict[str, int] = field(default_factory=dict)
    buckets: list[int] = field(default_factory=list)

    def heavy_rows(self) -> list[tuple[str, list[int]]]:
        return sorted(self.heavy.items())


def pack(heavy: list[tuple[str, int]], buckets: list[int], tasks: int) -> ShardPlan:
    """The driver's share of ``plan_shards``: longest-processing-time bin packing of shards and buckets into tasks."""
    total = sum(n for _, n in heavy) + sum(buckets)
    target = max(1, -(-total // tasks))
    items: list[tuple[int, int, str | int]] = []
    for key, n in heavy:
        shards = min(tasks, max(1, -(-n // target)))
        items += [(-(-n // shards), 0, key)] * shards
    items += [(n, 1, i) for i, n in enumerate(buckets)]
    items.sort(key=lambda x: (-x[0], x[1], str(x[2])))
    heap = [(0, t) for t in range(tasks)]
    plan = ShardPlan(tasks, target, total, 0, {k: [] for k, _ in heavy}, dict(heavy), [0] * len(buckets))
    taken: dict[str, set[int]] = {k: set() for k, _ in heavy}
    for load, light, key in items:
        if light:
            at, t = heapq.heappop(heap)
            plan.buckets[key] = t
            heapq.heappush(heap, (at + load, t))
            continue
        put_back = []
        while True:  # shards of one key go to different tasks
            at, t = heapq.heappop(heap)
            if t not in taken[key]:
                break
            put_back.append((at, t))
        plan.heavy[key].append(t)
        taken[key].add(t)
        for x in put_back + [(at + load, t)]:
            heapq.heappush(heap, x)
    return plan


def plan_columns(df: DataFrame, columns: list[str], tasks: int) -> dict[str, ShardPlan]:
    """A plan for the non-null values of each column: one counting pass per key for all of them, then bin packing.

    To the driver come, per column, at most ``tasks`` heavy keys (each holds more than 1/tasks of the rows),
    ``BUCKETS_PER_TASK * tasks`` bucket sums and the number of nulls.
    """
    n_buckets = BUCKETS_PER_TASK * tasks
    loads = key_loads(df, columns)
    sums = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    totals = {c: (sums[f"_{i}"], sums["_rows"] - sums[f"_{i}"]) for i, c in enumerate(columns)}
    total = F.lit(0)
    for c, (n, _) in totals.items():
        total = F.when(F.col("key_kind") == c, n).otherwise(total)
    heavy = F.when(F.col("load") * F.lit(tasks) > total, F.col("key_value"))
    bucket = F.pmod(F.xxhash64("key_value"), F.lit(n_buckets)).cast("int")
    rows = (
        loads.where(F.col("key_value").isNotNull())
        .groupBy("key_kind", heavy.alias("key_value"), F.when(heavy.isNull(), bucket).alias("bucket"))
        .agg(F.sum("load").alias("load"))
        .collect()
    )
    plans = {}
    for c in columns:
        mine = [r for r in rows if r.key_kind == c]
        buckets = [0] * n_buckets
        for r in mine:
            if r.key_value is None:
                buckets[r.bucket] = r.load
        plans[c] = pack(sorted((r.key_value, r.load) for r in mine if r.key_value is not None), buckets, tasks)
        plans[c].nulls = totals.get(c, (0, 0))[1]
    return plans


def plan_shards(df: DataFrame, key: str, tasks: int | None = None) -> ShardPlan:
    """Plan for the non-null values of ``df[key]``; by default for as many tasks as the session's shuffles have."""
    return plan_columns(df, [key], tasks or shuffle_tasks(df.sparkSession))[key]


def _murmur3_int(value: int, seed: int = 42) -> int:
    """Spark's hash of one INT column, to find an integer that its hash partitioning sends to a wanted partition."""
    m = 0xFFFFFFFF

    def rotl(x: int, r: int) -> int:
        return ((x << r) | (x >> (32 - r))) & m

    k = (rotl((value * 0xCC9E2D51) & m, 15) * 0x1B873593) & m
    h = (rotl(seed ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & m
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & m
    h ^= h >> 16
    return h - (1 << 32) if h & 0x80000000 else h


def _representatives(tasks: int) -> list[int]:
    """For each partition number the least integer that hash partitioning over ``tasks`` partitions sends there."""
    found: dict[int, int] = {}
    i = 0
    while len(found) < tasks:
        found.setdefault(_murmur3_int(i) % tasks, i)
        i += 1
    return [found[t] for t in range(tasks)]


def _placed(df: DataFrame, key: Column, plan: ShardPlan, replicate: bool, spread: Column | None = None) -> DataFrame:
    """``df`` with the column ``_task``: one of a heavy key's shards, or all of them if ``replicate``."""
    reps = _representatives(plan.tasks)
    schema = T.StructType([T.StructField("_heavy_key", T.StringType()), T.StructField("_tasks", T.ArrayType(T.IntegerType()))])
    heavy = df.sparkSession.createDataFrame([(k, [reps[t] for t in ts]) for k, ts in plan.heavy_rows()], schema)
    buckets = F.split(F.lit(",".join(str(reps[t]) for t in plan.buckets)), ",").cast("array<int>")  # folds to one literal
    light = F.get(buckets, F.pmod(F.xxhash64(key.cast("string")), F.lit(len(plan.buckets))).cast("int"))
    joined = df.withColumn("_k", key.cast("string")).join(F.broadcast(heavy), F.col("_k") == F.col("_heavy_key"), "left")
    if replicate:
        task = F.explode(F.coalesce(F.col("_tasks"), F.array(light)))
    else:
        at = F.pmod(spread, F.size("_tasks").cast("bigint")).cast("int")
        task = F.when(F.col("_tasks").isNull(), light).otherwise(F.get(F.col("_tasks"), at))
    return joined.withColumn("_task", task).drop("_heavy_key", "_tasks")


def fragment_replicate_join(left: DataFrame, right: DataFrame, on: str, plan: ShardPlan, how: str = "inner") -> DataFrame:
    """Equi-join of ``left`` (skewed) and ``right`` on column ``on``, with heavy keys of ``left`` split over their shards.

    ``how`` may be inner, left or left_semi/left_anti: each left row goes to one shard, so it meets each matching
    right row once.  Rows with a null key match nothing (a left join keeps them).  Other columns that both sides
    have keep the left side's value; the right side's gets the suffix ``_right``.
    """
    # both sides are partitioned by task alone; without this the planner would hash them anew by task and key
    left.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if not t.startswith("map")])
    a = _placed(left, F.col(on), plan, False, spread).repartition(plan.tasks, "_task")
    clash = [c for c in right.columns if c in left.columns and c != on]
    r = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    b = _placed(r.where(F.col(on).isNotNull()), F.col(on), plan, True).repartition(plan.tasks, "_task").drop(on)
    b = b.withColumnRenamed("_k", "_rk").withColumnRenamed("_task", "_rtask")
    joined = a.join(b, (a["_task"] == b["_rtask"]) & (a["_k"] == b["_rk"]), how)
    return joined.drop("_task", "_k", "_rtask", "_rk")


def balanced_aggregate(df: DataFrame, key: str, partial: dict[str, Column], merge: dict[str, Column], plan: ShardPlan) -> DataFrame:
    """Per-key results of a skewed table: ``partial`` per (key, shard), then ``merge`` over a key's shards.

    For aggregates without a map-side combine; a shard holds about ``plan.target`` rows.  Where map tasks can combine
    (counts, sums, extremes) a plain ``groupBy`` has no imbalance and shuffles less.
    Null keys give no row.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")])
    placed = _placed(df.where(F.col(key).isNotNull()), F.col(key), plan, False, spread).repartition(plan.tasks, "_task")
    per_shard = placed.groupBy(key, "_task").agg(*[e.alias(n) for n, e in partial.items()])
    return per_shard.groupBy(key).agg(*[e.alias(n) for n, e in merge.items()])
