"""Session helpers: table loading, durable cut points and a worker-side cache."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_tasks(spark: SparkSession) -> int:
    """How many reduce tasks the session asks for; plans size their shards by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by a reliable checkpoint in the shared folder of the session.

    ``spark.checkpoint.dir`` is read from the session.  Only a local session that names no folder (tests) gets one
    of its own; on a cluster a missing setting is an error, as a machine-local folder would not survive its host.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if configured is None:
            configured = tempfile.mkdtemp(prefix="sundew-ckpt-")
            atexit.register(shutil.rmtree, configured, True)
        sc.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and about ``size`` bytes of the text column, so that what becomes Python
    objects at a time stays bounded; a longer text comes alone and whole."""
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        held = n[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(n, held + size, "right"))), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def once(key: object, build):
    """The value that ``build()`` gave the first time this Python process asked for ``key``.

    Kernels pickled by value get fresh module globals in every task; this cache lives in ``sys`` and so
    survives as long as the reused worker process.
    """
    cache = sys.__dict__.setdefault("_sundew_once", {})
    full = (os.getpid(), key)
    if full not in cache:
        cache[full] = build()
    return cache[full]
