"""Repositories: addresses, and the local clones that file sources read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.operators import discovery

#: host/owner/name forms of an address; fixed values.
WEB = r"^https?://github\.com/([^/]+)/([^/]+)"
SSH = r"^git@github\.com:([^/]+)/([^/]+)$"
SHORT = r"^([^/:@]+)/([^/:@]+)$"


def owner_and_name(url: Column) -> Column:
    """struct<owner, name> of an address in web, SSH or owner/name form, or null; a trailing .git doesn't matter."""
    bare = F.regexp_replace(url, r"\.git$", "")
    out = F.lit(None).cast("struct<owner:string,name:string>")
    for p in (SSH, WEB, SHORT):
        found = F.struct(F.regexp_extract(bare, p, 1).alias("owner"), F.regexp_extract(bare, p, 2).alias("name"))
        out = F.when(bare.rlike(p), found).otherwise(out)
    return out


def valid_url(url: Column) -> Column:
    """Has the address a scheme and a host, and on github.com an owner and a name?"""
    scheme, host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    parts = F.size(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"))
    return (scheme != "") & (host != "") & ((host != "github.com") | ((path != "") & (parts >= 2)))


def https_url(url: Column) -> Column:
    """Begins with https:// and goes on."""
    return url.startswith("https://") & (F.length(url) > 8)


def _escaped(text: str) -> str:
    return "".join(f"\\{c}" if c in ".+()[]{}^$|?*\\" else c for c in text)


def _dotted(root: str) -> list[tuple[str, int]]:
    """Files that Spark's file sources skip (their name, or a folder's, begins with a dot or underscore), .git left out."""
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f != ".git"]
        inside = any(part[:1] in "._" for part in os.path.relpath(folder, root).split(os.sep) if part != ".")
        found += [(p, os.path.getsize(p)) for n in names for p in [os.path.join(folder, n)] if (inside or n[:1] in "._") and os.path.isfile(p)]
    return found


def read_tree(spark: SparkSession, root: str, max_size: int | None = None, dotted: bool = True) -> DataFrame:
    """(path relative to root, size, content, is_hidden, is_binary) of the files under a local or shared folder.

    Filters on path and size reach the scan, so the bytes of files left out are never read.  Spark's file sources skip
    names that begin with a dot or underscore; with ``dotted`` those of a mounted folder are listed (names only) and
    opened by the executors.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), "content")
    if dotted and os.path.isdir(root) and (names := _dotted(root)):

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    data = Path(one.column(0)[0].as_py()).read_bytes()
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([data], pa.binary())], ["path", "size", "content"])

        listed = spark.createDataFrame(names, "path string, size long")
        if max_size is not None:
            listed = listed.where(F.col("size") <= max_size)
        rows = rows.where(~F.regexp_replace("path", "^" + _escaped(base), "").rlike(r"(?:^|/)[._]")).unionByName(
            listed.mapInArrow(opened, "path string, size long, content binary")
        )
    if max_size is not None:
        rows = rows.where(F.col("size") <= max_size)
    relative = F.regexp_replace("path", "^" + _escaped(base), "")
    return rows.select(
        relative.alias("path"), "size", "content", discovery.hidden(F.col("path")).alias("is_hidden"), discovery.binary(F.col("content")).alias("is_binary")
    )


def discover(spark: SparkSession, root: str, exclude_binary: bool = True, **rules: object) -> DataFrame:
    """Files under a folder that the discovery rules include, binary ones too if wanted, decoded as UTF-8."""
    files = read_tree(spark, root)
    kept = files.where(discovery.included(F.col("path"), F.col("size"), **rules) & (~F.col("is_binary") if exclude_binary else F.lit(True)))
    return kept.withColumn("text", F.decode("content", "UTF-8")).drop("content")


def tree_stats(spark: SparkSession, root: str) -> DataFrame:
    """Number and bytes of the files under a clone, its .git folder left out; content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    sizes = files.where(~F.col("path").rlike(r"/\.git/|/[._][^/]*$")).select("length")
    dotted = _dotted(root) if os.path.isdir(root) else []
    seen = spark.createDataFrame([(n,) for _, n in dotted], "length long")
    return sizes.unionByName(seen).agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
