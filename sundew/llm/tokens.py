"""Encoding of texts by a public byte-level BPE tokenizer, in Arrow batches, and decoding by the byte table.

Cases: null and empty texts both give empty lists; special tokens' strings in a text are ordinary text; very long texts
are encoded whole.  The vocabulary's path is a parameter; the file is sent to the
executors and read once per worker process.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundew.session import once

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts go to the library in groups of about this many characters, so that a batch's token objects stay small.
GROUP_CHARS = 1 << 20
GROUP_TOKENS = 1 << 22


def shipped(spark: SparkSession, path: str) -> None:
    """Sends the vocabulary file to the executors, unless all is one machine; a file that the driver lacks must be there."""
    context = spark.sparkContext
    if not context.master.startswith("local[") and os.path.exists(path) and os.path.basename(path) not in map(os.path.basename, context.listFiles):
        context.addFile(path)


def _tokenizer(path: str):
    def build():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        t.encode_special_tokens = True
        return t

    return once(("tokenizer", path), build)


def byte_table() -> dict[str, int]:
    """Character -> byte of byte-level BPE: printable bytes stand for themselves, the others, in order, for 256, 257..."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in plain}
    for b in range(256):
        if b not in table.values():
            table[chr(256 + len(table) - len(plain))] = b
    return table


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def encode(df: DataFrame, id_column: str, text_column: str, path: str = DEFAULT_VOCABULARY, offsets: bool = False) -> DataFrame:
    """(id, ids) of each row; with ``offsets`` also ``starts``, each token's first character in the text."""
    shipped(df.sparkSession, path)
    fields = [T.StructField(id_column, T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("starts", T.ArrayType(T.IntegerType()))] * offsets)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        names = [id_column, "ids"] + ["starts"] * offsets
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, group in _groups(texts):
                got = tokenizer.encode_batch(group, add_special_tokens=False)
                arrays = [batch.column(0).slice(start, len(group)), pa.array([e.ids for e in got], pa.list_(pa.int32()))]
                if offsets:
                    arrays.append(pa.array([[a for a, _ in e.offsets] for e in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(F.col(id_column).cast("bigint").alias(id_column), F.col(text_column).cast("string")).mapInArrow(kernel, schema)


def decode(df: DataFrame, id_column: str, ids_column: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text, whole): the text of each id list.  Bytes that form no whole character, as when a list was cut inside
    one, become U+FFFD and ``whole`` is false.  Null lists give an empty text; unknown ids fail."""
    shipped(df.sparkSession, path)
    schema = T.StructType([T.StructField(id_column, T.LongType()), T.StructField("text", T.StringType()), T.StructField("whole", T.BooleanType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build() -> pa.Array:
            table = byte_table()
            found = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in _tokenizer(path).get_vocab().items()}
            return pa.array([found.get(i) for i in range(max(found) + 1)], pa.binary())

        pieces = once(("pieces", path), build)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), [])
            sizes = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(lists):  # so many tokens at a time that their bytes fit one array; a longer list comes alone
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + GROUP_TOKENS, "right")))
                part = lists.slice(start, stop - start)
                found = pieces.take(part.flatten())
                if found.null_count:
                    raise ValueError("an id is not in the vocabulary")
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False))])
                raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), b"")
                try:
                    texts, whole = raw.cast(pa.string()), pa.array(np.ones(len(raw), bool))
                except pa.ArrowInvalid:
                    each = [(x, x.decode(errors="replace")) for x in raw.to_pylist()]
                    texts, whole = pa.array([t for _, t in each], pa.string()), pa.array([t.encode() == x for x, t in each])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), texts, whole], [id_column, "text", "whole"])
                start = stop

    return df.select(F.col(id_column).cast("bigint").alias(id_column), F.col(ids_column).cast("array<int>")).mapInArrow(kernel, schema)
