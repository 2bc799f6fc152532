"""Held-out items that leak into a corpus: CGK embedding, bit-sampling LSH, exact verification.

Every run of ``size`` words of an item, and of a document, is a window.  The CGK random walk embeds a window of n
words in 3n symbols: at each step it writes the current word and moves on or stays, by a random bit of that word and
step.  Windows at a small edit distance get embeddings at a small Hamming distance, so equal samples of embedded
positions make candidates.  Each repetition has its own walk and sample; two equal windows agree in every one, so
quotes without any change are found with certainty, and ``recall`` bounds the number of repetitions for others.
Candidates are verified on the words' 64-bit codes: most fall to a count of the item's words that occur around the
document's window at all; for the rest the least edit distance of the item's window to any run of words around the
document's is computed, so added and missing words count as one edit each.  Texts are padded by ``edits`` words, so that
quotes with missing words are also met at the ends of a text or as a whole short text.

Documents are scanned once, whatever the number of items.  Up to ``ITEM_BLOCK`` items of ``ITEM_CHARS`` characters in
all are a broadcast index, built once per worker; then documents are never shuffled.  More items stay distributed: their
keys set bits in a filter of ``FILTER_WORDS`` words, the only thing that is broadcast; document windows whose key passes
it are joined to the items' windows by key and verified after the join.

Cases: null, empty and short texts match nothing; an item shorter than the window leaks nowhere; repeated item ids
give one row; rows of one document id give one row each, and one in all where items are joined; HTML tags, entities, case, punctuation and line breaks don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundew.llm.words import Coder, flat, mix, pieces, window_starts
from sundew.session import once

ITEM_BLOCK = 20_000
ITEM_CHARS = 64 << 20
#: 64-bit words of the filter of item keys: 16 MB, whatever the number of items.
FILTER_WORDS = 1 << 21
#: Stands before and after a text where a quote with missing words leaves its window; no word has this code.
OUTSIDE = np.uint64(0xB5297A4D3F84D5B5)


def cgk_keys(codes: np.ndarray, firsts: np.ndarray, size: int, repetition: int, samples: int) -> np.ndarray:
    """One LSH key per window: a hash of ``samples`` sampled positions of its CGK embedding of length 3 * size."""
    rng = np.random.default_rng(1000 + repetition)
    picked = set(rng.choice(3 * size, samples, replace=False).tolist())
    shifts = rng.integers(0, 64, 3 * size)
    at = np.zeros(len(firsts), np.int64)
    key = np.full(len(firsts), repetition, np.uint64)
    for step in range(max(picked) + 1):
        inside = at < size
        word = codes[firsts + np.minimum(at, size - 1)]
        if step in picked:
            key = (key ^ np.where(inside, word, np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        at += ((word >> np.uint64(shifts[step])) & np.uint64(1)).astype(np.int64) & inside
    return mix(key)


def padded(codes: np.ndarray, starts: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes with twice ``edits`` of ``OUTSIDE`` around each text; where its windows begin and end, ``edits`` beyond it."""
    shift = 2 * edits * (2 * np.arange(len(starts) - 1) + 1)
    out = np.full(len(codes) + 4 * edits * (len(starts) - 1), OUTSIDE, np.uint64)
    out[np.arange(len(codes)) + np.repeat(shift, np.diff(starts))] = codes
    return out, starts[:-1] + shift - edits, starts[1:] + shift + edits


def edit_distances(a: np.ndarray, b: np.ndarray, within: bool = False) -> np.ndarray:
    """Word edit distance of each pair of windows (rows of ``a`` and ``b``), all pairs at once.

    ``within``: the least distance of ``a`` to any run of words of ``b``.
    """
    row = np.repeat(np.arange(b.shape[1] + 1)[:, None] * (not within), len(a), 1)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[0] = i + 1
        for j in range(b.shape[1]):
            new[j + 1] = np.minimum(np.minimum(row[j + 1], new[j]) + 1, row[j] + (a[:, i] != b[:, j]))
        row = new
    return row.min(0) if within else row[-1]


def verified_distances(items: np.ndarray, around: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each item window to a run of words around a document's window, ``most`` + 1 if it is more.

    Rows of ``around`` are the document's window with ``most`` words before and after it.
    """
    size = items.shape[1]
    distance = np.where((items == around[:, most : most + size]).all(1), 0, most + 1)
    if not most:
        return distance
    other = np.flatnonzero(distance)
    for i in range(0, len(other), 20_000):
        part = other[i : i + 20_000]
        a, b = items[part], around[part]
        met = (a[:, :, None] == b[:, None, :]).any(2).sum(1)
        close = np.flatnonzero(met >= size - most)  # each edit removes one word at most
        if len(close):
            distance[part[close]] = edit_distances(a[close], b[close], within=True)
    return np.minimum(distance, most + 1)


class ItemIndex:
    """Windows of a block of items under all repetitions: sorted keys and the window that each stands for."""

    def __init__(self, ids: list[int], texts: list[str], size: int, repetitions: int, samples: int) -> None:
        self.size, self.repetitions, self.samples = size, repetitions, samples
        self.codes, starts = flat(texts, Coder())
        self.firsts = window_starts(starts, size)
        self.owner = np.array(ids, np.int64)[np.searchsorted(starts, self.firsts, "right") - 1] if len(self.firsts) else np.zeros(0, np.int64)
        self.words = np.zeros(1 << 22, bool)
        self.words[(self.codes >> np.uint64(42)).astype(np.int64)] = True
        self.keys, self.windows, self.seen = [], [], []
        for r in range(repetitions):
            keys = cgk_keys(self.codes, self.firsts, size, r, samples)
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.windows.append(order)
            self.seen.append(np.zeros(1 << 20, bool))
            self.seen[r][(keys >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document window, item window) that agree in some repetition."""
        found = []
        for r in range(self.repetitions):
            if not len(self.keys[r]):
                continue
            keys = cgk_keys(codes, firsts, self.size, r, self.samples)
            may = np.flatnonzero(self.seen[r][(keys >> np.uint64(44)).astype(np.int64)])
            keys = keys[may]
            lo, hi = np.searchsorted(self.keys[r], keys), np.searchsorted(self.keys[r], keys, "right")
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            first = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) if len(hit) else np.zeros(0, np.int64)
            found.append(np.repeat(may[hit], n) * len(self.firsts) + self.windows[r][np.arange(n.sum()) + first])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.firsts), pairs % len(self.firsts)

    def verified(self, codes: np.ndarray, firsts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document window, item id, edit distance) of the candidates within ``most`` word edits of a run of words around
        the window; ``codes`` has ``most`` words before and after each window.  Windows with too few words of any item can't
        be near one and get no key."""
        held = np.concatenate([[0], np.cumsum(self.words[(codes >> np.uint64(42)).astype(np.int64)])])
        may = np.flatnonzero(held[firsts + self.size + most] - held[firsts - most] >= self.size - most)
        a, b = self.candidates(codes, firsts[may])
        if not len(a):
            return a, b, b
        a = may[a]
        distance = np.empty(len(a), np.int64)
        for i in range(0, len(a), 200_000):
            x, y = a[i : i + 200_000], b[i : i + 200_000]
            around = codes[firsts[x][:, None] + np.arange(-most, self.size + most)]
            distance[i : i + 200_000] = verified_distances(self.codes[self.firsts[y][:, None] + np.arange(self.size)], around, most)
        keep = distance <= most
        return a[keep], self.owner[b[keep]], distance[keep]


def leaks(
    documents: DataFrame,
    items: DataFrame,
    document_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    size: int = 16,
    edits: int = 0,
    repetitions: int = 2,
    samples: int = 8,
) -> DataFrame:
    """(document id, item id, edit_distance, windows): documents with a run of words within ``edits`` word edits of an
    item's window.

    ``edit_distance`` is the least one found, ``windows`` at how many windows of the document such a run was found.
    """
    schema = T.StructType(
        [
            T.StructField(document_id, T.LongType()),
            T.StructField(item_id, T.LongType()),
            T.StructField("edit_distance", T.IntegerType()),
            T.StructField("windows", T.IntegerType()),
        ]
    )

    held = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("item"), F.col(text).cast("string").alias("text"))
    docs = documents.select(F.col(document_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    n, chars = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n > ITEM_BLOCK or chars > ITEM_CHARS:
        return _joined(docs, held, size, edits, repetitions, samples).toDF(*schema.names)
    rows = held.collect()
    given = documents.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
    token = uuid.uuid4().hex

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker = once("leak index", dict)
        if token not in held_by_worker:
            held_by_worker.clear()
            held_by_worker[token] = ItemIndex(*given.value, size, repetitions, samples)
        index, coder = held_by_worker[token], Coder()
        for whole in batches:
            for batch in pieces(whole, [1]):
                codes, begins, ends = padded(*flat(batch.column(1).to_pylist(), coder), edits)
                firsts = window_starts(np.stack([begins, ends], 1).ravel(), size)
                win, item, distance = index.verified(codes, firsts, edits)
                if not len(win):
                    continue
                doc = np.searchsorted(begins, firsts[win], "right") - 1
                order = np.lexsort((distance, win, item, doc))
                doc, item, distance, win = doc[order], item[order], distance[order], win[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
                fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (win[1:] != win[:-1])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc[new])),
                        pa.array(item[new], pa.int64()),
                        pa.array(np.minimum.reduceat(distance, new), pa.int32()),
                        pa.array(np.add.reduceat(fresh.astype(np.int32), new), pa.int32()),
                    ],
                    schema.names,
                )

    return docs.mapInArrow(kernel, schema)


def _windows(rows: DataFrame, size: int, edits: int, repetitions: int, samples: int, around: bool, bits: object = None) -> DataFrame:
    """(id, window, key, words): every window of each text under every repetition, with the codes of its words and, for
    ``around``, those of ``edits`` words before and after; only keys that pass the filter ``bits``, if there is one.

    ``window`` tells the windows of a table apart: a text's place in its partition, and the window's in the text."""
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("id", "window", "key")], T.StructField("words", T.ArrayType(T.LongType()))])
    more = edits if around else 0

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for whole in batches:
            for batch in pieces(whole, [1], 200, 1 << 20):
                codes, begins, ends = padded(*flat(batch.column(1).to_pylist(), coder), more)
                firsts = window_starts(np.stack([begins, ends], 1).ravel(), size)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(begins, firsts, "right") - 1] if len(firsts) else firsts
                for r in range(repetitions):
                    keys = cgk_keys(codes, firsts, size, r, samples)
                    at = np.flatnonzero(_passes(bits.value, keys)) if bits else np.arange(len(keys))
                    for i in range(0, len(at), 20_000):
                        part = at[i : i + 20_000]
                        words = codes[firsts[part][:, None] + np.arange(-more, size + more)]
                        offsets = np.arange(len(part) + 1, dtype=np.int32) * words.shape[1]
                        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel().astype(np.int64)))
                        place = firsts[part] - begins[np.searchsorted(begins, firsts[part], "right") - 1]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(place), pa.array(keys[part].astype(np.int64)), lists], schema.names)

    return rows.mapInArrow(kernel, schema)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    h = keys & np.uint64(FILTER_WORDS * 64 - 1)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def _joined(docs: DataFrame, items: DataFrame, size: int, edits: int, repetitions: int, samples: int) -> DataFrame:
    """As ``leaks`` for item sets of any size: windows whose keys pass the filter of item keys meet the items in a join."""
    item_windows = _windows(items, size, edits, repetitions, samples, False).select(F.col("id").alias("item"), "key", F.col("words").alias("item_words")).distinct()
    h = F.col("key").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    one = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    set_bits = item_windows.select(F.shiftright(h, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_WORDS rows at most
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[set_bits["at"].to_numpy(np.int64)] = set_bits["bits"].to_numpy(np.int64).astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    met = _windows(docs, size, edits, repetitions, samples, True, shared).join(item_windows, "key").select("id", "item", "window", "words", "item_words")
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("id", "item", "window")], T.StructField("distance", T.IntegerType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            y = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, size + 2 * edits)
            distance = verified_distances(x, y, edits)
            keep = pa.array(np.flatnonzero(distance <= edits))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(keep) for i in range(3)], pa.array(distance, pa.int32()).take(keep)], schema.names)

    pairs = met.mapInArrow(kernel, schema).groupBy("id", "item", "window").agg(F.min("distance").alias("distance"))
    return pairs.groupBy("id", "item").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).cast("int").alias("windows"))
