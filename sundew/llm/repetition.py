"""Repetition inside a document: lines labelled content or boilerplate by a linear-chain CRF, and measured exactly.

A document is cut into units (lines, and sentences of long lines).  Each unit has features of its own (is it said
again word for word, how many of its words other units use, how many it repeats itself, is it short) and of how much of
it lies in stretches of ``size`` words that recur in the document.  The chain's Viterbi path marks units as boilerplate
(said again) or content; the share of words in content units decides whether a document is retained.  ``repetition``
gives these, and beside them the exact share of repeated words of every document, retained or not.

The CRF's weights are trained here, by maximum likelihood (forward-backward) on ``TRAINING_DOCUMENTS`` documents made
by a fixed generator, whose labels are known; they take a second and depend on no data.

Cases: null and blank texts and texts shorter than a stretch have share 0; list numbers, bullets and quote marks at a
line's start are no words; case, punctuation and white space don't matter; very long texts are measured whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundew.llm.words import WORD, Coder, mix, pieces

SIZE = 8
TRAINING_DOCUMENTS = 120
N_FEATURES = 8
LABELS = 2
LIST_NUMBER = re.compile(r"^[\s>*•|+-]*(?:\d{1,6}[.):]|[a-zA-Z][.)]|\(\d{1,6}\)|[ivxIVX]{1,6}[.)])(?=\s)")
UNIT = re.compile(r"\r\n|[\r\n\u0085  ]|(?<=[.!?])\s+")


def units(text: str) -> list[list[str]]:
    """Lower-case words of each unit, without list numbers."""
    out = []
    for u in UNIT.split(text):
        words = WORD.findall(LIST_NUMBER.sub("", u).lower())
        if words:
            out.append(words)
    return out


def covered(codes: np.ndarray, starts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Which words lie in a stretch of ``size`` words that occurs more than once in their text.

    Equal stretches are found by a 64-bit rolling code together with the text's number.
    """
    n = len(codes)
    cover = np.zeros(n + 1, np.int32)
    if n >= size:
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        code = mix(text[: n - size + 1].astype(np.uint64) + np.uint64(77))
        for i in range(size):
            code = mix(code * np.uint64(31) + codes[i : n - size + 1 + i])
        ok = text[: n - size + 1] == text[size - 1 :]
        at = np.flatnonzero(ok)
        order = at[np.argsort(code[at], kind="stable")]
        same = code[order][1:] == code[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        first = order[twice]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + size, -1)
    return np.cumsum(cover[:-1]) > 0


def features(cover: np.ndarray, codes: np.ndarray, unit_starts: np.ndarray, unit_firsts: np.ndarray) -> np.ndarray:
    """Per unit: bias, share of covered words, any covered, all covered, is short, is said again, share of words that other
    units of its document use, share of words that it repeats itself.

    ``unit_starts`` are the first words of the units, ``unit_firsts`` the first units of the documents.
    """
    length = np.diff(unit_starts)
    n = len(length)
    if not n:
        return np.zeros((0, N_FEATURES))
    share = np.add.reduceat(cover.astype(np.float64), unit_starts[:-1]) / length
    unit = np.repeat(np.arange(n), length)
    document = np.repeat(np.arange(len(unit_firsts) - 1), np.diff(unit_firsts)).astype(np.uint64)
    place = (np.arange(len(codes)) - unit_starts[unit]).astype(np.uint64)
    whole = mix(np.add.reduceat(codes * (mix(place + np.uint64(9)) | np.uint64(1)), unit_starts[:-1]) + mix(document + np.uint64(3)))
    order = np.argsort(whole, kind="stable")
    same = whole[order][1:] == whole[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    word = codes ^ mix(document[unit] + np.uint64(11))  # a word of one document
    order = np.lexsort((unit, word))
    w, u = word[order], unit[order]
    new_word = np.concatenate([[True], w[1:] != w[:-1]])
    new_pair = new_word | np.concatenate([[True], u[1:] != u[:-1]])
    number = np.cumsum(new_word) - 1
    shared = np.bincount(number, new_pair)[number] > 1
    known = np.bincount(u, shared, n) / length
    repeats = 1 - np.bincount(u[new_pair], minlength=n) / length
    return np.stack([np.ones(n), share, share > 0, share >= 1, length < SIZE, again, known, repeats], 1).astype(np.float64)


class LineCrf:
    """Linear-chain CRF over the units of a document: emission weights (labels x features), transitions (labels x labels)."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None) -> None:
        self.emit = np.zeros((LABELS, N_FEATURES)) if emit is None else emit
        self.move = np.zeros((LABELS, LABELS)) if move is None else move

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 40, rate: float = 1.0, decay: float = 1e-3) -> LineCrf:
        """Gradient ascent on the log-likelihood of labelled chains (features, labels)."""
        for _ in range(rounds):
            g_emit, g_move, n = -decay * self.emit, -decay * self.move, 0
            for x, y in chains:
                node, edge = self.marginals(x)
                want = np.eye(LABELS)[y]
                g_emit = g_emit + (want - node).T @ x / 50
                if len(y) > 1:
                    pairs = np.zeros((LABELS, LABELS))
                    np.add.at(pairs, (y[:-1], y[1:]), 1)
                    g_move = g_move + (pairs - edge) / 50
                n += 1
            self.emit = self.emit + rate * g_emit / max(n / 50, 1)
            self.move = self.move + rate * g_move / max(n / 50, 1)
        return self

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = x @ self.emit.T
        n = len(score)
        a, b = score.copy(), np.zeros_like(score)
        for i in range(1, n):
            a[i] += np.logaddexp.reduce(a[i - 1][:, None] + self.move, 0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(self.move + score[i + 1] + b[i + 1], 1)
        z = np.logaddexp.reduce(a[-1])
        edge = np.zeros((LABELS, LABELS))
        for i in range(1, n):
            edge += np.exp(a[i - 1][:, None] + self.move + score[i] + b[i] - z)
        return np.exp(a + b - z), edge

    def viterbi(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Best labels of many chains at once; chain k has the rows from firsts[k] up to firsts[k + 1]."""
        score = x @ self.emit.T
        length = np.diff(firsts)
        best = np.zeros(len(x), np.int64)
        back = np.zeros((len(x), LABELS), np.int64)
        chains = np.argsort(-length, kind="stable")
        length, begin = length[chains], firsts[:-1][chains]
        live = int((length > 0).sum())
        at = score[begin[:live]].copy()
        for i in range(1, int(length[0]) if live else 0):
            live = int(np.searchsorted(-length, -i, "left"))
            step = at[:live, :, None] + self.move
            back[begin[:live] + i] = step.argmax(1)
            at[:live] = step.max(1) + score[begin[:live] + i]
        for i in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
            here = int(np.searchsorted(-length, -i, "left"))
            rows = begin[:here] + i
            last = length[:here] - 1 == i
            label = np.where(last, at[:here].argmax(1), 0)
            inner = np.flatnonzero(~last)
            label[inner] = back[rows[inner] + 1, best[rows[inner] + 1]]
            best[rows] = label
        return best


def training_chains(seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled chains: documents of made-up sentences of which some are said again."""
    rng = np.random.default_rng(seed)
    chains = []
    for d in range(TRAINING_DOCUMENTS):
        pool = [(1 + 3000 * rng.random(rng.integers(3, 25)) ** 3).astype(np.int64) for _ in range(rng.integers(2, 16))]  # some words are frequent
        rows = [(u, 0) for u in pool]
        if d % 4:
            for k in rng.choice(len(pool), rng.integers(1, min(4, len(pool) + 1)), replace=False):
                if len(pool[k]) >= SIZE:
                    at = rng.integers(0, len(rows) + 1)
                    rows = [(u, 1 if u is pool[k] else y) for u, y in rows]
                    rows[at:at] = [(pool[k], 1)] * int(rng.integers(1, 7))
        words = np.concatenate([u for u, _ in rows]).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum([len(u) for u, _ in rows])])
        cover = covered(mix(words), np.array([0, len(words)]))
        chains.append((features(cover, mix(words), starts, np.array([0, len(rows)])), np.array([y for _, y in rows])))
    return chains


def trained() -> LineCrf:
    return LineCrf().fit(training_chains())


def repetition(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_content: float = 0.6, crf: LineCrf | None = None) -> DataFrame:
    """(id, words, boilerplate_share, repeated_share, retained) of each row.

    ``boilerplate_share`` is the share of words in units that the Viterbi path marks as boilerplate; a document is
    ``retained`` if more than ``least_content`` of its words are content.  ``repeated_share`` is exact for every document,
    whatever its labels.
    """
    crf = crf or trained()
    schema = T.StructType(
        [
            T.StructField(id_column, T.LongType()),
            T.StructField("words", T.LongType()),
            T.StructField("boilerplate_share", T.DoubleType()),
            T.StructField("repeated_share", T.DoubleType()),
            T.StructField("retained", T.BooleanType()),
        ]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for whole in batches:
            for batch in pieces(whole, [1]):
                codes: list[int] = []
                starts, unit_starts, unit_firsts = [0], [0], [0]
                for text in batch.column(1).to_pylist():
                    for u in units(text or ""):
                        codes += coder.of(u)
                        unit_starts.append(len(codes))
                    starts.append(len(codes))
                    unit_firsts.append(len(unit_starts) - 1)
                bounds, edges, firsts = np.array(starts), np.array(unit_starts), np.array(unit_firsts)
                mixed = mix(np.array(codes, np.uint64))
                cover = covered(mixed, bounds)
                label = crf.viterbi(features(cover, mixed, edges, firsts), firsts)
                sums = np.concatenate([[0], np.cumsum(np.repeat(label, np.diff(edges)))])
                exact = np.concatenate([[0], np.cumsum(cover)])
                words = np.diff(bounds)
                marked = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(words, 1)
                share = (exact[bounds[1:]] - exact[bounds[:-1]]) / np.maximum(words, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(marked), pa.array(share), pa.array(1 - marked > least_content)], schema.names)

    return df.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string")).mapInArrow(kernel, schema)
