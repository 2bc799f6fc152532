"""Words of many texts as flat arrays, shared by the kernels that compare word sequences."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
MASK = (1 << 64) - 1


def pieces(batch: pa.RecordBatch, texts: list[int], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``size`` bytes in the text columns, so that what a kernel
    holds stays bounded; a longer text comes alone and whole."""
    n = sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    start, held = 0, 0
    for i, x in enumerate(n.tolist()):
        if i > start and (held + x > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += x
    if batch.num_rows > start:
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well-spread bits from any 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain(text: str) -> str:
    """Lower case without HTML tags and entities."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text.lower()


def word_code(word: str) -> int:
    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 32 | zlib.adler32(data)


class Coder:
    """Codes of words, remembered up to a fixed number of words."""

    def __init__(self, limit: int = 200_000) -> None:
        self.codes: dict[str, int] = {}
        self.limit = limit

    def of(self, words: list[str]) -> list[int]:
        codes = self.codes
        if len(codes) > self.limit:
            codes.clear()
        out = []
        for w in words:
            c = codes.get(w)
            if c is None:
                c = codes[w] = word_code(w)
            out.append(c)
        return out


def flat(texts: list[str | None], coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the mixed word codes of all texts after another, and where each text starts (one more at the end)."""
    codes: list[int] = []
    starts = [0]
    for t in texts:
        if t:
            codes += coder.of(WORD.findall(plain(t)))
        starts.append(len(codes))
    return mix(np.array(codes, np.uint64)), np.array(starts, np.int64)


def window_starts(starts: np.ndarray, size: int) -> np.ndarray:
    """First word of each window that lies within one text."""
    counts = np.maximum(np.diff(starts) - size + 1, 0)
    offsets = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(counts.sum()) + offsets


def one_slip(a: str, b: str) -> bool:
    """Equal but for one slip (a letter changed, missing, added, or two neighbours swapped)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[i + 1 :] == shorter[i:]
