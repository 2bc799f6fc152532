"""Hand-written source against generated, minified, data-like and vendored files.

Each file gets what one look at it can tell: a generator's notice in its head comment, lock files and generator output
by name and shape, minified code, data kept as code, binaries under a code extension, a third party's notice.  Copies
of libraries are found across repositories: the file's tokens without comments and layout are fingerprinted by
winnowing (hashes of ``K`` tokens, the least of each window of ``W``), and a file most of whose fingerprints recur in
repositories of at least ``min_owners`` owners, unrelated ones that is, is a copy of a library.  In the library's own
repository, the one named like the file or its notice, the file is hand-written.

Files with equal normalized tokens share one fingerprint list (the digest of their tokens).  A list that by itself stands
in repositories of enough owners recurs outright and counts each of its fingerprints once, so exact copies, which may be
a third of all files, are never spread over their repositories; other lists have fewer owners than that.  Owners of a
fingerprint are counted with map-side combining; nothing is collected per group.  Files that a notice, their name or
shape decides are no fingerprints' evidence.

Cases: null text under a code extension is a binary under a code extension; other null texts and empty texts are not
flagged; texts of fewer than ``K`` tokens are no evidence of copying; a null path or repository matches no rule about it; repeated rows get the same result; every fingerprint of a
text counts, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundew.llm.words import Coder, mix, pieces, window_starts
from sundew.session import durable

K = 24
W = 8
LONG_LINE = 200
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CODE_EXTENSIONS = (
    "c", "cc", "cpp", "cs", "css", "go", "h", "hpp", "java", "js", "jsx", "kt", "lua", "m", "mjs", "php", "pl", "ps1", "py", "r",
    "rb", "rs", "scala", "sh", "sql", "swift", "ts", "tsx", "vb",
)
LOCK_FILE = re.compile(r"(?i)(?:^|/)(?:[\w.-]*[.-]lock(?:\.json|\.ya?ml|b)?|go\.sum|npm-shrinkwrap\.json|package-lock\.json|gradle\.lockfile|packages\.lock\.json)$")
GENERATED_PATH = re.compile(r"(?i)(?:^|/)(?:target|build|obj)/generated(?:-sources|-test-sources|-src)?/|(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.g\.cs|\.designer\.cs)$")
COMMENT_LINE = re.compile(r"^\s*(?://|#(?!!)|--|/\*|\*|<!--|;|%|\"\"\"|''')")
#: What may stand before or between the comments at the head.
PREAMBLE = re.compile(r"""(?i)(?:#!.*|<\?php|<\?xml\b[^>]*\?>|(?P<q>["'])use [a-z]+(?P=q);?|declare\s*\(\s*strict_types\s*=\s*[01]\s*\)\s*;)$""")
#: What a generator writes about its output, in several languages; looked for in comments at the head only.
GENERATOR_NOTICE = re.compile(
    r"""(?ix)
      code\ generated\ by\b.*\bdo\ not\ edit
    | \b(?:auto(?:matically)?[-\ ]?generated|autogenerated)\b(?!\s+(?:by\ hand|report))
    | <auto-generated | @generated\b
    | \b(?:file|code|source|module|class)\b[^\n]{0,40}\b(?:was|is|has\ been)\b[^\n]{0,20}\b(?:automatically|machine)[-\ ](?:created|generated|written|produced)
    | \b(?:automatically|machine)[-\ ](?:created|generated|produced)\ by\b
    | \bgenerated\ (?:by|from|with|using)\b[^\n]{0,80}(?:do\ not\ (?:edit|modify)(?!\s+\w+\s+by\ hand)|changes\ (?:will|may)\ be\ (?:lost|overwritten))
    | automatisch\ (?:erzeugt|generiert|erstellt) | g[ée]n[ée]r[ée]\ automatiquement | generado\ autom[áa]ticamente
    | ^\W*source:\ [\w./-]+\.(?:proto|thrift|avsc|fbs|g4|y|l)\b
    | generated\ by\ the\ protocol\ buffer\ compiler
    """
)
BY_HAND = re.compile(r"(?i)\b(?:by hand|prints?|emits?|writes? out)\b[^\n]*\bgenerated\b|\bgenerated\b[^\n]*\bby hand\b")
#: A third party's notice: the library's name with a version, then its licence.
LIBRARY_NOTICE = re.compile(
    r"(?is)^\W*(?P<name>[A-Za-z][\w.-]*)\s+(?:-\s+)?(?:v(?:ersion)?\.?\s*)?\d+\.\d+(?:\.\d+)*\b.{0,160}?\b(?:licen[sc]ed?|MIT|BSD|Apache|MPL|ISC|contributors|Copyright)\b"
)
COMMENT = re.compile(r"/\*[\s\S]*?\*/|(?m:^)[ \t]*(?://|#(?!include|define|if|endif)|--)[^\r\n]*|[ \t]//[ \t][^\r\n]*")
STRING = re.compile(r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|[^\s\w]")
TABLE_CODE = re.compile(r"\bgoto\s+yy\d+|\byy_?(?:table|action|check|defact)\b|\bcase\s+\d+:\s*goto\b")
NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
RECORD = re.compile(r"(?m)^[^\s,;(){}]*(?:,[^\s,;(){}]*){2,}$")
BLOB = re.compile(r"[A-Za-z0-9+/=_-]{120,}|(?:\\x[0-9a-fA-F]{2}){30,}")


def head_comment(text: str) -> str:
    """The comment lines (also blank ones between them) that a text begins with; shebang, opening tag and directives aside."""
    out = []
    inside = False
    for line in text.lstrip("﻿").splitlines():
        s = line.strip()
        if not inside and PREAMBLE.match(s):
            continue
        if s and not inside and not COMMENT_LINE.match(line):
            break
        inside = (inside or "/*" in s) and "*/" not in s or (inside and "*/" not in s)
        out.append(line)
    return "\n".join(out)


def is_generated(path: str, text: str) -> bool:
    if LOCK_FILE.search(path) or GENERATED_PATH.search(path):
        return True
    head = head_comment(text)
    if head and any(GENERATOR_NOTICE.search(line) and not BY_HAND.search(line) for line in head.split("\n")):
        return True
    if "goto" not in text and "yy" not in text:
        return False
    tables = len(TABLE_CODE.findall(text))
    return tables >= 8 and tables * 20 > text.count("\n") * 5


def is_minified(text: str) -> bool:
    """Lines of ``LONG_LINE`` or more characters of code (strings aside) with hardly any white space, making up most of the text."""
    if max(map(len, text.splitlines()), default=0) < LONG_LINE:
        return False
    body = [x for x in STRING.sub("''", text).splitlines() if x.strip() and not COMMENT_LINE.match(x)]
    dense = [x for x in body if len(x) >= LONG_LINE and sum(map(x.count, " \t")) < 0.12 * len(x)]
    return sum(map(len, dense)) > 0.6 * sum(map(len, body))


def is_data(text: str) -> bool:
    """Mostly numbers, records or encoded bytes rather than statements."""
    words = text.split()
    size = sum(map(len, words))
    if max(map(len, words), default=0) >= 120 and sum(len(m[0]) for m in BLOB.finditer(text)) > 0.6 * size:
        return True
    if sum(map(text.count, "0123456789abcdefABCDEFxX.+-")) > 0.5 * size:  # of these numbers consist
        numbers = sum(len(m[0]) for m in NUMBER.finditer(text))
        if numbers > 0.5 * size and numbers + sum(map(text.count, ",;[](){}")) > 0.8 * size:
            return True
    lines = [x for x in text.splitlines() if x.strip()]
    records = [x for x in lines if RECORD.match(x)]
    return len(lines) >= 5 and len(records) >= 0.9 * len(lines)


def _stem(path: str) -> str:
    return path.replace("\\", "/").rstrip("/").rpartition("/")[2].split(".", 1)[0].lower()


def _library(text: str) -> str:
    m = LIBRARY_NOTICE.match(head_comment(text))
    return m["name"].lower() if m else ""


def fingerprints(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of many token streams at once: distinct hashes of K tokens, the least of each W in a row.

    ``codes`` are mixed token codes of all texts, text t's from starts[t] to starts[t + 1].  The hash of K tokens is a
    difference of prefix sums, so its cost doesn't depend on K.
    """
    powers = np.cumprod(np.full(len(codes) + 1, BASE))
    inverse = np.cumprod(np.full(len(codes) + 1, BASE_INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[: len(codes)], dtype=np.uint64)])
    firsts = window_starts(starts, K)
    h = mix((sums[firsts + K] - sums[firsts]) * inverse[firsts])
    counts = np.maximum(np.diff(starts) - K + 1, 0)
    edges = np.concatenate([[0], np.cumsum(counts)])
    at = window_starts(edges, W)
    least = h[at]
    for i in range(1, W):
        least = np.minimum(least, h[at + i])
    text = np.repeat(np.arange(len(counts)), counts)
    few = (counts <= W)[text] if len(text) else np.zeros(0, bool)
    text, h = np.concatenate([text[at], text[few]]), np.concatenate([least, h[few]])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


LOOK = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("owner", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("home", T.BooleanType()),
        T.StructField("noticed", T.BooleanType()),
        T.StructField("prints", T.ArrayType(T.LongType())),
    ]
)


def repository_key(url: Column) -> Column:
    """host/owner/name in lower case, however the address is spelled."""
    plain = F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z+]+://)?(?:[^@/]*@)?", "")
    return F.regexp_replace(F.regexp_replace(plain, ":", "/"), r"(?:\.git)?/*$", "")


def look(files: DataFrame) -> DataFrame:
    """One row per file (``LOOK``): what the file alone tells, a hash of its repository's owner, and its fingerprints unless
    the file is decided."""
    code = re.compile(r"(?i)\.(?:" + "|".join(CODE_EXTENSIONS) + r")$")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for whole in batches:
            for batch in pieces(whole, [5], 2000):
                reasons, homes, noticed = [], [], []
                codes: list[int] = []
                starts = [0]
                for repo, path, binary, text in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                    path = (path or "").replace("\\", "/")
                    reason, home, library = None, False, ""
                    if text is None:
                        if code.search(path):
                            reason = "data"
                    elif text.strip():
                        if binary or "\0" in text:
                            reason = "data" if code.search(path) else None
                        elif is_generated(path, text):
                            reason = "generated"
                        elif is_data(text):
                            reason = "data"
                        elif is_minified(text):
                            reason = "minified"
                        name, library = (repo or "").rpartition("/")[2], _library(text)
                        home = bool(name) and name in (_stem(path), library)
                        if reason is None:
                            tokens = TOKEN.findall(COMMENT.sub(" ", text))
                            if len(tokens) >= K:  # fewer are no evidence of copying
                                codes += coder.of(tokens)
                    starts.append(len(codes))
                    reasons.append(reason)
                    homes.append(home)
                    noticed.append(bool(library))
                mixed, bounds = mix(np.array(codes, np.uint64)), np.array(starts, np.int64)
                of, prints = fingerprints(mixed, bounds)
                place = np.arange(len(mixed)) - np.repeat(bounds[:-1], np.diff(bounds))
                weighed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * (mix(place.astype(np.uint64) + np.uint64(5)) | np.uint64(1)), dtype=np.uint64)])
                digests = (weighed[bounds[1:]] - weighed[bounds[:-1]]).astype(np.int64)
                ends = np.searchsorted(of, np.arange(len(bounds))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(digests, mask=np.diff(bounds) == 0), pa.array(reasons, pa.string()), pa.array(homes), pa.array(noticed),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(prints.astype(np.int64))),
                    ],
                    LOOK.names,
                )

    repo = repository_key(F.col("repo_url"))
    owner = F.xxhash64(F.regexp_replace(repo, r"/[^/]*$", ""))
    return files.select(
        F.col("file_id").cast("bigint"), F.when(repo.isNotNull(), owner).alias("owner"), repo.alias("repo"), F.col("rel_path"), F.col("is_binary"), F.col("file_text")
    ).mapInArrow(kernel, LOOK)


def recurring(seen: DataFrame, min_owners: int, min_share: float) -> DataFrame:
    """The digests of token streams of which at least ``min_share`` of the fingerprints recur with enough owners."""
    streams = seen.where(F.col("digest").isNotNull()).select("digest", "owner", "prints")
    owned = streams.where(F.col("owner").isNotNull()).select("digest", "owner").distinct()
    lists = streams.groupBy("digest").agg(F.any_value("prints").alias("prints"))
    spread = owned.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"))
    known = lists.join(spread, "digest", "left").withColumn("outright", F.coalesce("owners", F.lit(0)) >= min_owners)
    few = owned.join(known.where(~F.col("outright")), "digest").select("owner", F.lit(False).alias("outright"), F.explode("prints").alias("print"))
    many = known.where("outright").select(F.lit(None).cast("bigint").alias("owner"), "outright", F.explode("prints").alias("print"))
    by_owner = few.unionByName(many).groupBy("print", "owner").agg(F.max("outright").alias("outright"))
    common = by_owner.groupBy("print").agg(F.count("owner").alias("owners"), F.max("outright").alias("outright")).where(F.col("outright") | (F.col("owners") >= min_owners))
    held = known.where(~F.col("outright")).select("digest", F.size("prints").alias("n"), F.explode("prints").alias("print"))
    shares = held.join(common, "print", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"))
    return shares.where(F.col("hits") >= min_share * F.col("n")).select("digest").unionByName(spread.where(F.col("owners") >= min_owners).select("digest"))


def not_hand_written(files: DataFrame, min_owners: int = 3, min_share: float = 0.6) -> DataFrame:
    """(file_id, reason): generated, minified, data or vendored; one row per such row of ``files``."""
    seen = durable(look(files))  # three uses of one costly look
    vendored = recurring(seen, min_owners, min_share).withColumnRenamed("digest", "shared")
    joined = seen.drop("prints").join(vendored, F.col("digest") == F.col("shared"), "left")
    copied = (F.col("shared").isNotNull() | F.col("noticed")) & ~F.col("home")
    return joined.select("file_id", F.coalesce("reason", F.when(copied, "vendored")).alias("reason")).where(F.col("reason").isNotNull())
