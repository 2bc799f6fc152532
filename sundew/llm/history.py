"""New batches against all history: pivot distances, range-partitioned joins, exact verification, appended rows.

``pivot_table`` turns findings into rows that hold what a lookup needs: the place (repository and normalized path), the
line, a hash of the match's canonical form, and, for names, e-mail and street addresses, in which one slip of a letter
is forgiven, the distances of its sorted letters to fixed pivots (the empty text, so the length, and three texts).
Sorting the letters makes the distance blind to the order of fields; one slip moves it by at most ``MOVED``.  So by the
triangle inequality a match whose distance to any pivot differs by more cannot be meant.

``found_before`` looks a batch up in rows seen earlier.  These are first reduced to the earliest row per place, match and
line, so a match that was found a million times on one line meets a new row once.  Then one join serves all: both sides
are partitioned by ranges of lines and by what must agree, the match for repeats, and for slips the letters of one of
three classes (a slip touches two classes at most, so one keeps all its letters; ranges of a pivot's distance, which
were tried for this, hold too many of a hot file's names).  The distances prune pairs, and the true edit distance is
verified on what remains, all in the join's condition.

``SeenTable`` keeps what all batches brought, refused rows too, since a later finding may repeat one that was itself a
repeat.  It is stored by buckets of repositories, so a lookup reads the batch's buckets only; accepted or not, a batch's
reduced rows are appended, and nothing of the history is computed or written again.

Cases: rows with a null repository, path, line or match are never duplicates, so they are accepted; a scan without start
counts as later than all others; equal order keys are no duplicates of each other; an empty history makes nothing a
duplicate.  What is in a ``SeenTable`` came before whatever a later batch brings, also if that batch's scan is older:
the accepted copy stands and the late one is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.functions.let import let
from sundew.llm.variants import canonical

#: Sorted letters of the pivots besides the empty text; fixed values that lie far apart in letter space.
PIVOTS = ("aaaabbddeeee", "eeiiiillnnrrrr", "ghkmoooossttuuww")
#: Letters of two classes of about equal frequency in text; all others are the third.
CLASSES = ("etndcf", "aoslmgyb")
MOVED = 2
LINE_RANGE = 256
BUCKETS = 1024
NEVER = (1 << 63) - 1
ROW = "place bigint, line bigint, match bigint, started bigint, id bigint, canon string, slip_key bigint, pivots bigint, bucket int"

EMAIL_SHAPE = r"^[^\p{L}\p{N}]*[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+[^\p{L}\p{N}]*$"
PERSON_SHAPE = r"^[^\p{L}\p{N}]*\p{L}[\p{L}'’]+(?:\s*,\s*|\s+)\p{L}[\p{L}'’]+(?:\s+\p{L}[\p{L}'’]+)?[^\p{L}\p{N}]*$"
STREET_SHAPE = r"^[^\p{L}\p{N}]*\d{1,5}\p{L}?(?:\s*/\s*\d{1,5})?\s+\p{L}[\p{L}\s,;.'’-]*(?:\d{4})?[^\p{L}\p{N}]*$"


def file_key(path: Column, repository: Column) -> Column:
    """The path within its repository, however it is written: slashes, ./ and a local clone's folder don't matter."""
    name = F.regexp_extract(F.regexp_replace(repository, r"(?:\.git)?/*$", ""), r"([^/:]+)$", 1)
    slashed = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"/{2,}|/(?:\./)+", "/")
    absolute = slashed.rlike(r"^(?:/|[A-Za-z]:/)")
    folder = F.concat(F.lit("/"), name, F.lit("/"))
    at = F.instr(slashed, folder)
    local = absolute & (F.length(name) > 0) & (at > 0)
    within = F.when(local, F.substr(slashed, at + F.length(folder))).otherwise(slashed)
    return F.regexp_replace(within, r"^(?:\./)+", "")


def pivot_table(findings: DataFrame, scans: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per finding: finding_id, then ``ROW``: place, line, match hash, order (started, id), and for slips its
    canonical form, what must agree besides (kind and digits) and pivot distances, all in one number.  Place and all that
    follows from it are null where the finding can't be looked up.

    All is computed before the join with the scans, so that texts aren't shuffled.
    """
    known = F.col("repo_url").isNotNull() & F.col("file_path").isNotNull() & F.col("line_no").isNotNull() & F.col("match_text").isNotNull()
    text = F.when(known, F.col("match_text"))
    kind = F.when(text.rlike(PERSON_SHAPE), 1).when(text.rlike(EMAIL_SHAPE), 2).when(text.rlike(STREET_SHAPE), 3)
    base = findings.select(
        "finding_id",
        "scan_id",
        F.when(known, F.xxhash64("repo_url", file_key(F.col("file_path"), F.col("repo_url")))).alias("place"),
        F.when(known, F.col("line_no").cast("bigint")).alias("line"),
        canonical(text).alias("canon"),
        kind.alias("kind"),
        F.when(known, F.pmod(F.xxhash64("repo_url"), F.lit(buckets)).cast("int")).alias("bucket"),
    )
    slip = F.col("kind").isNotNull()
    letters = F.array_join(F.array_sort(F.split(F.regexp_replace("canon", r"[\s|]+", ""), "")), "")
    distances = [F.length("letters"), *[F.levenshtein("letters", F.lit(p)) for p in PIVOTS]]
    packed = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.least(d, F.lit(0x7FFF)).cast("bigint"), 16 * i) for i, d in enumerate(distances)])
    rows = base.withColumn("letters", F.when(slip, letters)).select(
        "finding_id",
        "scan_id",
        "place",
        "line",
        F.when(F.col("place").isNotNull(), F.xxhash64("canon", "place")).alias("match"),
        F.when(slip, F.col("canon")).alias("canon"),
        F.when(slip, F.xxhash64("place", "kind", F.regexp_replace("canon", r"\D+", ""))).alias("slip_key"),
        packed.alias("pivots"),
        "bucket",
    )
    starts = scans.select("scan_id", F.unix_micros("scan_started").alias("started"))
    return rows.join(starts, "scan_id", "left").select(
        "finding_id", "place", "line", "match", F.coalesce("started", F.lit(NEVER)).alias("started"), F.col("finding_id").alias("id"), "canon", "slip_key", "pivots", "bucket"
    )


def earliest(rows: DataFrame) -> DataFrame:
    """The earliest row (in ``ROW``'s columns) per place, match and line; rows that can't be looked up are left out."""
    first = F.min(F.struct("started", "id")).alias("first")
    same = [F.any_value(c).alias(c) for c in ("canon", "slip_key", "pivots", "bucket")]
    kept = rows.where(F.col("place").isNotNull()).groupBy("place", "match", "line").agg(first, *same)
    return kept.select("place", "line", "match", F.col("first.started").alias("started"), F.col("first.id").alias("id"), "canon", "slip_key", "pivots", "bucket")


def _swapped(a: Column, b: Column) -> Column:
    """Are two neighbouring letters of a exchanged in b?"""
    n = F.length(a)
    one = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b
    return (n == F.length(b)) & (n > 1) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), one)


def one_slip_apart(a: Column, b: Column) -> Column:
    """Do two texts differ by exactly one letter changed, missing or added, or by two neighbours swapped?"""
    return let(F.levenshtein(a, b, 2), lambda d: (d == 1) | ((d == 2) & _swapped(a, b)))


def slip_apart(a: Column, b: Column) -> Column:
    """As ``one_slip_apart`` for canonical forms.  Names (they have a space) are compared part by part, in any order."""

    def by_parts(x: Column, y: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(x) - 1)
        rest = lambda p, i: F.filter(p, lambda _, k: k != i)
        pair = lambda i, j: (rest(x, i) == rest(y, j)) & one_slip_apart(F.get(x, i), F.get(y, j))
        return (F.size(x) == F.size(y)) & F.exists(at, lambda i: F.exists(at, lambda j: pair(i, j)))

    split = lambda t: F.split(t, " ")
    return F.when(a.contains(" ") | b.contains(" "), by_parts(split(a), split(b))).otherwise(one_slip_apart(a, b))


def meetings(rows: DataFrame, reach: int = 0) -> DataFrame:
    """Each row once per key under which it may meet another: (k1, k2, line range); ``reach`` adds the ranges around.

    For repeats the key is place and match.  For slips it is what must agree and the letters of a class; only these
    rows keep ``canon`` and ``pivots``.  Both sides of a join explode their ranges, so that the planner sees the same
    plan below and reads one exchange twice.
    """
    others = "".join(CLASSES)
    letters = [F.regexp_replace("canon", f"[^{c}]", "") for c in CLASSES] + [F.regexp_replace("canon", rf"[{others}\s|]", "")]
    key = lambda a, b, slip: F.struct(a.alias("k1"), b.alias("k2"), F.lit(slip).alias("slip"))
    sorted_hash = lambda t: F.xxhash64(F.array_join(F.array_sort(F.split(t, "")), ""))
    exact = key(F.col("place"), F.col("match"), False)
    slips = [key(F.xxhash64("slip_key", F.lit(i)), sorted_hash(t), True) for i, t in enumerate(letters)]
    keys = F.when(F.col("canon").isNull(), F.array(exact)).otherwise(F.array(exact, *slips))
    width = F.lit(LINE_RANGE)
    ranges = F.sequence(F.floor((F.col("line") - reach) / width), F.floor((F.col("line") + reach) / width))
    out = rows.withColumn("_k", F.explode(keys)).withColumn("range", F.explode(ranges))
    only = lambda c: F.when(F.col("_k.slip"), F.col(c)).alias(c)
    return out.select(F.col("_k.k1").alias("k1"), F.col("_k.k2").alias("k2"), "range", "line", "started", "id", only("canon"), only("pivots"))


def found_before(new: DataFrame, old: DataFrame, line_reach: int = 25, ordered: bool = True) -> DataFrame:
    """(finding_id), once: the rows of ``new`` (a pivot table) for which ``old`` holds the same finding.

    ``ordered``: earlier in order (started, id); else anywhere, as suits history that came in before.
    """
    before = meetings(earliest(old))
    before = before.select("k1", "k2", "range", *[F.col(c).alias(f"old_{c}") for c in ("line", "started", "id", "canon", "pivots")])
    asked = meetings(new.where(F.col("place").isNotNull()), line_reach)
    met = F.abs(F.col("line") - F.col("old_line")) <= line_reach
    if ordered:
        met &= (F.col("old_started") < F.col("started")) | ((F.col("old_started") == F.col("started")) & (F.col("old_id") < F.col("id")))
    close = lambda i: F.abs(_distance("pivots", i) - _distance("old_pivots", i)) <= (MOVED if i else 1)
    near = reduce(lambda a, b: a & b, [close(i) for i in range(len(PIVOTS) + 1)])
    repeat = F.col("canon").isNull() & F.col("old_canon").isNull()
    slip = near & (F.col("canon") != F.col("old_canon")) & slip_apart(F.col("canon"), F.col("old_canon"))
    same_keys = reduce(lambda a, b: a & b, [asked[k] == before[k] for k in ("k1", "k2", "range")])
    return asked.join(before, same_keys & met & F.when(F.col("canon").isNull(), repeat).otherwise(slip), "left_semi").select(F.col("id").alias("finding_id")).distinct()


def _distance(packed: str, i: int) -> Column:
    return F.shiftright(F.col(packed), 16 * i).bitwiseAND(F.lit(0x7FFF))


def accept(batch: DataFrame, seen: DataFrame, line_reach: int = 25) -> DataFrame:
    """The rows of a batch (a pivot table) that neither ``seen`` nor the batch, earlier in order, holds already."""
    known = found_before(batch, seen, line_reach, ordered=False).unionByName(found_before(batch, batch, line_reach))
    return batch.join(known, "finding_id", "left_anti")


class SeenTable:
    """What all batches so far brought, in ``folder``: reduced rows (``ROW``) partitioned by the bucket of their repository.

    The folder must be one that all executors share.  A batch that was appended twice, as after a lost driver, changes
    no answer, since rows are reduced when read.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def rows(self, batch: DataFrame | None = None) -> DataFrame:
        """All rows, or those in the batch's buckets; at most ``BUCKETS`` numbers come to the driver for that."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ROW)
        held = self.spark.read.schema(ROW).parquet(self.folder)
        if batch is None:
            return held
        buckets = [r.bucket for r in batch.where(F.col("bucket").isNotNull()).select("bucket").distinct().collect()]
        return held.where(F.col("bucket").isin(buckets))

    def accepted(self, batch: DataFrame, line_reach: int = 25) -> DataFrame:
        return accept(batch, self.rows(batch), line_reach)

    def append(self, batch: DataFrame) -> None:
        """Adds what the batch brought; a hot repository's rows are spread over several files of its bucket."""
        earliest(batch).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.folder)
