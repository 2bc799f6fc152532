"""The matchers of the pattern detector: one table that column expressions and the Arrow kernel both read.

A matcher is a pattern, what is looked at before a match counts, and a hint: a cheap pattern that every text with a match
contains.  ``register`` adds one; null values are never accepted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sundew.functions import patterns


@dataclass(frozen=True)
class Check:
    """What the value without the characters ``strip`` must be like: one of the ``lengths``, with the prefix that the length
    asks for, or ``at_least`` so long; its first character in the range ``first``; none of the prefixes ``never``.  The value
    as it stands must have none of the prefixes ``raw_never`` and none of the ``words`` (whatever their case)."""

    strip: str = ""
    lengths: dict[int, str] = field(default_factory=dict)
    at_least: int = 0
    first: tuple[str, str] | None = None
    never: tuple[str, ...] = ()
    raw_never: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()

    def column(self, value: Column) -> Column:
        bare = F.regexp_replace(value, self.strip, "") if self.strip else value
        tests = []
        if self.lengths:
            tests.append(reduce(lambda a, b: a | b, [(F.length(bare) == n) & bare.startswith(p) if p else F.length(bare) == n for n, p in self.lengths.items()]))
        if self.at_least:
            tests.append(F.length(bare) >= self.at_least)
        if self.first:
            tests.append(F.substring(bare, 1, 1).between(*self.first))
        tests += [~bare.startswith(p) for p in self.never] + [~value.startswith(p) for p in self.raw_never]
        if self.words:
            tests.append(~F.lower(value).rlike(patterns.any_of(self.words)))
        tests += [value.rlike(patterns.java(p)) for p in self.must] + [~value.rlike(patterns.java(p)) for p in self.must_not]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def holds(self, value: str) -> bool:
        bare = re.sub(self.strip, "", value) if self.strip else value
        if self.lengths and not (len(bare) in self.lengths and bare.startswith(self.lengths[len(bare)])):
            return False
        if len(bare) < self.at_least or (self.first and not self.first[0] <= bare[:1] <= self.first[1]):
            return False
        if bare.startswith(self.never) or value.startswith(self.raw_never):
            return False
        low = value.lower()
        if any(w in low for w in self.words):
            return False
        return all(re.search(patterns.python(p), value, re.ASCII) for p in self.must) and not any(re.search(patterns.python(p), value, re.ASCII) for p in self.must_not)


@dataclass(frozen=True)
class Matcher:
    pattern: str
    check: Check = field(default_factory=Check)
    #: Pattern of the value within a match, if it isn't the whole match.
    inner: str = ""
    #: Found in every text with a match; the pattern itself if there is none cheaper.
    hint: str = ""


THREE_DIGITS = r"[0-9]{3}"
_BARE = r"[\t\n\f\r \-]"
NAME_CHECK = Check(words=patterns.NOT_NAMES + patterns.NOT_NAME_PARTS, must=("^[A-Za-z ]+$", "[a-z]"), must_not=("(?:^| )[A-Za-z]{1,2}(?: |$)",))
TABLE: dict[str, Matcher] = {
    "ABN": Matcher(patterns.MATCHERS["ABN"], Check(" ", {11: ""}, never=("614",)), hint=THREE_DIGITS),
    "MEDICARE": Matcher(patterns.MATCHERS["MEDICARE"], Check(r"[\t\n\f\r /\-]", at_least=10), hint=THREE_DIGITS),
    "TFN": Matcher(patterns.MATCHERS["TFN"], Check(_BARE, {9: ""}, never=("0",)), hint=THREE_DIGITS),
    "BSB": Matcher(patterns.MATCHERS["BSB"], Check(_BARE, {6: ""}, first=("0", "7")), hint=THREE_DIGITS),
    "ACN": Matcher(patterns.MATCHERS["ACN"], Check(" ", {9: ""}), inner=patterns.ACN_DIGITS, hint=THREE_DIGITS),
    "PHONE": Matcher(patterns.MATCHERS["PHONE"], Check("[^0-9]", {10: "", 11: "61"}), hint=rf"{THREE_DIGITS}|\([0-9]{{2}}\)|0[2-9](?:[\t\n\f\r .-]?[0-9]){{8}}"),
    "EMAIL": Matcher(patterns.MATCHERS["EMAIL"], hint="@"),
    "DRIVER_LICENSE": Matcher(patterns.MATCHERS["DRIVER_LICENSE"], Check("[^0-9]", never=("1300", "1800", "04"), raw_never=("0",)), hint=THREE_DIGITS),
    "NAME": Matcher(patterns.MATCHERS["NAME"], NAME_CHECK, hint=r"[A-Z][a-z]{2,}[\t\n\f\r ]+[A-Z][a-z]"),
}


def register(kind: str, matcher: Matcher) -> None:
    """Adds a matcher, or replaces one; detection then looks for it too, after those that were there before."""
    re.compile(patterns.python(matcher.pattern))
    TABLE[kind] = matcher


def may_match(kinds: tuple[str, ...]) -> str:
    """A pattern for the JVM that every text contains in which one of the kinds can match."""
    hints = dict.fromkeys(TABLE[k].hint or patterns.java(TABLE[k].pattern) for k in kinds)
    return "|".join(f"(?:{h})" for h in hints)
