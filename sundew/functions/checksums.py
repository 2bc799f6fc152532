"""Checksums of identifiers as Column expressions: numbers are padded to fixed width and weighed digit by digit."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sundew.functions.let import let

# The weights of each number's digits.
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)
ACN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 1)


def _digit(text: Column, i: int) -> Column:
    return F.coalesce(F.substring(text, i + 1, 1).try_cast("int"), F.lit(0))


def _weighted(text: Column, weights: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [_digit(text, i) * w for i, w in enumerate(weights)])


def tfn(value: Column) -> Column:
    """Is it a tax file number?  Spaces and dashes don't matter; null gives null."""
    bare = F.regexp_replace(value, r"[\t\n\f\r \-]", "")
    return let(bare, lambda clean: clean.rlike(r"^[0-9]{9}$") & (_weighted(clean, TFN_WEIGHTS) % 11 == 0))


def abn(value: Column) -> Column:
    """Is it a business number?  Its first digit counts one less."""
    bare = F.regexp_replace(value, r"[\t\n\f\r \-]", "")
    return let(bare, lambda clean: clean.rlike(r"^[0-9]{11}$") & ((_weighted(clean, ABN_WEIGHTS) - ABN_WEIGHTS[0]) % 89 == 0))


def medicare(value: Column) -> Column:
    """Is it a Medicare number, with or without its issue digit?"""
    return let(
        F.regexp_replace(value, r"[\t\n\f\r /\-]", ""),
        lambda clean: F.length(clean).between(10, 11)
        & F.substring(clean, 1, 1).isin("2", "3", "4", "5", "6")
        & (_weighted(clean, MEDICARE_WEIGHTS) % 10 == _digit(clean, 8)),
    )


def bsb(value: Column) -> Column:
    """Is it a bank and branch number?  The third digit tells the state."""
    return F.regexp_replace(value, r"[ \-]", "").rlike(r"^[0-9]{2}[2-7][0-9]{3}$")


def acn(value: Column) -> Column:
    """Is it a company number?"""
    bare = F.regexp_replace(value, r"[\t\n\f\r \-]", "")
    return let(bare, lambda clean: clean.rlike(r"^[0-9]{9}$") & (((10 - _weighted(clean, ACN_WEIGHTS) % 10) % 10) == _digit(clean, 8)))


#: Type -> check, in the order in which ``any_valid`` asks them.  ``register`` adds to it.
CHECKS: dict[str, Callable[[Column], Column]] = {"TFN": tfn, "ABN": abn, "MEDICARE": medicare, "BSB": bsb, "ACN": acn}


def register(kind: str, check: Callable[[Column], Column]) -> None:
    CHECKS[kind] = check


def normalized(kind: Column, value: Column) -> Column:
    """Digits only; a branch number of six digits gets its dash."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    dashed = F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 3))
    return F.when((kind == "BSB") & (F.length(digits) == 6), dashed).otherwise(digits)


def valid(kind: Column, value: Column) -> Column:
    """By the check of its type; null if the type has none."""
    out = F.lit(None).cast("boolean")
    for k, check in CHECKS.items():
        out = F.when(kind == k, check(value)).otherwise(out)
    return out


def any_valid(value: Column) -> Column:
    """The first type whose check accepts the value, else null."""
    return F.coalesce(*[F.when(check(value), F.lit(k)) for k, check in CHECKS.items()])


def confidence(kind: Column, value: Column) -> Column:
    """0.95 for a valid number, 0.5 for an invalid one, 0.8 where no check exists."""
    return let(valid(kind, value), confidence_of)


def confidence_of(ok: Column) -> Column:
    """The confidence that a check's outcome (null without a check) stands for."""
    return F.when(ok.isNull(), 0.8).when(ok, 0.95).otherwise(0.5)
