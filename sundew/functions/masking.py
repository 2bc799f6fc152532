"""Masking and display of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of types.
DISPLAY = {
    "TFN": "Tax File Number", "ABN": "Australian Business Number", "MEDICARE": "Medicare Number", "BSB": "Bank State Branch",
    "CREDIT_CARD": "Credit Card", "EMAIL": "Email Address", "PHONE": "Phone Number", "NAME": "Personal Name",
    "ADDRESS": "Physical Address", "PASSPORT": "Passport Number", "DRIVER_LICENSE": "Driver License", "IP_ADDRESS": "IP Address",
}


def masked(value: Column, kind: Column) -> Column:
    """The value with its middle starred, by the rule of its type; short values are starred whole; null stays null."""
    n = F.length(value)
    head = lambda k: F.substring(value, 1, k)
    tail = lambda k: F.when(n >= k, F.right(value, F.lit(k))).otherwise(value)
    parts = F.split(value, "@", -1)
    local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    middle = F.concat(head(1), F.repeat(F.lit("*"), F.greatest(n - 2, F.lit(0))), tail(1))
    return (
        F.when(n == 0, value)
        .when((kind == "TFN") & (n >= 9), F.concat(head(3), F.lit("****"), tail(2)))
        .when((kind == "MEDICARE") & (n >= 10), F.concat(head(2), F.lit("******"), tail(2)))
        .when((kind == "CREDIT_CARD") & (n >= 12), F.concat(F.lit("*" * 12), tail(4)))
        .when((kind == "EMAIL") & (F.size(parts) == 2) & (F.length(local) > 2), F.concat(F.substring(local, 1, 2), F.lit("***@"), domain))
        .when((kind == "PHONE") & (n >= 10), F.concat(head(4), F.lit("****"), tail(2)))
        .when(n > 2, middle)
        .otherwise(F.repeat(F.lit("*"), n))
    )


def lookup(key: Column, table: dict[str, object], default: Column) -> Column:
    """A small fixed table as one CASE expression."""
    out = default
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def display(kind: Column) -> Column:
    """The display name of a type, else the type itself."""
    return lookup(kind, DISPLAY, kind)
