"""Bi-temporal predicates: world time is [valid_at, invalid_at), system time ends at expired_at. Open ends are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The states a memory may move to.
TRANSITIONS = {
    "pending": ("active",), "active": ("consolidated", "invalidated", "archived"), "consolidated": ("archived", "expired"),
    "invalidated": ("expired",), "archived": ("active", "expired"), "expired": (),
}


def active_at(t: Column, valid: Column, invalid: Column, expired: Column | None = None) -> Column:
    out = (valid <= t) & (invalid.isNull() | (t < invalid))
    return out if expired is None else out & (expired.isNull() | (t < expired))


def active_between(start: Column, end: Column, valid: Column, invalid: Column) -> Column:
    return (valid <= end) & (invalid.isNull() | (invalid > start))


def overlaps(valid_a: Column, invalid_a: Column, valid_b: Column, invalid_b: Column) -> Column:
    return (invalid_b.isNull() | (valid_a < invalid_b)) & (invalid_a.isNull() | (valid_b < invalid_a))


def may_move(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for k, to in TRANSITIONS.items():
        out = F.when(old == k, new.isin(*to) if to else F.lit(False)).otherwise(out)
    return out
