"""Scans over an array inside one row, linear in its length.

A fold that appends to an array copies it at every step. A scan here writes the array as one text in which each known
value opens a segment, cuts that text once, and repeats each segment's value over its length. Values are numbers, flags or
other texts without control characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions.lines import with_previous
from quirekit.functions.rewrite import let

_OPEN, _VALUE, _PLACE = "\x1e", "\x1f", "\x1d"


def last_known(items: Column, kind: str = "string") -> Column:
    """For each place the last value at or before it that is not null, as ``array<kind>``."""
    written = F.array_join(
        F.transform(items, lambda x: F.when(x.isNull(), _PLACE).otherwise(F.concat(F.lit(_OPEN), x.cast("string"), F.lit(_VALUE + _PLACE)))), "")

    def spread(segment: Column, i: Column) -> Column:
        # The first segment lies before any known value.
        parts = F.split(segment, _VALUE, 2)
        return F.when(i == 0, F.array_repeat(F.lit(None).cast("string"), F.length(segment))).otherwise(
            let(parts, lambda x: F.array_repeat(x[0], F.length(x[1]))))

    return F.flatten(F.transform(F.split(written, _OPEN), spread)).cast(f"array<{kind}>")


def next_known(items: Column, kind: str = "string") -> Column:
    """For each place the first value at or behind it that is not null."""
    return F.reverse(last_known(F.reverse(items), kind))


def shifted(items: Column, by: int) -> Column:
    """The element ``by`` places on (back if negative) for each place, null outside."""
    return let(items, lambda held: F.transform(held, lambda _x, i: F.when(i + by >= 0, F.get(held, i + by))))


def marked(places: Column, size: Column) -> Column:
    """``size`` booleans, true at the given places from 0. Both are merged by one sort."""
    own = F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.cast("int").alias("at"), F.lit(True).alias("own")))
    hits = F.transform(places, lambda i: F.struct(i.cast("int").alias("at"), F.lit(False).alias("own")))
    met = with_previous(
        F.sort_array(F.concat(own, hits)), lambda cur, prev: F.when(cur["own"], F.coalesce(prev["at"] == cur["at"], F.lit(False))))
    return F.array_compact(met)


def first_of_each(keys: Column) -> Column:
    """For each place whether its key (not null) has not stood before; nulls are never first."""
    placed = F.filter(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at"))), lambda x: x["key"].isNotNull())
    firsts = F.array_compact(with_previous(F.sort_array(placed), lambda cur, prev: F.when(prev.isNull() | (prev["key"] != cur["key"]), cur["at"])))
    return let(keys, lambda held: marked(firsts, F.size(held)))

