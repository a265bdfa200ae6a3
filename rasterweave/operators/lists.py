"""Lists as arrays, one a row, with the usual edits as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def append(items: Column, value: Column) -> Column:
    return F.array_append(items, value)


def prepend(items: Column, value: Column) -> Column:
    return F.array_prepend(items, value)


def insert_after(items: Column, index: Column, value: Column) -> Column:
    """After the item at a 0-based index; -1 is the front."""
    i = index.cast("int")
    return F.concat(F.slice(items, F.lit(1), i + 1), F.array(value), F.slice(items, i + 2, F.size(items)))


def insert_sorted(items: Column, value: Column) -> Column:
    """Into a sorted list, before items that are equal."""
    return F.concat(F.filter(items, lambda e: e < value), F.array(value), F.filter(items, lambda e: e >= value))


def insert_unique(items: Column, value: Column) -> Column:
    """Into a sorted list unless it is there."""
    return F.when(F.array_contains(items, value), items).otherwise(insert_sorted(items, value))


def append_unique(items: Column, value: Column) -> Column:
    return F.when(F.array_contains(items, value), items).otherwise(append(items, value))


def remove_first(items: Column, value: Column) -> Column:
    """Without the first item that is equal; null (not found) if there is none."""
    at = F.array_position(items, value).cast("int")
    return F.when(at > 0, F.concat(F.slice(items, F.lit(1), at - 1), F.slice(items, at + 1, F.size(items))))


def remove_at(items: Column, index: Column) -> Column:
    i = index.cast("int")
    return F.concat(F.slice(items, F.lit(1), i), F.slice(items, i + 2, F.size(items)))


def remove_between(items: Column, first: int, last: int) -> Column:
    """Without the items strictly between two 0-based places."""
    return F.concat(F.slice(items, 1, first + 1), F.slice(items, F.lit(last + 1), F.size(items)))


def remove_rest(items: Column, index: int) -> Column:
    """Without what comes after a 0-based place."""
    return F.slice(items, 1, index + 1)


def pop(items: Column) -> Column:
    """item and rest: the last item taken off."""
    n = F.size(items)
    return F.struct(F.when(n > 0, F.element_at(items, -1)).alias("item"), F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("rest"))


def peek_first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def peek_last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def sublist(items: Column, start: int, length: int) -> Column:
    return F.slice(items, start + 1, length)


def sparse(entries: list[tuple[int, int]]) -> Column:
    """A sparse list as a map from places to values."""
    return F.create_map(*[F.lit(x) for e in entries for x in e])


def sparse_sublist(items: Column, start: int, length: int) -> Column:
    """Places start .. start + length - 1, counted from 0."""
    inside = F.map_filter(items, lambda k, v: (k >= start) & (k < start + length))
    return F.transform_keys(inside, lambda k, v: k - start)
