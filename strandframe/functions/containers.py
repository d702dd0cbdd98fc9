"""Vector, set, map, heap and bit operations as functions on arrays, maps and integers. Null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(v: Column) -> Column:
    return F.get(v, F.lit(0))


def middle(v: Column) -> Column:
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def last(v: Column) -> Column:
    return F.get(v, F.size(v) - 1)


def index_of(v: Column, value: Column) -> Column:
    """Position from 0, or -1."""
    return (F.array_position(v, value) - 1).cast("int")


def copy_range(v: Column, start: int, end: int) -> Column:
    """Elements start..end, from 0, both inclusive."""
    return F.slice(v, start + 1, end - start + 1)


def any_element(v: Column) -> Column:
    """Some element of a set; null for an empty one."""
    return F.get(v, F.lit(0))


def sort_by(v: Column, comparator: Callable[[Column, Column], Column]) -> Column:
    """Sorted by a comparator of two elements: negative, 0 or positive."""
    return F.array_sort(v, lambda a, b: F.signum(comparator(a, b)).cast("int"))


def bit_get(x: Column, i: int) -> Column:
    return F.shiftright(x, i).bitwiseAND(F.lit(1)).cast("int")


def bit_set(x: Column, i: int) -> Column:
    return x.bitwiseOR(F.lit(1 << i))


def bit_clear(x: Column, i: int) -> Column:
    return x.bitwiseAND(F.lit(~(1 << i)))
