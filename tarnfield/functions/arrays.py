"""Ordered lists as sets and as matrices, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def nodup(a: Column) -> Column:
    """Distinct values in order, without empty ones."""
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x.cast("string") != "")))


def add(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def crop(a: Column, b: Column) -> Column:
    """What both have, in the shorter one's order (the first's if equally long)."""
    return F.when(F.size(b) < F.size(a), F.array_intersect(b, a)).otherwise(F.array_intersect(a, b))


def crop_ordered(a: Column, b: Column, option: int = 0) -> Column:
    """What both have: 0 or 1 in the order of a, 2 in the order of b."""
    return F.array_intersect(b, a) if option == 2 else F.array_intersect(a, b)


def punch(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def without(a: Column, b: Column) -> Column:
    """a without b's values, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def without_positions(a: Column, positions: Column) -> Column:
    return F.filter(a, lambda x, i: ~F.array_contains(positions, i))


def keep(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(a, test)


def pick(a: Column, positions: list[int]) -> Column:
    return F.array(*[F.get(a, F.lit(i)) for i in positions])


def same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def chunks(a: Column, n: int) -> Column:
    """Lists of n (2, 3, 4, 6 or 12, else 2), the last filled up with ''."""
    n = n if n in (2, 3, 4, 6, 12) else 2
    count = F.ceil(F.size(a) / n).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.concat(F.slice(a, k * n + 1, n), F.array_repeat(F.lit(""), F.greatest(F.lit(n) - F.size(F.slice(a, k * n + 1, n)), F.lit(0)))))


def extent(matrix: Column) -> Column:
    """Last row and last column of a list of lists."""
    return F.struct((F.size(matrix) - 1).alias("row"), (F.array_max(F.transform(matrix, lambda r: F.size(r))) - 1).alias("col"))


def transpose(matrix: Column) -> Column:
    width = F.array_max(F.transform(matrix, lambda r: F.size(r)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(matrix, lambda r: F.get(r, j)))


def rank(a: Column, x: Column) -> Column:
    """Place of a value, -1 if it isn't there."""
    return F.array_position(a, x).cast("int") - 1


def key_diff(a: Column, b: Column) -> Column:
    """The entries whose keys only one of two maps has."""
    only = lambda p, q: F.map_filter(p, lambda k, _v: ~F.array_contains(F.map_keys(q), k))
    return F.map_concat(only(a, b), only(b, a))


def sort(a: Column, kind: str | None = None, ascending: bool = True) -> Column:
    """By number (a comma may be the decimal point, other signs are ignored, nothing is 0) or by text. The kind is the
    first value's unless it is given."""
    text = F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("")))
    number = lambda x: F.coalesce(F.regexp_replace(F.replace(x, F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))
    by_number = F.transform(F.array_sort(F.transform(text, lambda x, i: F.struct((number(x) if ascending else -number(x)).alias("k"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    by_text = F.sort_array(text, ascending)
    if kind:
        return by_number if kind in ("num", "number", "numeric", "decimal") else by_text
    first = F.get(F.filter(text, lambda x: x != ""), F.lit(0))
    return F.when(first.rlike(r"^-?[0-9]+([.,][0-9]+)?$"), by_number).otherwise(by_text)


def shuffled(a: Column) -> Column:
    return F.shuffle(a)
