"""Sets of ids as DataFrames with one column."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.select(b[b.columns[0]].alias(a.columns[0]))


def encoded(ids: DataFrame) -> DataFrame:
    """The set of ids that may be stored: distinct, above 0."""
    c = ids.columns[0]
    return ids.filter(F.col(c) > 0).select(c).distinct()


def union(sets: Iterable[DataFrame]) -> DataFrame:
    sets = list(sets)
    return reduce(lambda a, b: a.union(_same(sets[0], b)), sets).distinct()


def crop(a: DataFrame, b: DataFrame, option: int = 0) -> DataFrame:
    """What both have: 0 in any order, 1 ascending, 2 in the order of b's column pos."""
    c = a.columns[0]
    if option == 2:
        own = b.select(b[b.columns[0]].alias(c), "pos").groupBy(c).agg(F.min("pos").alias("pos"))
        return own.join(a.select(c).distinct(), c, "left_semi").orderBy("pos").select(c)
    out = a.select(c).intersect(_same(a, b))
    return out.orderBy(c) if option == 1 else out


def punch(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(a.columns[0]).distinct().join(_same(a, b), a.columns[0], "left_anti")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return union([a.select(a.columns[0]), b])


def found(a: DataFrame, value) -> DataFrame:
    return a.filter(F.col(a.columns[0]) == value).limit(1)


def count(a: DataFrame) -> DataFrame:
    return a.agg(F.count_distinct(a.columns[0]).alias("n"))


def sliced(a: DataFrame, offset: int = 0, limit: int = 0, ascending: bool = False) -> DataFrame:
    """A slice of the set in descending order, or ascending."""
    c = F.col(a.columns[0])
    out = a.orderBy(c.asc() if ascending else c.desc()).offset(offset)
    return out.limit(limit) if limit else out
