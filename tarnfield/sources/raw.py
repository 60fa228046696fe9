"""Raw values by key and lists of ids by key, as tables of a catalog: writes join its transactions and are undone with them."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.core import id_frame
from ..spec import table_spec
from .catalog import Catalog


class _Kept:
    blocks: tuple[str, ...]
    schema: str

    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name = catalog, name
        if name not in (catalog._open or catalog.snapshot()).tables:
            catalog.create(table_spec(name, list(self.blocks)), schema=self.schema)

    @property
    def df(self) -> DataFrame:
        return self.catalog.table(self.name, links=False).df

    def _put(self, rows: DataFrame) -> None:
        with self.catalog.transaction(f"put {self.name}") as t:
            t.replace(self.name, self.catalog.table(self.name, links=False), rows, "put")

    def _gone(self, ids: DataFrame) -> None:
        with self.catalog.transaction(f"del {self.name}") as t:
            t.gone(self.name, ids)


class Keyed(_Kept):
    blocks, schema = ("key", "value"), "key string, value string"

    def put(self, rows: DataFrame) -> None:
        """rows: key, value. Of rows with one key the largest value stays; rows with a null key are left out."""
        key, value = rows.columns[:2]
        pairs = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).filter("key IS NOT NULL")
        self._put(pairs.groupBy("key").agg(F.max("value").alias("value")))

    def delete(self, keys: DataFrame | Iterable) -> None:
        self._gone(self._wanted(keys))

    def _wanted(self, keys: DataFrame | Iterable) -> DataFrame:
        return id_frame(self.catalog.table(self.name, links=False), keys)

    def get(self, keys: DataFrame | Iterable) -> DataFrame:
        return self.df.join(self._wanted(keys), "key", "left_semi")

    def exist(self, keys: DataFrame | Iterable) -> DataFrame:
        """key, there (of each key asked for, once)."""
        have = self.df.select("key", F.lit(True).alias("own"))
        return self._wanted(keys).distinct().join(have, "key", "left").select("key", F.coalesce("own", F.lit(False)).alias("there"))

    def scan(self, mode: str = "pairs", keep: Column | None = None, limit: int = 0) -> DataFrame | int:
        """keys, values, pairs (each, hash), or their count; of the rows that satisfy `keep`, and at most `limit` if it is given."""
        df = self.df if keep is None else self.df.filter(keep)
        df = df.limit(limit) if limit else df
        match mode.lower():
            case "count":
                return df.count()
            case "keys":
                return df.select("key")
            case "values" | "value":
                return df.select("value")
            case "pairs" | "each" | "hash":
                return df
        raise ValueError(f"no mode {mode!r}")


class Lists(_Kept):
    """A row for each id of each list, so that a list of any length is spread over files and never one value."""

    blocks, schema = ("entry", "key", "id"), "entry string, key string, id long"

    @staticmethod
    def _entries(rows: DataFrame) -> DataFrame:
        key, id_ = rows.columns[:2]
        own = rows.select(F.col(key).cast("string").alias("key"), F.col(id_).cast("long").alias("id")).filter("key IS NOT NULL AND id IS NOT NULL")
        # the id first: it has no blank, so entries of different rows are different
        return own.select(F.concat_ws(" ", F.col("id").cast("string"), "key").alias("entry"), "key", "id").distinct()

    def put(self, rows: DataFrame) -> None:
        """rows: key, id. An id that a list has already stays once."""
        self._put(self._entries(rows))

    def delete(self, rows: DataFrame) -> None:
        """rows: key, id."""
        self._gone(self._entries(rows).select("entry"))

    def drop(self, *keys: Any) -> None:
        """Whole lists."""
        self._gone(self.df.filter(F.col("key").isin([str(k) for k in keys])).select("entry"))

    def count(self, *keys: Any) -> DataFrame:
        """key, n of the lists that have ids."""
        return self.df.filter(F.col("key").isin([str(k) for k in keys])).groupBy("key").agg(F.count("*").alias("n"))

    def get(self, *keys: Any, offset: int = 0, limit: int = 0, ascending: bool = False) -> DataFrame:
        """key, id; with an offset or limit those ids of each list, largest first unless ascending. Spark keeps only the first
        offset + limit of a list in each partition before it shuffles."""
        found = self.df.filter(F.col("key").isin([str(k) for k in keys])).select("key", "id")
        order = F.col("id").asc() if ascending else F.col("id").desc()
        if not offset and not limit:
            return found
        if len(keys) == 1:
            ordered = found.orderBy(order)
            ordered = ordered.offset(offset) if offset else ordered
            return ordered.limit(limit) if limit else ordered
        place = F.row_number().over(Window.partitionBy("key").orderBy(order))
        placed = found.withColumn("__place", place).filter(F.col("__place") > offset)
        return (placed.filter(F.col("__place") <= offset + limit) if limit else placed).drop("__place")
