"""A journal of changes in segments: one is open for appends, sealed ones are read and deleted whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Store

OPEN = "open"


class Journal:
    """One writer at a time. Rows get a number `seq` that grows from append to append; numbers have gaps, and rows of one
    append are numbered as their partitions come."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def segments(self) -> list[str]:
        """The sealed ones, oldest first."""
        return self.store.names("sealed")

    def append(self, rows: DataFrame) -> None:
        start = self._last() + 1
        rows.select((F.monotonically_increasing_id() + F.lit(start)).alias("seq"), *rows.columns).write.parquet(self.store.at(f"{OPEN}/{uuid.uuid4().hex}"))

    def _last(self) -> int:
        """The largest number so far: of the open segment, or where it is empty of those before it."""
        top = self.scan(OPEN)
        found = top.agg(F.max("seq")).first()[0] if top is not None else None
        return self._sealed()[0] if found is None else found

    def _sealed(self) -> tuple[int, int]:
        """The largest number in sealed segments and the newest segment, deleted ones too."""
        return tuple(map(int, self.store.read("last").split())) if self.store.exists("last") else (-1, 0)

    def rotate(self) -> str | None:
        """Seal the open segment and give its name; nothing if it is empty."""
        if not self.store.names(OPEN):
            return None
        number = self._sealed()[1] + 1
        self.store.replace("last", f"{self._last()} {number}")
        self.store.rename(OPEN, f"sealed/{number:012}")
        return f"{number:012}"

    def scan(self, *segments: str) -> DataFrame | None:
        """The rows of the named segments, by default of all, the open one too; none if there are no rows."""
        paths = []
        for s in segments or (*self.segments(), OPEN):
            at = OPEN if s == OPEN else f"sealed/{s}"
            paths += [self.store.at(f"{at}/{n}") for n in self.store.names(at) if self.store.exists(f"{at}/{n}/_SUCCESS")]
        return self.spark.read.parquet(*paths) if paths else None

    def delete(self, segment: str) -> bool:
        return self.store.delete(f"sealed/{segment}")
