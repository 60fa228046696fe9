"""Lists built ahead for hot tables: value lists, word lists, prepared orders and suggestions, and the choice to use them.

A value list is a long table (block, value, tier, id), written partitioned by block and sorted by value within its files,
so that a lookup reads one folder and, by the files' minima and maxima, little of that. Reads with lists and reads without
give the same rows; tests hold them against each other.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import cells
from ..operators import core, search
from ..operators.core import Table
from ..session import scratch
from ..sources.files import Store


def postings(table: Table) -> DataFrame:
    """block, value, tier, id for every distinct value of each match block's cells."""
    df = core.with_tier(table)
    parts = F.array(*[F.struct(F.lit(table.spec.resolve(b)).alias("block"), F.array_distinct(core.values_of(table, b)).alias("vs")) for b in table.spec.match])
    return df.select(F.col(table.id), F.col(core.TIER).alias("tier"), F.explode(parts).alias("p")).select("p.block", F.explode("p.vs").alias("value"), "tier", table.id)


def matching_ids(table: Table, wanted: dict[int, list[str]], kind: str) -> DataFrame:
    """The ids that satisfy the choices, from the value lists: one scan of what the values have, one count for each id."""
    lists = table.postings
    hit = reduce(lambda a, b: a | b, [(F.col("block") == b) & F.col("value").isin([str(v) for v in vs]) for b, vs in wanted.items()])
    found = lists.filter(hit).select(table.id, "block")
    if kind.lower() == "or":
        return found.select(table.id).distinct()
    return found.groupBy(table.id).agg(F.count_distinct("block").alias("n")).filter(F.col("n") == len(wanted)).select(table.id)


def _dealt(table: Table) -> Table:
    """The table with its rows dealt by id over as many tasks as there are cores or more. A few million rows of short cells
    can lie in one Parquet row group, and making words and values costs far more than reading and moving the cells."""
    n = max(table.spark.sparkContext.defaultParallelism, int(table.spark.conf.get("spark.sql.shuffle.partitions")))
    return table.with_df(table.df.repartition(n, table.id))


def build(table: Table, folder: str, parts: int | None = None) -> Table:
    """Write the table's lists into a folder and give the table with them. A frequent value's rows lie in several files:
    rows are dealt by range of (block, value, id)."""
    spark = table.spark
    Store(spark, folder).delete("changes")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made, dealt = {}, _dealt(table)
    if table.spec.match:
        rows = postings(dealt).repartitionByRange(n, "block", "value", table.id).sortWithinPartitions("block", "value", table.id)
        rows.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/postings")
        made["postings"] = spark.read.parquet(f"{folder}/postings")
    if table.spec.search:
        rows = search.tokens(dealt).repartitionByRange(n, "block", "word", table.id).sortWithinPartitions("block", "word", table.id)
        rows.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/tokens")
        made["tokens"] = spark.read.parquet(f"{folder}/tokens")
    if table.spec.suggest:
        s = search.suggestions(table)
        s.prefixes.write.mode("overwrite").parquet(f"{folder}/prefixes")
        s.transitions.write.mode("overwrite").parquet(f"{folder}/transitions")
    return replace(table, **made)


def _lists(table: Table) -> dict:
    return {name: make for name, make, used in (("postings", postings, table.spec.match), ("tokens", search.tokens, table.spec.search)) if used}


def upkeep(table: Table, folder: str, rows: DataFrame | None = None, ids: DataFrame | None = None) -> Table:
    """Carry a write over to built lists and give the table with them: rows are the inserted or changed ones, ids those of
    deleted rows. Only the changed rows' words and values are made; `attached` leaves out what they replace. table is the
    table after the write. build() folds all changes in again."""
    spark, changes = table.spark, f"{folder}/changes"
    number = _number(spark, changes) + 1
    if rows is not None:  # what an update joins for its rows is joined once, not for each kind of list
        path = scratch(spark, "changed")
        rows.select(*table.df.columns).write.parquet(path)
        rows = spark.read.parquet(path)
    gone = [x.select(F.col(x.columns[0]).alias(table.id)) for x in (None if rows is None else rows.select(table.id), ids) if x is not None]
    if not gone:
        return attached(table, folder)
    if rows is not None:
        for name, make in _lists(table).items():
            made = make(table.with_df(rows))
            made.withColumn("change", F.lit(number)).write.mode("append").parquet(f"{changes}/{name}")
    # written last: a write that broke off before has changed nothing that attached() looks at
    reduce(lambda a, b: a.unionByName(b), gone).distinct().withColumn("change", F.lit(number)).write.mode("append").parquet(f"{changes}/gone")
    return attached(table, folder)


def _number(spark, changes: str) -> int:
    """Number of the last change that lists were told of."""
    if not Store(spark, changes).exists("gone"):
        return 0
    gone = spark.read.parquet(f"{changes}/gone")
    return gone.agg(F.max("change")).first()[0] or 0


def attached(table: Table, folder: str) -> Table:
    """The table with lists that were built before, and changed since by upkeep()."""
    read, changes = table.spark.read.parquet, f"{folder}/changes"
    number = _number(table.spark, changes)
    out = {}
    for name in _lists(table):
        rows = read(f"{folder}/{name}")
        if number:
            gone = read(f"{changes}/gone").groupBy(F.col(table.id).alias("__gone")).agg(F.max("change").alias("__change"))
            base = rows.join(gone, rows[table.id] == F.col("__gone"), "left_anti")
            if not Store(table.spark, changes).exists(name):  # only deletions so far
                out[name] = base
                continue
            new = read(f"{changes}/{name}")
            new = new.filter(F.col("change") <= number).join(gone, (new[table.id] == F.col("__gone")) & (F.col("change") == F.col("__change")), "left_semi").select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns])
            rows = base.unionByName(new)
        out[name] = rows
    return replace(table, **out)


def attached_suggestions(table: Table, folder: str) -> search.Suggestions:
    read = table.spark.read.parquet
    return search.Suggestions(read(f"{folder}/prefixes"), read(f"{folder}/transitions"))


def differences(table: Table) -> dict[str, int]:
    """Rows by which the lists differ from what the table's rows give now: 0 everywhere if they are fresh."""
    out = {}
    for name, have, want in (("postings", table.postings, postings), ("tokens", table.tokens, search.tokens)):
        if have is not None:
            now = want(replace(table, postings=None, tokens=None))
            cols = now.columns
            have = have.select(*[F.col(c).cast(now.schema[c].dataType) for c in cols])
            out[name] = have.exceptAll(now).count() + now.exceptAll(have).count()
    return out


def presorted(table: Table, block: int | str, folder: str, *, parts: int | None = None) -> DataFrame:
    """Ids in a block's prepared order, with its key `k` and their place: deep pages become a range of `place`, and ranges
    of values one of `k`, instead of a sort.

    Range partitions are sorted by themselves; places are a partition's start plus the row's place in it."""
    n = parts or int(table.spark.conf.get("spark.sql.shuffle.partitions"))
    key = core.order_key(table, core.Order(block, True))
    rows = table.df.select(key.alias("k"), F.col(table.id)).repartitionByRange(n, "k", table.id).sortWithinPartitions("k", table.id)
    rows.withColumn("m", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/raw")
    read = table.spark.read.parquet(f"{folder}/raw").withColumn("p", F.shiftright("m", 33))
    sizes = {r["p"]: r["n"] for r in read.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a number for each partition
    start, at = [], 0
    for p in sorted(sizes):
        start += [F.lit(p), F.lit(at)]
        at += sizes[p]
    base = F.element_at(F.create_map(*start), F.col("p")) if start else F.lit(0)
    placed = read.select("k", table.id, (base + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("place"))
    placed.write.mode("overwrite").parquet(f"{folder}/places")
    return table.spark.read.parquet(f"{folder}/places")


def page_of(table: Table, places: DataFrame, offset: int, limit: int, *, ascending: bool = False, total: int | None = None) -> DataFrame:
    """A page of a presorted table: only the page's ids meet the rows."""
    n = places.count() if total is None else total
    low = offset if ascending else n - offset - limit
    want = places.filter((F.col("place") >= low) & (F.col("place") < low + limit)).select(table.id, "place")
    out = table.df.join(F.broadcast(want), table.id)  # `limit` rows
    return out.orderBy(F.col("place").asc() if ascending else F.col("place").desc()).drop("place")


def range_slice(table: Table, block: int | str, places: DataFrame, low: Any = None, high: Any = None) -> DataFrame | None:
    """id, place of the prepared order's slice from low to high, both of them in it; an open end for None or "". None if the
    block has no prepared order and value list by its spec; inverted bounds give no rows. `places` is sorted by the key, so
    its files' minima and maxima leave little to read."""
    at = table.spec.resolve(block)
    if table.spec.sorted_type(at) is None or at not in map(table.spec.resolve, table.spec.match):
        return None
    rows = places.select(table.id, "place", "k")
    for end, is_low in ((low, True), (high, False)):
        if end in (None, ""):
            continue
        bound = F.lit(end)
        if isinstance(places.schema["k"].dataType, StringType):
            kind, width = table.spec.sorted_type(at)
            bound = cells.sort_key(F.lit(str(end)), kind, width)
        rows = rows.filter(F.col("k") >= bound if is_low else F.col("k") <= bound)
    return rows.select(table.id, "place")


def list_of(table: Table, block: int | str, value: Any, *, offset: int = 0, limit: int = 0, ascending: bool = False) -> DataFrame:
    """The ids in the list of a value, largest first unless ascending; with a limit each partition gives its best offset + limit."""
    key = F.col(table.id)
    found = table.postings.filter((F.col("block") == table.spec.resolve(block)) & (F.col("value") == str(value))).select(key).orderBy(key.asc() if ascending else key.desc())
    found = found.offset(offset) if offset else found
    return found.limit(limit) if limit else found


def lengths_of(table: Table, block: int | str, values: Iterable[Any]) -> DataFrame:
    """value, n of the lists asked for that have ids."""
    rows = table.postings.filter((F.col("block") == table.spec.resolve(block)) & F.col("value").isin([str(v) for v in values]))
    return rows.groupBy("value").agg(F.count("*").alias("n"))
