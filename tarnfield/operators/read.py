"""Reads: whole tables and pages, single rows, lists of ids, and rows, counts and keys by a block's values.

Order is newest first unless it is asked for otherwise. Nulls and empty cells match nothing and are counted nowhere.
Results are lazy; only a page's total counts. Everything is built-in expressions, so simple comparisons reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import choices_of, order_of
from . import core
from .core import Page, Table

#: Ids that one entry of a value's list may hold at most: lists are cut by ranges of the id, so no group is unbounded.
LIST_SPAN = 65_536


def _filtered(df: DataFrame, c) -> DataFrame:
    return df if c is None else df.filter(c)


def read_all(table: Table, offset: int = 0, limit: int = 0, *, sort=None, dir: str | None = None, filter: dict | None = None, keys_only: bool = False, tier: str | None = None) -> Page:
    """The whole table or a page of it. Of `filter` only ranges count here."""
    df = _filtered(table.df, core.range_condition(table, filter))
    df, tiers = core.in_tier(table, df, tier)
    return core.paged(table, df, order_of(sort, dir), tiers, offset, limit, keys_only)


def read_id(table: Table, id=None, *, type: str | None = None, sort=None, dir: str | None = None, filter: dict | None = None, links: bool = True, deleted: bool = True) -> DataFrame:
    """One row: by id (then by its alias, then among deleted rows), or the first, last or a random one of an order."""
    if type:
        df = _filtered(table.df, core.range_condition(table, filter))
        if type in ("rand", "random"):
            return df.orderBy(F.rand()).limit(1)
        order = order_of(sort, "asc") if sort is None else order_of(sort, dir)
        up = (type == "first") != (str(dir or "").lower() == "desc")
        return df.orderBy(*core.ordering(table, core.Order(order.block, up, order.type))).limit(1)
    kind = table.df.schema[table.id].dataType.simpleString()
    key = F.lit(str(id)).try_cast(kind)
    found = table.df.filter(F.col(table.id) == key).withColumn("__at", F.lit(0))
    if links and table.aliases is not None:
        old, new = table.aliases.columns[:2]
        target = table.aliases.filter(F.col(old) == key).select(F.col(new).alias("__to")).limit(1)
        found = found.unionByName(table.df.join(F.broadcast(target), F.col(table.id) == F.col("__to"), "left_semi").withColumn("__at", F.lit(1)))
    if deleted and table.deleted is not None:
        found = found.unionByName(table.deleted.filter(F.col(table.id) == key).select(*table.df.columns).withColumn("__at", F.lit(2)), allowMissingColumns=True)
    return found.orderBy("__at").limit(1).drop("__at")


def read_first(table: Table, **options) -> DataFrame:
    return read_id(table, type="first", **options)


def read_last(table: Table, **options) -> DataFrame:
    return read_id(table, type="last", **options)


def read_random(table: Table, **options) -> DataFrame:
    return read_id(table, type="rand", **options)


def _places(table: Table, ids: Iterable) -> DataFrame:
    own = [(i, None if x is None else str(x)) for i, x in enumerate(ids)]
    if len(own) > core.LIST_IDS:
        raise ValueError(f"more than {core.LIST_IDS} ids in a list; join a DataFrame instead")
    kind = table.df.schema[table.id].dataType.simpleString()
    return F.broadcast(table.spark.createDataFrame(own, "__pos int, x string").select("__pos", F.col("x").try_cast(kind).alias("__want")))


def read_list(table: Table, ids: Iterable, keep_pos: bool = False) -> DataFrame:
    """Rows in the order asked for, repeats repeated, aliases followed, missing ids left out."""
    wanted = _places(table, ids)
    if table.aliases is not None:
        old, new = table.aliases.columns[:2]
        side = table.aliases.select(F.col(old).alias("__old"), F.col(new).alias("__new")).dropDuplicates(["__old"])
        wanted = F.broadcast(side.join(wanted, F.col("__old") == F.col("__want"), "right").select("__pos", F.coalesce("__new", "__want").alias("__want")))
    out = table.df.join(wanted, F.col(table.id) == F.col("__want")).orderBy("__pos")
    return out.select(*table.df.columns, F.col("__pos").alias("pos")) if keep_pos else out.select(*table.df.columns)


def read_links(table: Table, ids: DataFrame) -> DataFrame:
    """ids' columns and `canonical`: the id that each one's alias leads to, or itself."""
    if table.aliases is None:
        return ids.withColumn("canonical", F.col(table.id))
    old, new = table.aliases.columns[:2]
    side = table.aliases.select(F.col(old).alias("__old"), F.col(new).alias("__new")).dropDuplicates(["__old"])
    return ids.join(side, F.col(table.id) == F.col("__old"), "left").withColumn("canonical", F.coalesce("__new", table.id)).drop("__old", "__new")


def read_count(table: Table, ids: Iterable) -> DataFrame:
    """id, hits: the counter of each id, 0 if there is none."""
    wanted = _places(table, ids)
    if table.counters is None:
        return wanted.select(F.col("__want").alias(table.id), F.lit(0).cast("long").alias("hits"), "__pos").orderBy("__pos").drop("__pos")
    own = table.counters.select(F.col(table.counters.columns[0]).alias("__id"), F.col(table.counters.columns[1]).cast("long").alias("hits"))
    return own.join(wanted, F.col("__id") == F.col("__want"), "right").orderBy("__pos").select(F.col("__want").alias(table.id), F.coalesce("hits", F.lit(0)).alias("hits"))


def exist_list(table: Table, ids: Iterable) -> DataFrame:
    """id, found for each id asked for, in that order."""
    wanted = _places(table, ids)
    own = table.df.select(F.col(table.id).alias("__id")).join(wanted.select(F.col("__want").alias("__id")).distinct(), "__id", "left_semi").distinct()
    return own.join(wanted, F.col("__id") == F.col("__want"), "right").orderBy("__pos").select(F.col("__want").alias(table.id), F.col("__id").isNotNull().alias("found"))


def exist_id(table: Table, id) -> bool:
    return bool(read_id(table, id, links=False, deleted=False).limit(1).count())


def table_count(table: Table) -> int:
    return table.df.count()


def table_keys(table: Table, dir: str | None = None) -> DataFrame:
    return core.paged(table, table.df, order_of(None, dir), keys_only=True).df


def table_lastid(table: Table) -> DataFrame:
    """The largest id, deleted rows included."""
    ids = table.df.select(table.id)
    if table.deleted is not None:
        ids = ids.union(table.deleted.select(table.id))
    return ids.agg(F.max(table.id).alias("last_id"))


# -- by a block's values


def field_fetch(table: Table, block: int | str, values, offset: int = 0, limit: int = 0, *, sort=None, dir: str | None = None, filter: dict | None = None, keys_only: bool = False, tier: str | None = None) -> Page:
    """Rows whose block holds one of the values, ranges of `filter` applied."""
    wanted = choices_of(table.spec, {block: values})
    df = _filtered(_matching(table, wanted, "or"), core.range_condition(table, filter))
    df, tiers = core.in_tier(table, df, tier)
    return core.paged(table, df, order_of(sort, dir), tiers, offset, limit, keys_only)


def field_filter(table: Table, conditions: dict, *, type: str = "and", base_ids=None, sort=None, dir: str | None = None, offset: int = 0, limit: int = 0, keys_only: bool = False, tier: str | None = None) -> Page:
    """Rows for which all (or, with type "or", some) blocks hold one of their values; ranges must hold in any case."""
    df = core.restricted(table, _matching(table, choices_of(table.spec, conditions), type), base_ids)
    df = _filtered(df, core.range_condition(table, conditions))
    df, _ = core.in_tier(table, df, tier)
    return core.paged(table, df, order_of(sort, dir), "", offset, limit, keys_only)


def _matching(table: Table, wanted: dict[int, list[str]], kind: str) -> DataFrame:
    """By the value lists if they were built for these blocks, else by a scan; both give the same rows."""
    if not wanted:
        return table.df
    if table.postings is not None and set(wanted) <= {table.spec.resolve(b) for b in table.spec.match}:
        from ..plans.index import matching_ids

        return table.df.join(matching_ids(table, wanted, kind), table.id, "left_semi")
    return _filtered(table.df, core.condition(table, {b: v for b, v in wanted.items()}, kind))


def pairs(table: Table, block: int | str, tier: str | None = None) -> DataFrame:
    """value, id: each row once for each distinct value of the block."""
    df = table.df
    if tier:
        df, _ = core.in_tier(table, df, tier)
    return df.select(F.explode(F.array_distinct(core.values_of(table, block))).alias("value"), table.id)


def read_field(table: Table, block: int | str, values=None) -> DataFrame:
    """The ids whose block holds one of the values; without values the block's distinct values."""
    if values is None:
        return field_keys(table, [block])
    return field_fetch(table, block, values, keys_only=True).df


def field_keys(table: Table, blocks: Iterable[int | str]) -> DataFrame:
    """block (its name), value: the distinct values of one or more blocks, in one pass."""
    parts = F.array(*[F.struct(F.lit(table.column(b)).alias("block"), core.values_of(table, b).alias("vs")) for b in blocks])
    rows = table.df.select(F.explode(parts).alias("p")).select("p.block", F.explode("p.vs").alias("value"))
    return rows.distinct()


def field_keyvals(table: Table, block: int | str, key=None, span: int = LIST_SPAN) -> DataFrame:
    """value, part, ids: the ascending ids of each value, cut into parts of `span` consecutive ids so that a frequent
    value's list is spread over as many rows as it needs. Numeric ids only; pairs() has the long form for any."""
    df = pairs(table, block)
    if key is not None:
        df = df.filter(F.col("value") == str(key))
    part = F.floor(F.col(table.id) / span).cast("long")
    return df.groupBy("value", part.alias("part")).agg(F.sort_array(F.collect_set(table.id)).alias("ids"))


def field_count(table: Table, block: int | str, keys=None, tier: str | None = None) -> DataFrame:
    """value, n: rows for each value of a block; with keys (a list or "a, b") just those, 0 where there are none.

    Rows are counted on the map side before the shuffle, so frequent values don't make skew."""
    counts = pairs(table, block, tier).groupBy("value").agg(F.count("*").alias("n"))
    if keys is None:
        return counts
    wanted = [k.strip() for k in keys.split(",")] if isinstance(keys, str) else [str(k) for k in (keys if isinstance(keys, (list, tuple, set)) else [keys])]
    wanted = list(dict.fromkeys(k for k in wanted if k))
    side = F.broadcast(table.spark.createDataFrame([(k,) for k in wanted], "value string"))
    counts = pairs(table, block, tier).filter(F.col("value").isin(wanted)).groupBy("value").agg(F.count("*").alias("n"))
    return counts.join(side, "value", "right").select("value", F.coalesce("n", F.lit(0)).alias("n"))
