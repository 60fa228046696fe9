"""Links between tables: display texts, whole linked rows, child rows, and slugs.

A cell may name several rows ("1,2"), so links are resolved by exploding the cell's ids, joining them with the linked
table's id and shown column, and putting them back together by the row's id. Only ids and shown texts are shuffled; a
small linked table is broadcast by Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import cells
from .core import Table

DEPTH = 4


def _entries(table: Table, df: DataFrame, block: int, other: Table, shown: int | str) -> DataFrame:
    """__rid, pos, id, shown for every id of the block's cells that the other table has. A whole-number cell is one id."""
    c, kind = F.col(table.column(block)), table.kind(block)
    names = other.df.select(F.col(other.id).cast("string").alias("__lid"), F.col(other.column(shown)).cast("string").alias("__shown")).dropDuplicates(["__lid"])
    each = df.select(F.col(table.id).alias("__rid"), F.posexplode(cells.values(c, kind)).alias("__pos", "__lid"))
    return each.join(names, "__lid")


def shown_texts(table: Table, df: DataFrame, block: int, other: Table, shown: int | str, name: str) -> DataFrame:
    """df with an array column of the texts shown for the block's ids, in the cell's order."""
    if table.kind(block).typeName() in ("integer", "long", "short"):
        names = other.df.select(F.col(other.id).cast("string").alias("__lid"), F.col(other.column(shown)).cast("string").alias("__shown")).dropDuplicates(["__lid"])
        out = df.join(names, F.col(table.column(block)).cast("string") == F.col("__lid"), "left")
        return out.withColumn(name, F.array_compact(F.array("__shown"))).drop("__lid", "__shown")
    got = _entries(table, df, block, other, shown).groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("__pos", "__shown"))).alias("__list"))
    out = df.join(got, F.col(table.id) == F.col("__rid"), "left")
    texts = F.coalesce(F.transform("__list", lambda s: s["__shown"]), F.array().cast("array<string>"))
    return out.withColumn(name, texts).drop("__rid", "__list")


def inflate(table: Table, blocks: Iterable[int | str] | None = None, *, full: bool = False, depth: int = 1) -> DataFrame:
    """Rows whose linked blocks are maps from the ids they hold to what is shown for them, or with full to whole rows as
    JSON; those rows' own links are resolved down to `depth` levels, DEPTH at most."""
    df = table.df
    wanted = [table.spec.resolve(b) for b in blocks] if blocks is not None else range(len(table.spec.blocks))
    for at in wanted:
        if (got := table.linked(at)) is None:
            continue
        other, shown = got
        if full:
            inner = inflate(other, full=True, depth=depth - 1) if depth > 1 else other.df
            rows = inner.select(F.col(other.id).cast("string").alias("__lid"), F.to_json(F.struct(*inner.columns)).alias("__shown")).dropDuplicates(["__lid"])
            each = df.select(F.col(table.id).alias("__rid"), F.posexplode(cells.values(F.col(table.column(at)), table.kind(at))).alias("__pos", "__lid")).join(rows, "__lid")
        else:
            each = _entries(table, df, at, other, shown)
        lists = each.groupBy("__rid").agg(F.sort_array(F.collect_set(F.struct("__pos", "__lid", "__shown"))).alias("__list"))
        first = F.filter("__list", lambda x, i: ~F.exists(F.slice("__list", 1, i), lambda y: y["__lid"] == x["__lid"]))
        shown_map = F.map_from_arrays(F.transform(first, lambda s: s["__lid"]), F.transform(first, lambda s: s["__shown"]))
        empty = F.create_map().cast("map<string,string>")
        own = df.columns
        df = df.join(lists, F.col(table.id) == F.col("__rid"), "left").withColumn(table.column(at), F.coalesce(shown_map, empty)).select(*own)
    return df


def deflate(table: Table, df: DataFrame) -> DataFrame:
    """The inverse: maps become the ids they hold, and columns stand in the order of the blocks (missing ones null)."""
    out = []
    for b in table.spec.blocks:
        if b.id not in df.columns:
            out.append(F.lit(None).cast("string").alias(b.id))
            continue
        kind = df.schema[b.id].dataType
        c = F.col(b.id)
        out.append(F.array_join(F.map_keys(c), ",").alias(b.id) if kind.typeName() == "map" and b.link else c)
    return df.select(*out)


def fits(table: Table, row: dict[str, Any]) -> bool:
    """Whether a row given by names is one of this table: it has no name that no block has."""
    known = {n.lower() for b in table.spec.blocks for n in (b.id, b.name) if n}
    return bool(row) and all(str(k).lower() in known for k in row)


# -- child rows


def with_child_ids(table: Table, df: DataFrame | None = None) -> DataFrame:
    """df with the block repeat_ids holding the ids of the child rows, joined by commas."""
    df = table.df if df is None else df
    s = table.spec
    if s.repeat_ids is None or s.repeat_start is None:
        return df
    items, ids = table.column(s.repeat_start), table.column(s.repeat_ids)
    kind = df.schema[items].dataType
    first = kind.elementType.fields[0].name if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) else None
    one = (lambda x: x[first].cast("string")) if first else (lambda x: x.cast("string"))
    joined = F.coalesce(F.array_join(F.transform(items, one), ","), F.lit(""))
    return df.withColumn(ids, joined) if ids in df.columns else df.select(*df.columns, joined.alias(ids))


def nested(parent: DataFrame, child: DataFrame, key: str, child_key: str, order: str, name: str = "items") -> DataFrame:
    """parent with its child rows as an array of structs, ordered; a parent's children are a group of their own size."""
    rest = [c for c in child.columns if c != child_key]
    lists = child.groupBy(F.col(child_key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*rest).alias("x")))).alias("__l"))
    out = parent.join(lists, F.col(key) == F.col("__k"), "left")
    return out.withColumn(name, F.coalesce(F.transform("__l", lambda s: s["x"]), F.array())).drop("__k", "__l")


# -- slugs


def slug_part(c: Column, width: int = 64, ascii_of=None) -> Column:
    first = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?s)[;,].*", "")
    plain = F.lower(ascii_of(first) if ascii_of else cells.ascii_plain(first))
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "[^a-z0-9]+", "-"), 1, width), "^-|-$", "")


def slugs(table: Table, *, exact: bool = False) -> DataFrame:
    """id, slug: the slug blocks' parts joined by "/"; of rows with one slug the smallest id keeps it, others add -id."""
    df = table.df
    blocks = table.spec.slug if isinstance(table.spec.slug, (tuple, list)) else (table.spec.slug,)
    ascii_of = (lambda c: table.locale.column("to_ascii", c)) if exact else None
    parts = []
    for i, b in enumerate(blocks):
        at = table.spec.resolve(b)
        c = F.col(table.column(at)).cast("string")
        if (got := table.linked(at)) is not None:
            other, shown = got
            names = other.df.select(F.col(other.id).cast("string").alias(f"__l{i}"), F.col(shown).cast("string").alias(f"__n{i}")).dropDuplicates([f"__l{i}"])
            df = df.join(names, F.trim(F.regexp_replace(c, "[;,].*", "")) == F.col(f"__l{i}"), "left")
            c = F.coalesce(f"__n{i}", c)
        parts.append(slug_part(c, ascii_of=ascii_of))
    whole = F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "/")
    rows = df.select(F.col(table.id), whole.alias("base"))
    first = rows.groupBy("base").agg(F.min(table.id).alias("__first"))  # counted on the map side: a common slug is no skew
    out = rows.join(first, "base")
    own = (F.col(table.id) == F.col("__first")) | (F.col("base") == "")
    return out.select(table.id, F.when(own, F.col("base")).otherwise(F.concat_ws("-", "base", F.col(table.id).cast("string"))).alias("slug"))


def by_slug(table: Table, slug: str) -> DataFrame:
    return table.df.join(slugs(table).filter(F.col("slug") == slug).select(table.id), table.id, "left_semi")
