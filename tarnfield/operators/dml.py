"""What writes do to a table's rows, as transformations from rows to rows; sources.catalog publishes the results.

Only the changed rows' ids travel: an update is an anti join on the changes' ids and a union, and Spark broadcasts the
changes if they are small.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import cells
from ..session import scratch
from ..spec import TableSpec
from .core import Table
from .link import with_child_ids


class Rejected(ValueError):
    """Rows that the rules of a table don't let in."""


def clean_id(c: Column) -> Column:
    """The digits of an id as a number, null unless above 0."""
    n = F.regexp_replace(c.cast("string"), r"\D", "").try_cast("bigint")
    return F.when(n > 0, n)


def validated(spec: TableSpec, df: DataFrame) -> DataFrame:
    """Each block of text cast softly to its type; blocks that are typed columns already stay."""
    out = []
    for b in spec.blocks:
        if b.id not in df.columns:
            out.append(cells.cast_soft(F.lit(None), b.type, b.valid).alias(b.id))
        elif df.schema[b.id].dataType.typeName() == "string" and b.type not in ("auto_id", "autoid"):
            out.append(cells.cast_soft(F.col(b.id), b.type, b.valid).alias(b.id))
        else:
            out.append(F.col(b.id))
    return df.select(*out)


def unique_violations(spec: TableSpec, df: DataFrame) -> DataFrame:
    """block, value, n for values of unique blocks that several rows have (empty ones may repeat)."""
    blocks = [b.id for b in spec.blocks if "unique" in b.valid]
    if not blocks:
        return df.sparkSession.createDataFrame([], "block string, value string, n long")
    parts = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).cast("string").alias("value")) for b in blocks])
    rows = df.select(F.explode(parts).alias("p")).select("p.block", "p.value").filter("value is not null and value <> ''")
    return rows.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1")


def _clash(spec: TableSpec, rows: DataFrame, others: DataFrame) -> bool:
    """Whether a value of a unique block would stand twice: among the written rows, or in one of them and in another row.
    Only the written rows' values are looked for, so the table's own are filtered and never grouped."""
    blocks = [b.id for b in spec.blocks if "unique" in b.valid]
    if not blocks:
        return False
    if unique_violations(spec, rows).limit(1).count():
        return True
    parts = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).cast("string").alias("value")) for b in blocks])
    held = lambda df: df.select(F.explode(parts).alias("p")).select("p.block", "p.value").filter("value is not null and value <> ''")
    return bool(held(others).join(held(rows), ["block", "value"], "left_semi").limit(1).count())


def numbered(df: DataFrame, id_column: str, last: int) -> DataFrame:
    """Ids last + 1, ... for rows without one, in the order in which df's partitions hold them. Numbers are dealt out by
    partition (a count for each, then places within it), so no row passes through a single task. The rows are written with
    their places first: if they were made again, by another plan or on another executor, places could differ."""
    rest = [c for c in df.columns if c != id_column]
    path = scratch(df.sparkSession, "numbered")
    df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    sizes = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # a number for each partition
    start, at = {}, last
    for p in sorted(sizes):
        start[p] = at
        at += sizes[p]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("__p")) if start else F.lit(last)
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn(id_column, (base + place).cast("bigint")).select(id_column, *rest)


def insert(table: Table, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows after the insert, and the rows that were let in: valid ids above the largest so far, the first of repeats.

    Rows are left out, not refused, as in any bulk insert; values that break a unique block refuse the whole call."""
    spec, key = table.spec, table.id
    last = table.df.agg(F.max(key)).first()[0] or 0
    new = new.withColumn(key, clean_id(F.col(key)))
    order = [F.col(c).cast("string") for c in new.columns if c != key]
    rows = new.filter(F.col(key) > last).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")
    rows = with_child_ids(table, _fitted(table, validated(spec, rows)))
    out = table.df.unionByName(rows)
    if _clash(spec, rows, table.df):
        raise Rejected(f"{spec.name}: a unique block would hold a value twice")
    return out, rows


def _fitted(table: Table, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.df.schema.fields])


def update(table: Table, changes: DataFrame, *, force: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows after the update, and the changed rows. Ids that aren't there are left out unless the table takes upserts."""
    key = table.id
    force = table.spec.force if force is None else force
    rows = with_child_ids(table, _fitted(table, validated(table.spec, changes.dropDuplicates([key]))))
    if not force:
        rows = rows.join(table.df.select(key), key, "left_semi")
    others = table.df.join(rows.select(key), key, "left_anti")
    out = others.unionByName(rows)
    if _clash(table.spec, rows, others):
        raise Rejected(f"{table.spec.name}: a unique block would hold a value twice")
    return out, rows


def delete(table: Table, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows after the delete, and the deleted ones (kept aside by tables with keep_deleted)."""
    gone = ids.select(F.col(ids.columns[0]).alias(table.id)).distinct()
    return table.df.join(gone, table.id, "left_anti"), table.df.join(gone, table.id, "left_semi")


def update_field(table: Table, id: Any, block: int | str, value: Any) -> DataFrame:
    """One cell changed; the id itself can't be."""
    at = table.spec.resolve(block)
    if at == 0:
        raise Rejected("the id of a row can't be changed")
    c = table.column(at)
    kind = table.df.schema[c].dataType
    return with_child_ids(table, table.df.withColumn(c, F.when(F.col(table.id) == F.lit(id), F.lit(value).cast(kind)).otherwise(F.col(c))))


def _items(table: Table) -> tuple[str, StructType, str]:
    if table.spec.repeat_start is None:
        raise Rejected(f"{table.spec.name} has no child rows")
    name = table.column(table.spec.repeat_start)
    kind = table.df.schema[name].dataType.elementType
    return name, kind, kind.fields[0].name


def _struct(kind: StructType, item: dict) -> Column:
    return F.struct(*[F.lit(item.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.fields])


def _at(table: Table, id: Any, name: str, changed: Column) -> DataFrame:
    return with_child_ids(table, table.df.withColumn(name, F.when(F.col(table.id) == F.lit(id), changed).otherwise(F.col(name))))


def insert_item(table: Table, id: Any, item: dict, pos: int | None = None) -> DataFrame:
    """A child row put in at a position (clamped; the end by default); nothing happens if its id is there already."""
    name, kind, key = _items(table)
    old = F.coalesce(F.col(name), F.array())
    n = F.size(old)
    at = n if pos is None else F.least(F.greatest(F.lit(pos), F.lit(0)), n)
    new = F.concat(F.slice(old, F.lit(1), at), F.array(_struct(kind, item)), F.slice(old, at + 1, n))
    there = F.exists(old, lambda x: x[key].cast("string") == str(item.get(key)))
    return _at(table, id, name, F.when(there, old).otherwise(new))


def update_item(table: Table, id: Any, item: dict, *, child: Any = None, pos: int | None = None) -> DataFrame:
    """A child row changed, by its id or its position."""
    name, kind, key = _items(table)
    hit = (lambda x, i: i == pos) if pos is not None else (lambda x, i: x[key].cast("string") == str(child))
    new = F.transform(name, lambda x, i: F.when(hit(x, i), F.struct(*[(F.lit(item[f.name]).cast(f.dataType) if f.name in item else x[f.name]).alias(f.name) for f in kind.fields])).otherwise(x))
    return _at(table, id, name, new)


def delete_item(table: Table, id: Any, *, child: Any = None, pos: int | None = None) -> DataFrame:
    """A child row taken out, by its id or its position."""
    name, _, key = _items(table)
    keep = (lambda x, i: i != pos) if pos is not None else (lambda x, _i: x[key].cast("string") != str(child))
    return _at(table, id, name, F.filter(name, keep))


def replace_values(table: Table, block: int | str, mapping: dict) -> DataFrame:
    """Values of a block replaced, each part of a cell by itself; in child rows every text field equal to a value."""
    c = table.column(block)
    kind = table.kind(block)
    looked = F.create_map(*[F.lit(str(x)) for kv in mapping.items() for x in kv])
    new = lambda x: F.coalesce(F.element_at(looked, x), x)
    if kind.typeName() == "array" and isinstance(kind.elementType, StructType):
        return table.df.withColumn(c, F.transform(c, lambda x: F.struct(*[new(x[f.name].cast("string")).cast(f.dataType).alias(f.name) for f in kind.elementType.fields])))
    if kind.typeName() == "array":
        return table.df.withColumn(c, F.transform(c, new))
    return table.df.withColumn(c, F.when(F.col(c).isNull(), None).otherwise(F.array_join(F.transform(F.split(F.col(c).cast("string"), ","), lambda x: new(F.trim(x))), ",")).cast(kind))


def alias_rows(pairs: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """old, new with the pairs added; a later pair of an id takes the earlier one's place."""
    if aliases is None:
        return pairs
    old, new = aliases.columns[:2]
    added = pairs.select(F.col(pairs.columns[0]).alias(old), F.col(pairs.columns[1]).alias(new))
    return aliases.join(added.select(old), old, "left_anti").unionByName(added)


def dictionary(df: DataFrame, blocks: Iterable[str]) -> DataFrame:
    """block, value, id: the distinct values of unique blocks with their row."""
    parts = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).cast("string").alias("value")) for b in blocks])
    return df.select(F.explode(parts).alias("p"), F.col(df.columns[0]).alias("id")).select("p.block", "p.value", "id").filter("value <> ''")


def touched(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
