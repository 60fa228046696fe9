"""What the read operators share: tables, pages, predicates, tiers and orders."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from ..functions import cells
from ..functions.locales import Locale, locale
from ..spec import DATES, NUMERIC, Order, Rule, TableSpec, choices_of, order_of, ranges_of, tier_of

TIER = "__tier"
#: Ids that a caller may hand over as a list; beyond that a DataFrame is asked for.
LIST_IDS = 100_000


@dataclass(frozen=True)
class Table:
    """A DataFrame with its spec, the tables its links lead to, and what is kept beside it."""

    spec: TableSpec
    df: DataFrame
    others: Mapping[str, Table] = field(default_factory=lambda: MappingProxyType({}))
    deleted: DataFrame | None = None
    aliases: DataFrame | None = None
    counters: DataFrame | None = None
    #: value lists (block, value, tier, id) and word lists (block, word, tier, id), if they were built
    postings: DataFrame | None = None
    tokens: DataFrame | None = None

    @property
    def id(self) -> str:
        return self.spec.id

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def locale(self) -> Locale:
        return locale(self.spec.locale)

    def column(self, block: int | str) -> str:
        return self.spec.column(block)

    def kind(self, block: int | str) -> DataType:
        return self.df.schema[self.column(block)].dataType

    def with_df(self, df: DataFrame) -> Table:
        """Other rows of the same table; lists that were built for all rows don't hold for them."""
        return replace(self, df=df, postings=None, tokens=None)

    def linked(self, block: int | str) -> tuple[Table, str] | None:
        """The table that a block leads to, and the column shown for it."""
        link = self.spec.blocks[self.spec.resolve(block)].link
        if link is None or link.table not in self.others:
            return None
        other = self.others[link.table]
        return other, other.column(link.display)


@dataclass(frozen=True)
class Page:
    """Rows of a page in order, and the number of rows of all pages (counted when it is asked for)."""

    df: DataFrame
    matched: DataFrame

    @cached_property
    def total(self) -> int:
        return self.matched.count()

    def ids(self, column: str) -> list:
        return [r[0] for r in self.df.select(column).collect()]


def values_of(table: Table, block: int | str) -> Column:
    return cells.values(F.col(table.column(block)), table.kind(block))


def id_frame(table: Table, ids: DataFrame | Iterable) -> DataFrame:
    """One column with the table's id: from a DataFrame's first column, or a caller's list of at most LIST_IDS."""
    if isinstance(ids, DataFrame):
        return ids.select(ids[ids.columns[0]].alias(table.id)).distinct()
    own = list(dict.fromkeys(ids))
    if len(own) > LIST_IDS:
        raise ValueError(f"more than {LIST_IDS} ids in a list; give a DataFrame")
    kind = table.df.schema[table.id].dataType.simpleString()
    return F.broadcast(table.spark.createDataFrame([(None if x is None else str(x),) for x in own], "x string").select(F.col("x").try_cast(kind).alias(table.id)))


def restricted(table: Table, df: DataFrame, ids: DataFrame | Iterable | None) -> DataFrame:
    return df if ids is None else df.join(id_frame(table, ids), table.id, "left_semi")


# -- conditions


def choice(table: Table, block: int, wanted: list[str]) -> Column:
    return cells.holds_any(F.col(table.column(block)), wanted, table.kind(block))


def range_condition(table: Table, conditions: dict | None) -> Column | None:
    parts = [cells.in_range(F.col(table.column(r.block)), r, table.kind(r.block)) for r in ranges_of(table.spec, conditions)]
    return reduce(lambda a, b: a & b, parts) if parts else None


def condition(table: Table, conditions: dict | None, kind: str = "and") -> Column | None:
    """Values are alternatives within a block; blocks are joined by and / or; ranges must hold in either case."""
    parts = [choice(table, b, v) for b, v in choices_of(table.spec, conditions).items()]
    chosen = reduce((lambda a, b: a | b) if kind.lower() == "or" else (lambda a, b: a & b), parts) if parts else None
    inside = range_condition(table, conditions)
    both = [c for c in (chosen, inside) if c is not None]
    return reduce(lambda a, b: a & b, both) if both else None


# -- rules and tiers


def _hop(rule: Rule) -> tuple[str, str] | None:
    a, arrow, b = rule.left.partition("->")
    return (a.strip(), b.strip()) if arrow else None


def with_rule_values(table: Table, df: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, list[tuple[Column, Rule, str | None]]]:
    """df with a helper column for each rule that follows a link; and each rule's left side.

    A linked table gives two columns, id and value; Spark broadcasts it if it is small and shuffles both sides if not."""
    sides: list[tuple[Column, Rule, str | None]] = []
    for i, rule in enumerate(rules):
        hop = _hop(rule)
        if hop is None:
            sides.append((F.col(table.column(rule.left)), rule, None))
            continue
        own = F.col(table.column(hop[0]))
        if (got := table.linked(hop[0])) is not None:
            other, name = got[0], f"__rule{i}"
            key = f"{name}_id"
            side = other.df.select(F.col(other.id).cast("string").alias(key), F.col(other.column(hop[1])).cast("string").alias(name)).dropDuplicates([key])
            df = df.join(side, own.cast("string") == F.col(key), "left").drop(key)
            sides.append((F.col(name), rule, name))
        elif isinstance(table.kind(hop[0]), ArrayType):
            sides.append((F.get(own, F.lit(int(hop[1]))), rule, None))
        else:
            sides.append((F.get(F.split(own.cast("string"), r"[\t,]"), F.lit(int(hop[1]))), rule, None))
    return df, sides


def with_rule(table: Table, df: DataFrame, rules: Iterable[Rule], name: str, every: bool) -> DataFrame:
    """df with a boolean column: whether every rule (or one of them) holds. An empty value never matches."""
    rules = list(rules)
    if not rules:
        return df.withColumn(name, F.lit(every))
    own = df.columns
    df, sides = with_rule_values(table, df, rules)
    parts = [cells.compare(c, r.op, r.right) for c, r, _ in sides]
    joined = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts)
    return df.select(*own, joined.alias(name))


def with_tier(table: Table, df: DataFrame | None = None) -> DataFrame:
    """df with its tier: B where one of the junk rules holds, else A."""
    df = table.df if df is None else df
    if not table.spec.use_junk or not table.spec.junk_rules:
        return df.withColumn(TIER, F.lit("A"))
    return with_rule(table, df, table.spec.junk_rules, "__junk", every=False).withColumn(TIER, F.when(F.col("__junk"), "B").otherwise("A")).drop("__junk")


def in_tier(table: Table, df: DataFrame, tier: str | None) -> tuple[DataFrame, str]:
    """The rows of the tiers asked for, with their tier, and the tiers' order ("" for the plain stream)."""
    order = tier_of(table.spec, tier)
    if not order:
        return df.withColumn(TIER, F.lit("A")), ""
    df = with_tier(table, df)
    if order in ("A", "B"):
        df = df.filter(F.col(TIER) == order)
    return df, order


# -- orders


def order_key(table: Table, order: Order) -> Column:
    """What rows are ordered by: a prepared order folds and cuts text, any other compares it as it is."""
    at = table.spec.resolve(order.block)
    name = table.column(at)
    if at == 0:
        return F.col(name)
    kind, prepared = table.kind(at), table.spec.sorted_type(at)
    c = F.col(name)
    numeric = kind.simpleString() in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.simpleString().startswith("decimal")
    wanted = (order.type or "").lower() or (prepared[0] if prepared else table.spec.blocks[at].type)
    if numeric and wanted not in ("string", "text") or numeric and not order.type:
        return F.coalesce(c, F.lit(0).cast(kind))
    if kind.simpleString() in ("timestamp", "timestamp_ntz", "date"):
        return c
    if prepared:
        text_kind = "num" if wanted in NUMERIC else "date" if wanted in DATES else "string"
        if text_kind == "num":
            return cells.cast_soft(c, "num")
        return cells.sort_key(c, text_kind, prepared[1])
    if wanted in NUMERIC:
        number = F.regexp_replace(F.replace(c.cast("string"), F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast("double")
        return F.coalesce(number, F.lit(0.0))
    return F.coalesce(c.cast("string"), F.lit("")) if isinstance(kind, StringType) else c


def ordering(table: Table, order: Order, tiers: str = "") -> list[Column]:
    """Tier (if streams follow each other), key, id; the id in the key's direction."""
    lead = [F.col(TIER).desc() if tiers == "BA" else F.col(TIER).asc()] if tiers in ("AB", "BA") else []
    if table.spec.resolve(order.block) == 0:
        return [*lead, F.col(table.id).asc() if order.ascending else F.col(table.id).desc()]
    return [*lead, *cells.order_columns(order, order_key(table, order), table.id)]


def paged(table: Table, df: DataFrame, order: Order, tiers: str = "", offset: int = 0, limit: int = 0, keys_only: bool = False) -> Page:
    """A page with a limit is a top-k of offset + limit rows of each partition; without one a full sort."""
    out = df.orderBy(*ordering(table, order, tiers))
    if offset:
        out = out.offset(offset)
    if limit:
        out = out.limit(limit)
    own = [table.id] if keys_only else [c for c in df.columns if not c.startswith("__")]
    return Page(out.select(*own), df)


def asked(sort=None, direction: str | None = None) -> Order:
    return order_of(sort, direction)
