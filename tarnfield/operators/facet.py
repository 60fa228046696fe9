"""Facets: counts of blocks' values under the other selections, and menus made of them.

All counts come from one pass: a row gives (block, value) for a block if it satisfies the selections of all other blocks,
and the pairs are counted on the map side. So a menu costs one scan and one small shuffle, however many blocks it has.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..spec import choices_of
from . import core
from .core import Page, Table

TOP = 20


def _facet_values(table: Table, block: int) -> Column:
    kind = table.kind(block)
    c = F.col(table.column(block))
    if kind.simpleString() == "string":
        c = F.replace(c, F.lit("\t"), F.lit(","))
    return F.array_distinct(cells.values(c, kind))


def _selection(table: Table, selected: dict | None) -> tuple[dict[int, list[str]], dict]:
    """Chosen values by block ("f2" is block 2, "a,b" are two values), and the ranges."""
    choices, ranges = {}, {}
    for key, v in (selected or {}).items():
        name = str(key)
        block = name[1:] if name[:1] == "f" and name[1:].isdigit() else key
        if isinstance(v, dict):
            ranges[block] = v
        else:
            choices[block] = [x.strip() for x in v.split(",")] if isinstance(v, str) else v
    return {b: v for b, v in choices_of(table.spec, choices).items() if v}, ranges


def _active(table: Table) -> DataFrame:
    """The rows with a column __active: those of tier A for which all facet rules hold."""
    df = core.with_tier(table) if table.spec.use_junk else table.df.withColumn(core.TIER, F.lit("A"))
    df = core.with_rule(table, df, table.spec.facet_rules, "__ok", every=True)
    return df.withColumn("__active", F.col("__ok") & (F.col(core.TIER) == "A")).drop("__ok", core.TIER)


def _scope(table: Table, base_ids, ranges: dict) -> DataFrame:
    df = core.restricted(table, _active(table), base_ids)
    inside = core.range_condition(table, ranges)
    return df if inside is None else df.filter(inside)


def _others(table: Table, choices: dict[int, list[str]], block: int | None) -> Column:
    parts = [core.choice(table, b, v) for b, v in choices.items() if b != block]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def counts(table: Table, blocks: Iterable[int | str], selected: dict | None = None, base_ids=None) -> DataFrame:
    """block (its position), value, n: for each block the rows under the selections of all other blocks."""
    choices, ranges = _selection(table, selected)
    places = [table.spec.resolve(b) for b in blocks]
    scope = _scope(table, base_ids, ranges).filter("__active")
    one = lambda b: F.when(_others(table, choices, b), F.struct(F.lit(b).alias("block"), _facet_values(table, b).alias("vs")))
    rows = scope.select(F.explode(F.array(*[one(b) for b in places])).alias("p")).select("p.block", F.explode("p.vs").alias("value"))
    return rows.groupBy("block", "value").agg(F.count("*").alias("n"))


def field_fltkeys(table: Table, target: int | str, filter: dict | None = None, base_ids=None) -> DataFrame:
    """value, n of one block under all other filters. An empty scope gives no counts."""
    return counts(table, [target], filter, base_ids).select("value", "n")


def field_allfltkeys(table: Table, blocks: Iterable[int | str] | None = None, *, base_ids=None, filter: dict | None = None) -> DataFrame:
    """block, value, n of several blocks (all facet blocks by default)."""
    return counts(table, blocks if blocks is not None else table.spec.facet, filter, base_ids)


@dataclass(frozen=True)
class Menu:
    table: Table
    page: Page
    counts: DataFrame
    #: block, name, value, label, n, checked, rank: at most a group's limit of rows each
    items: DataFrame
    choices: dict[int, list[str]]
    defs: tuple[dict, ...]

    @property
    def count(self) -> int:
        return self.page.total

    @cached_property
    def groups(self) -> list[dict[str, Any]]:
        """The groups in the order of their definitions: a few items each, so they are gathered here."""
        by_block: dict[int, list] = {}
        for r in self.items.orderBy("block", "rank").collect():
            by_block.setdefault(r["block"], []).append(r)
        out = []
        for d in self.defs:
            rows = by_block.get(d["block"], [])
            if not rows and not d.get("required"):
                continue
            chosen = self.choices.get(d["block"], [])
            records = [
                {"uid": f"fc_{d['block']}_{r['value']}", "param": f"f{d['block']}", "val": r["value"], "label": r["label"], "count": r["n"], "checked": int(r["checked"])} for r in rows
            ]
            out.append({"blk": d["block"], "name": d["name"], "active": int(bool(chosen)), "active_count": len(chosen), "records": records})
        return out

    @property
    def groups_by_blk(self) -> dict[int, dict]:
        return {g["blk"]: g for g in self.groups}

    @property
    def active_counts(self) -> dict[int, int]:
        return {b: len(v) for b, v in self.choices.items()}


def _definition(table: Table, d: Any) -> dict:
    d = dict(d) if isinstance(d, dict) else {"blk": d}
    block = table.spec.resolve(d.get("blk", d.get("block")))
    return d | {"block": block, "name": d.get("label", d.get("name", f"Group {block}"))}


def _group(table: Table, all_counts: DataFrame, d: dict, chosen: list[str]) -> DataFrame:
    rows = all_counts.filter((F.col("block") == d["block"]) & (F.col("value") != ""))
    other = table.others.get(d["table"]) if d.get("table") else None
    if other is None and (got := table.linked(d["block"])) is not None:
        other = got[0]
    if d.get("filter_block") and other is not None:
        rule = list(d["filter_block"])
        blk, op, want = rule if len(rule) == 3 else (rule[0], "eq", rule[1])
        good = other.df.filter(F.exists(core.values_of(other, blk), lambda v: cells.compare(v, op, str(want))))
        rows = rows.join(good.select(F.col(other.id).cast("string").alias("value")).distinct(), "value", "left_semi")
    if d.get("filter_op"):
        rows = rows.filter(cells.compare(F.col("value"), d["filter_op"][0], str(d["filter_op"][1])))
    if d.get("csv_list"):
        rows = rows.filter(F.col("value").isin(str(d["csv_list"]).split(",")))
    if d.get("skip_zero") or d.get("id") == "year":
        rows = rows.filter(F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) != 0)
    number = F.when(F.col("value").rlike(r"^\d+$"), F.col("value").try_cast("decimal(38,0)"))
    if d.get("sort", "count") == "value":
        order = [number.asc(), F.col("value").asc()] if d.get("sort_dir", "desc") == "asc" else [number.desc(), F.col("value").desc()]
    else:
        order = [F.col("n").desc(), F.col("value").asc()]
    limit = int(d.get("limit", d.get("display_limit", TOP)) or 0)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(*order)))
    if limit:
        rows = rows.filter(F.col("rank") <= limit)
    label: Column = F.col("value")
    if other is not None:
        shown = other.column(d.get("name_idx", min(2, len(other.spec.blocks) - 1)))
        names = other.df.select(F.col(other.id).cast("string").alias("__id"), F.col(shown).cast("string").alias("__name"))
        rows = rows.join(names, F.col("value") == F.col("__id"), "left")
        label = F.coalesce("__name", "value")
    elif option := (d.get("option") or table.spec.blocks[d["block"]].option):
        said = dict(p.split(":", 1) for p in option.split(",") if ":" in p)
        if said:
            label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in said.items() for x in kv]), F.col("value")), F.col("value"))
    checked = F.col("value").isin(chosen) if chosen else F.lit(False)
    return rows.select("block", F.lit(str(d["name"])).alias("name"), "value", label.alias("label"), "n", checked.alias("checked"), "rank")


def facet_menu(table: Table, *, selected: dict | None = None, facet_defs: Iterable | None = None, offset: int = 0, limit: int = 0, base_ids=None) -> Menu:
    """The rows under all selections, and for each defined block its values' counts, labelled, ordered and cut."""
    choices, ranges = _selection(table, selected)
    defs = tuple(_definition(table, d) for d in (facet_defs if facet_defs is not None else table.spec.facet))
    found = _scope(table, base_ids, ranges)
    if choices:
        found = found.filter(_others(table, choices, None))
    elif base_ids is None and not ranges and table.spec.facet_rules:
        found = found.filter("__active")
    page = core.paged(table, found, core.Order(0, False), "", offset, limit, keys_only=True)
    all_counts = counts(table, [d["block"] for d in defs], selected, base_ids)
    groups = [_group(table, all_counts, d, choices.get(d["block"], [])) for d in defs]
    items = reduce(lambda a, b: a.unionByName(b), groups) if groups else all_counts.limit(0)
    return Menu(table, page, all_counts, items, choices, defs)
