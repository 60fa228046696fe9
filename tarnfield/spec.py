"""Table specifications: columns ("blocks") by position and by name, what each is used for, and call options.

Nothing here touches Spark; a spec is plain data and may be kept as JSON next to a table.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

NUMERIC = {"num", "number", "numeric", "int", "float", "decimal"}
DATES = {"date", "datetime", "date_short", "date_long"}
LISTS = {"array", "list", "repeat", "repeats", "loop"}
MAPS = {"hash", "dict", "json"}


@dataclass(frozen=True)
class Link:
    """A foreign key: the table it leads to and the block that is shown for it."""

    table: str
    display: int | str = 1

    @classmethod
    def of(cls, value: Any) -> Link | None:
        if value is None or isinstance(value, Link):
            return value
        if isinstance(value, dict):
            return cls(value["table"], value.get("display", 1))
        table, _, shown = re.sub(r"[,|:]", ";", str(value)).partition(";")
        return cls(table, int(shown) if shown.isdigit() else shown or 1)


@dataclass(frozen=True)
class Block:
    id: str
    name: str = ""
    type: str = "text"
    valid: str = ""
    link: Link | None = None
    option: str = ""


@dataclass(frozen=True)
class Rule:
    """left op right; left is a block, or "a->b": block b of the row that block a leads to."""

    left: str
    op: str
    right: str

    @classmethod
    def of(cls, value: Any) -> Rule:
        if isinstance(value, Rule):
            return value
        parts = value.split(None, 2) if isinstance(value, str) else list(value)
        return cls(*map(str, parts))


@dataclass(frozen=True)
class TableSpec:
    name: str
    blocks: tuple[Block, ...]
    match: tuple = ()
    search: tuple = ()
    sort: tuple = ()
    facet: tuple = ()
    facet_rules: tuple[Rule, ...] = ()
    junk_rules: tuple[Rule, ...] = ()
    use_junk: bool = False
    tier: str = "AB"
    suggest: tuple = ()
    suggest_join: tuple = ()
    slug: tuple = ()
    repeat_ids: int | None = None
    repeat_start: int | None = None
    keep_deleted: bool = False
    force: bool = False
    use_alias: bool = False
    stop_words: str = ""
    min_char: int = 2
    locale: str = "gb"
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def columns(self) -> list[str]:
        return [b.id for b in self.blocks]

    @property
    def id(self) -> str:
        return self.blocks[0].id

    def resolve(self, block: int | str) -> int:
        """Position of a block given by position, id or name, in any case."""
        text = str(block).strip()
        if re.fullmatch(r"\d+", text):
            if int(text) < len(self.blocks):
                return int(text)
            raise KeyError(f"{self.name} has no block {text}")
        for pick in ("id", "name"):
            for i, b in enumerate(self.blocks):
                if getattr(b, pick).lower() == text.lower():
                    return i
        raise KeyError(f"{self.name} has no block {text!r}")

    def column(self, block: int | str) -> str:
        return self.blocks[self.resolve(block)].id

    def with_(self, **changes: Any) -> TableSpec:
        return replace(self, **changes)

    def sorted_type(self, block: int | str) -> tuple[str, int] | None:
        """Kind and width of a block's prepared order, if it has one."""
        at = self.resolve(block)
        for s in self.sort:
            own = s if isinstance(s, dict) else {"blk": s}
            if self.resolve(own["blk"]) == at:
                kind = self.blocks[at].type
                kind = own.get("type") or ("num" if kind in NUMERIC else "date" if kind in DATES else "string")
                return ("num" if kind in NUMERIC else kind), int(own.get("len", 8))
        return None

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        d = json.loads(text)
        d["blocks"] = tuple(Block(**{**b, "link": Link.of(b["link"])}) for b in d["blocks"])
        for k in ("facet_rules", "junk_rules"):
            d[k] = tuple(Rule(**r) for r in d[k])
        for k in ("match", "search", "sort", "facet", "suggest", "suggest_join", "slug"):
            d[k] = tuple(tuple(x) if isinstance(x, list) else x for x in d[k])
        return cls(**d)


def table_spec(name: str, blocks: list, **options: Any) -> TableSpec:
    """A spec from plain lists: blocks are names, (id, type) pairs or dictionaries."""
    made = []
    for b in blocks:
        if isinstance(b, Block):
            made.append(b)
        elif isinstance(b, str):
            made.append(Block(b))
        elif isinstance(b, dict):
            own = dict(b)
            own["link"] = Link.of(own.pop("rdbm", own.get("link")))
            made.append(Block(**own))
        else:
            made.append(Block(b[0], type=b[1], link=Link.of(b[2]) if len(b) > 2 else None))
    for k in ("facet_rules", "junk_rules"):
        options[k] = tuple(map(Rule.of, options.get(k, ())))
    frozen = lambda v: tuple(frozen(x) for x in v) if isinstance(v, list) else v
    return TableSpec(name, tuple(made), **{k: frozen(v) for k, v in options.items()})


#: The options that a table takes from its group where it has none of its own.
INHERITED = frozenset(
    (
        "use_ramdisk ramdisk_ttl use_cache cache_ttl keep_deleted log_owner use_counter use_section section use_year year "
        "use_language lang no_transact no_backup table_dir use_junk use_simple"
    ).split()
)


def grouped_spec(name: str, blocks: list, groups: dict[str, dict], *, group: str = "", **options: Any) -> TableSpec:
    """A spec with the options of its group: the one named, or what stands before the first "_" of the table's name."""
    found = re.match(r"([A-Za-z0-9]+)_", name)
    taken = {k: v for k, v in groups.get(group or (found[1] if found else ""), {}).items() if k in INHERITED}
    own = {f.name for f in fields(TableSpec)}
    extra = {k: v for k, v in taken.items() if k not in own} | options.pop("extra", {})
    return table_spec(name, blocks, **({k: v for k, v in taken.items() if k in own} | options), extra=extra)


@dataclass(frozen=True)
class Order:
    block: int | str
    ascending: bool
    type: str | None = None


def order_of(option: Any, direction: str | None = None) -> Order:
    """An order from its short forms. Newest (largest) first unless asked otherwise; "reverse" means ascending."""
    up = {"asc", "reverse"}
    if option is None or option == "":
        return Order(0, (direction or "").lower() in up)
    if isinstance(option, Order):
        return option
    if isinstance(option, dict):
        block = next((option[k] for k in ("blk", "block", "field") if option.get(k) is not None), 0)
        if "reverse" in option:
            ascending = bool(option["reverse"])
        else:
            ascending = str(option.get("dir", option.get("order", "desc"))).lower() == "asc"
        return Order(block, ascending, option.get("type"))
    text = str(option).strip()
    if text.lower() in up | {"desc"}:
        return Order(0, text.lower() in up)
    if m := re.fullmatch(r"(.+?)\s+(asc|desc|reverse)", text, re.IGNORECASE):
        return Order(m[1], m[2].lower() in up)
    if text.startswith("-") and len(text) > 1:
        return Order(text[1:], True)
    return Order(text, (direction or "").lower() in up)


@dataclass(frozen=True)
class Range:
    block: int
    low: float
    high: float | None


def ranges_of(spec: TableSpec, conditions: dict | None) -> list[Range]:
    """The {min, max} entries. Without a min the lowest value is 0; give -inf for none."""
    out = []
    for block, v in (conditions or {}).items():
        if isinstance(v, dict) and ("min" in v or "max" in v):
            low, high = v.get("min"), v.get("max")
            out.append(Range(spec.resolve(block), 0.0 if low in (None, "") else float(low), None if high in (None, "") else float(high)))
    return out


def choices_of(spec: TableSpec, conditions: dict | None) -> dict[int, list[str]]:
    """The other entries: the values of which a block is to hold one."""
    out = {}
    for block, v in (conditions or {}).items():
        if isinstance(v, dict):
            continue
        values = [str(x) for x in v if x not in (None, "")] if isinstance(v, (list, tuple, set)) else ([str(v)] if v not in (None, "") else [])
        out[spec.resolve(block)] = values
    return out


def tier_of(spec: TableSpec, asked: str | None = None) -> str:
    """A, B, AB, BA, or "" for the plain stream."""
    t = str(spec.tier if asked is None else asked).upper()
    return "" if not spec.use_junk or t in ("ALL", "NONE", "0", "OFF", "") else t
