"""A folder of tables with versions: every write adds files, every commit adds one entry to a log.

An entry names, for each table, its spec and the list of its parts: row parts (Parquet), and parts of ids that are gone.
A row counts if no later part says that its id is gone, so an update of few rows writes few rows; vacuum rewrites a table
as one part. A commit is the creation of the next entry, which only one writer can do; a transaction gathers the parts of
several tables and commits them as one entry, or drops them. Readers keep the entry they began with.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dml
from ..operators.core import Table, id_frame
from ..spec import TableSpec
from .files import Store


class Conflict(RuntimeError):
    """Another writer has committed in between."""


@dataclass
class Snapshot:
    version: int
    tables: dict[str, dict]


class Catalog:
    def __init__(self, spark: SparkSession, root: str, user: str = ""):
        self.spark, self.store, self.user = spark, Store(spark, root), user
        self._open: Transaction | None = None
        self._memo: dict[tuple, Any] = {}

    # -- versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.store.names("_log") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Snapshot(0, {})
        return Snapshot(version, json.loads(self.store.read(f"_log/{version:012}.json"))["tables"])

    def _commit(self, base: Snapshot, tables: dict[str, dict], note: str) -> int:
        entry = {"tables": tables, "note": note, "user": self.user, "at": time.time()}
        if not self.store.create(f"_log/{base.version + 1:012}.json", json.dumps(entry, ensure_ascii=False)):
            raise Conflict(f"version {base.version + 1} was written by another")
        self._memo.clear()
        return base.version + 1

    # -- tables

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.snapshot(version).tables)

    def exists(self, name: str) -> bool:
        return name in self.snapshot().tables

    def create(self, spec: TableSpec, df: DataFrame | None = None, schema: StructType | str | None = None) -> None:
        with self.transaction(f"create {spec.name}") as t:
            if spec.name in t.tables:
                raise dml.Rejected(f"{spec.name} is there already")
            if df is None:
                df = self.spark.createDataFrame([], schema or ", ".join(f"`{b.id}` {'long' if i == 0 else 'string'}" for i, b in enumerate(spec.blocks)))
            t.tables[spec.name] = {"spec": spec.to_json(), "schema": df.schema.json(), "parts": [], "deleted": [], "aliases": [], "counters": []}
            t.add(spec.name, df, "create")

    def truncate(self, name: str) -> None:
        """All rows go, and all that is derived from them."""
        with self.transaction(f"truncate {name}") as t:
            t.tables[name] |= {"parts": [], "deleted": [], "aliases": [], "counters": []}

    def drop(self, name: str) -> None:
        with self.transaction(f"drop {name}") as t:
            del t.tables[name]

    def rename(self, old: str, new: str) -> None:
        with self.transaction(f"rename {old} {new}") as t:
            if new in t.tables:
                raise dml.Rejected(f"{new} is there already")
            own = t.tables.pop(old)
            t.tables[new] = own | {"spec": TableSpec.from_json(own["spec"]).with_(name=new).to_json()}

    def attr(self, name: str, **changes: Any) -> TableSpec:
        """Change a table's spec; its rows stay as they are."""
        with self.transaction(f"attr {name}") as t:
            spec = TableSpec.from_json(t.tables[name]["spec"]).with_(**changes)
            t.tables[name] = t.tables[name] | {"spec": spec.to_json()}
        return spec

    def migrate(self, name: str, spec: TableSpec, renamed: dict[str, str] | None = None, values: dict[str, Column] | None = None) -> None:
        """A table's rows under another spec, as one part: blocks with an old block's id (or with one that `renamed` leads to by
        the new id) keep their cells, `values` makes others of the old row, what is left is empty. Rows that were deleted
        and kept go along; older versions read as they were."""
        renamed, values = renamed or {}, values or {}
        with self.transaction(f"migrate {name}") as t:
            old = self._table(t.tables, name, False, set())

            def shaped(df: DataFrame) -> DataFrame:
                cells = {b.id: values.get(b.id, F.col(f"`{renamed.get(b.id, b.id)}`") if renamed.get(b.id, b.id) in df.columns else F.lit("")) for b in spec.blocks}
                return df.select(*[c.alias(k) for k, c in cells.items()])

            new = shaped(old.df)
            t.tables[name] = t.tables[name] | {"spec": spec.with_(name=name).to_json(), "schema": new.schema.json(), "parts": [], "deleted": []}
            t.add(name, new, "migrate")
            if old.deleted is not None:
                t.aside(name, "deleted", shaped(old.deleted))

    def _rows(self, entry: dict, parts: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        key = schema.fields[0].name
        read = lambda p, s: self.spark.read.schema(s).parquet(self.store.at(p["path"]))
        rows = [(p["seq"], read(p, schema)) for p in parts if p["kind"] == "rows"]
        if not rows:
            return self.spark.createDataFrame([], schema)
        gone = [(p["seq"], read(p, StructType([schema.fields[0]]))) for p in parts if p["kind"] == "gone"]
        if not gone:
            return reduce(lambda a, b: a.unionByName(b), [d for _, d in rows])
        df = reduce(lambda a, b: a.unionByName(b), [d.withColumn("__seq", F.lit(s)) for s, d in rows])
        last = reduce(lambda a, b: a.unionByName(b), [d.withColumn("__gone", F.lit(s)) for s, d in gone]).groupBy(F.col(key).alias("__key")).agg(F.max("__gone").alias("__gone"))
        return df.join(last, (F.col(key) == F.col("__key")) & (F.col("__gone") > F.col("__seq")), "left_anti").drop("__seq")

    def table(self, name: str, version: int | None = None, *, links: bool = True) -> Table:
        snap = self._open if self._open is not None and version is None else self.snapshot(version)
        return self._table(snap.tables, name, links, set())

    def _table(self, tables: dict[str, dict], name: str, links: bool, seen: set[str]) -> Table:
        if name not in tables:
            raise KeyError(f"no table {name}")
        entry = tables[name]
        spec = TableSpec.from_json(entry["spec"])
        aside = lambda kind, schema: self.spark.read.schema(schema).parquet(*[self.store.at(p) for p in entry[kind]]) if entry[kind] else None
        df = self._rows(entry, entry["parts"])
        others = {}
        if links:
            for b in spec.blocks:
                if b.link and b.link.table in tables and b.link.table not in seen | {name}:
                    others[b.link.table] = self._table(tables, b.link.table, links, seen | {name})
        kind = df.schema[spec.id].dataType.simpleString()
        aliases = aside("aliases", f"seq int, old {kind}, new {kind}")
        if aliases is not None:
            aliases = aliases.groupBy("old").agg(F.max_by("new", "seq").alias("new"))
        counters = aside("counters", f"id {kind}, hits long")
        if counters is not None:
            counters = counters.groupBy("id").agg(F.sum("hits").alias("hits"))
        return Table(spec, df, others, aside("deleted", df.schema), aliases, counters)

    # -- writes, each a transaction by itself unless one is open

    def transaction(self, note: str = "") -> Transaction:
        return Transaction(self, note) if self._open is None else _Joined(self._open)

    def insert(self, name: str, rows: DataFrame) -> None:
        with self.transaction(f"insert {name}") as t:
            _, new = dml.insert(self._table(t.tables, name, False, set()), rows)
            t.add(name, new, "insert")

    def update(self, name: str, rows: DataFrame, force: bool | None = None) -> None:
        with self.transaction(f"update {name}") as t:
            table = self._table(t.tables, name, False, set())
            _, changed = dml.update(table, rows, force=force)
            t.replace(name, table, changed, "update")

    def delete(self, name: str, ids: DataFrame | Iterable) -> None:
        with self.transaction(f"delete {name}") as t:
            table = self._table(t.tables, name, False, set())
            _, gone = dml.delete(table, id_frame(table, ids))
            if table.spec.keep_deleted:
                t.aside(name, "deleted", gone)
            t.gone(name, gone.select(table.id))

    def change(self, name: str, changed: DataFrame, ids: DataFrame | Iterable) -> None:
        """Put in place what update_field, insert_item, delete_item or replace_values made of some rows."""
        with self.transaction(f"change {name}") as t:
            table = self._table(t.tables, name, False, set())
            t.replace(name, table, changed.join(id_frame(table, ids), table.id, "left_semi"), "update")

    def alias(self, name: str, pairs: DataFrame) -> None:
        with self.transaction(f"alias {name}") as t:
            if not TableSpec.from_json(t.tables[name]["spec"]).use_alias:
                raise dml.Rejected(f"{name} takes no aliases")
            n = len(t.tables[name]["aliases"])
            old, new = pairs.columns[:2]
            t.aside(name, "aliases", pairs.select(F.lit(n).alias("seq"), F.col(old).alias("old"), F.col(new).alias("new")))

    def count_reads(self, name: str, ids: DataFrame) -> None:
        with self.transaction(f"hits {name}") as t:
            t.aside(name, "counters", ids.groupBy(F.col(ids.columns[0]).alias("id")).agg(F.count("*").alias("hits")))

    # -- upkeep

    def vacuum(self, name: str, files: int | None = None) -> None:
        """The table's live rows as one part, so that reads need no join with what is gone."""
        with self.transaction(f"vacuum {name}") as t:
            table = self._table(t.tables, name, False, set())
            df = table.df.coalesce(files) if files else table.df
            t.tables[name] = t.tables[name] | {"parts": []}
            t.add(name, df, None)

    def purge(self, keep: int = 1) -> list[str]:
        """Delete parts that none of the last `keep` versions names; what it deleted."""
        live: set[str] = set()
        for v in sorted(self.versions())[-keep:]:
            for e in self.snapshot(v).tables.values():
                live |= {p["path"] for p in e["parts"]} | {p for k in ("deleted", "aliases", "counters") for p in e[k]}
        out = [f"data/{n}" for n in self.store.names("data") if f"data/{n}" not in live]
        for p in out:
            self.store.delete(p)
        return out

    def audit(self) -> DataFrame:
        """at, user, action, table, id of every row written: also what a stream of changes reads."""
        return self.spark.read.schema(AUDIT).json(self.store.at("audit")) if self.store.exists("audit") else self.spark.createDataFrame([], AUDIT)

    def cached(self, key: tuple, make) -> Any:
        """A result kept until the next commit of this catalog, or of another one."""
        own = (self.snapshot().version, *key)
        if own not in self._memo:
            self._memo[own] = make()
        return self._memo[own]

    def history(self, name: str, id: Any | None = None) -> DataFrame:
        """id, trail: who did what to each row, in order; a row's trail is as long as the row was written often."""
        rows = self.audit().filter(F.col("table") == name)
        if id is not None:
            rows = rows.filter(F.col("id") == str(id))
        return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "user", "action"))).alias("trail"))


AUDIT = "at double, user string, action string, table string, id string"


class Transaction:
    """Parts are written as they come; nothing is seen before the entry is created at the end."""

    def __init__(self, catalog: Catalog, note: str):
        self.catalog, self.note = catalog, note

    def __enter__(self) -> Transaction:
        self.base = self.catalog.snapshot()
        self.tables = json.loads(json.dumps(self.base.tables))
        self.written: list[str] = []
        self.audits: list[DataFrame] = []
        self.catalog._open = self
        return self

    def __exit__(self, kind, _error, _trace) -> None:
        self.catalog._open = None
        if kind is not None:
            self.rollback()
            return
        try:
            self.catalog._commit(self.base, self.tables, self.note)
        except Conflict:
            self.rollback()
            raise
        for df in self.audits:
            df.write.mode("append").json(self.catalog.store.at("audit"))

    def rollback(self) -> None:
        for p in self.written:
            self.catalog.store.delete(p)
        self.written = []

    def _write(self, df: DataFrame) -> str:
        path = f"data/{uuid.uuid4().hex}"
        self.written.append(path)
        df.write.parquet(self.catalog.store.at(path))
        return path

    def _audit(self, name: str, path: str, key: str, action: str) -> None:
        ids = self.catalog.spark.read.parquet(self.catalog.store.at(path)).select(F.col(key).cast("string").alias("id"))
        self.audits.append(ids.select(F.lit(time.time()).alias("at"), F.lit(self.catalog.user).alias("user"), F.lit(action).alias("action"), F.lit(name).alias("table"), "id"))

    def _next(self, name: str) -> int:
        return max((p["seq"] for p in self.tables[name]["parts"]), default=-1) + 1

    def add(self, name: str, df: DataFrame, action: str | None) -> None:
        path = self._write(df)
        self.tables[name]["parts"].append({"kind": "rows", "path": path, "seq": self._next(name)})
        if action:
            self._audit(name, path, df.columns[0], action)

    def gone(self, name: str, ids: DataFrame) -> None:
        path = self._write(ids.distinct())
        self.tables[name]["parts"].append({"kind": "gone", "path": path, "seq": self._next(name)})
        self._audit(name, path, ids.columns[0], "delete")

    def replace(self, name: str, table: Table, rows: DataFrame, action: str) -> None:
        path = self._write(rows)
        saved = self.catalog.spark.read.schema(rows.schema).parquet(self.catalog.store.at(path))
        ids = self._write(saved.select(table.id).distinct())
        at = self._next(name)
        self.tables[name]["parts"] += [{"kind": "gone", "path": ids, "seq": at}, {"kind": "rows", "path": path, "seq": at}]
        self._audit(name, path, table.id, action)

    def aside(self, name: str, kind: str, df: DataFrame) -> None:
        self.tables[name][kind].append(self._write(df))


class _Joined:
    """A write inside an open transaction: the outer one commits."""

    def __init__(self, outer: Transaction):
        self.outer = outer

    def __enter__(self) -> Transaction:
        return self.outer

    def __exit__(self, *_args) -> None:
        return None
