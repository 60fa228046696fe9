"""Command line: python -m tarnfield.cli ROOT ACTION ..., on the tables of a catalog. Results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import facet, read, search
from .plans import index
from .sources import exchange
from .sources.catalog import Catalog
from .spec import TableSpec


def _shown(df: DataFrame, out) -> None:
    for line in df.toJSON().toLocalIterator():
        out.write(line + "\n")


def _conditions(text: str | None) -> dict:
    return json.loads(text) if text else {}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnfield")
    p.add_argument("root")
    act = p.add_subparsers(dest="action", required=True)

    def action(name: str, *places: str, **options: dict):
        a = act.add_parser(name)
        for x in places:
            a.add_argument(x)
        for k, v in options.items():
            a.add_argument(f"--{k}", **v)

    page = {"offset": {"type": int, "default": 0}, "limit": {"type": int, "default": 0}, "sort": {}, "dir": {}, "filter": {}, "tier": {}}
    action("tables")
    action("create", "spec", "path", format={"default": "parquet"})
    action("attr", "table", "changes")
    action("info", "table")
    action("count", "table", block={}, keys={})
    action("read", "table", "id")
    action("read_list", "table", "ids")
    action("read_all", "table", **page)
    action("fetch", "table", "block", "values", **page)
    action("filter", "table", "conditions", type={"default": "and"}, **{k: v for k, v in page.items() if k != "filter"})
    action("search", "table", "query", mode={"default": "and"}, **page)
    action("facets", "table", selected={})
    for name in ("insert", "update"):
        action(name, "table", "rows")
    action("delete", "table", "ids")
    for name in ("vacuum", "drop", "truncate"):
        action(name, "table")
    action("rename", "table", "new")
    action("migrate", "table", "spec", renamed={})
    action("reindex", "table", "folder")
    action("check", "table", "folder")
    action("export", "table", "folder")
    action("import", "table", "path")
    action("dump", "folder")
    action("restore", "folder", force={"action": "store_true"})
    action("history", "table", id={})
    return p


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    c = Catalog(spark, a.root)
    table = lambda: c.table(a.table)
    say = lambda x: out.write(json.dumps(x, ensure_ascii=False) + "\n")
    sort = int(a.sort) if getattr(a, "sort", None) and a.sort.lstrip("-").isdigit() else getattr(a, "sort", None)

    def page(p: read.Page) -> None:
        if a.limit:
            say({"total": p.total})
        _shown(p.df, out)

    match a.action:
        case "tables":
            say(c.tables())
        case "create":
            with open(a.spec) as f:
                spec = TableSpec.from_json(f.read())
            c.create(spec, exchange.table_from(spark, a.path, spec, a.format).df)
        case "attr":
            say(json.loads(c.attr(a.table, **json.loads(a.changes)).to_json()))
        case "info":
            t = table()
            say({"spec": json.loads(t.spec.to_json()), "columns": dict(t.df.dtypes), "rows": t.df.count()})
        case "count":
            say(read.table_count(table())) if a.block is None else _shown(read.field_count(table(), a.block, a.keys), out)
        case "read":
            _shown(read.read_id(table(), a.id), out)
        case "read_list":
            _shown(read.read_list(table(), a.ids.split(",")), out)
        case "read_all":
            page(read.read_all(table(), a.offset, a.limit, sort=sort, dir=a.dir, filter=_conditions(a.filter), tier=a.tier))
        case "fetch":
            page(read.field_fetch(table(), a.block, a.values.split(","), a.offset, a.limit, sort=sort, dir=a.dir, filter=_conditions(a.filter), tier=a.tier))
        case "filter":
            page(read.field_filter(table(), json.loads(a.conditions), type=a.type, sort=sort, dir=a.dir, offset=a.offset, limit=a.limit, tier=a.tier))
        case "search":
            page(search.search_table(table(), a.query, a.mode, a.offset, a.limit, filter=_conditions(a.filter), sort=sort, dir=a.dir, tier=a.tier))
        case "facets":
            say(facet.facet_menu(table(), selected=_conditions(a.selected)).groups)
        case "insert" | "update":
            t = table()
            lines = spark.createDataFrame([(json.dumps(r),) for r in json.loads(a.rows)], "value string")
            new = lines.select(F.from_json("value", t.df.schema).alias("r")).select("r.*")
            c.insert(a.table, new) if a.action == "insert" else c.update(a.table, new)
        case "delete":
            c.delete(a.table, a.ids.split(","))
        case "vacuum" | "drop" | "truncate":
            getattr(c, a.action)(a.table)
        case "rename":
            c.rename(a.table, a.new)
        case "migrate":
            with open(a.spec) as f:
                c.migrate(a.table, TableSpec.from_json(f.read()), _conditions(a.renamed))
        case "reindex":
            index.build(table(), a.folder)
        case "check":
            say(index.differences(index.attached(table(), a.folder)))
        case "export":
            exchange.to_tsv(table().df, a.folder)
        case "import":
            t = table()
            new = exchange.from_tsv(spark, a.path, t.spec)
            c.insert(a.table, new)
        case "dump":
            say({k: v["rows"] for k, v in exchange.dump(c, a.folder).items()})
        case "restore":
            say(exchange.restore(c, a.folder, force=a.force))
        case "history":
            _shown(c.history(a.table, a.id), out)
    return 0


def main() -> int:
    from .session import importable

    spark = importable(SparkSession.builder.appName("tarnfield").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
