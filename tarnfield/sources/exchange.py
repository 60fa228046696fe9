"""Export and import: tab-separated text of four ages, and archives with a manifest of checksums."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_escape, char_unescape
from ..operators.core import Table
from ..spec import TableSpec
from .catalog import Catalog
from .files import Store


def to_tsv(df: DataFrame, folder: str) -> None:
    """A row a line, cells escaped and parted by tabs; lists and maps as JSON."""
    cells = [char_escape(F.to_json(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string")) for c in df.columns]
    df.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cells]).alias("value")).write.text(folder)


def from_tsv(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Rows of text columns named as the spec's blocks; lines of any age."""
    line = F.regexp_replace("value", r"\r$", "")
    fields = tsv_fields(line)
    rows = spark.read.text(path).filter(line != "").select(fields.alias("f"))
    return rows.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(b.id) for i, b in enumerate(spec.blocks)])


def tsv_format(line: Column) -> Column:
    """v4 escaped characters or marked lists, v3 <TABn>, v2 \\T, v1 plain; nothing is v5."""
    return (
        F.when(F.coalesce(line, F.lit("")) == "", "v5").when(line.rlike(r"ARRAY:|HASH:|&#(?:38|61|124|92|30);"), "v4")
        .when(line.rlike(r"<TAB[0-9]+>"), "v3").when(line.rlike(r"\\T"), "v2").otherwise("v1")
    )


def tsv_fields(line: Column) -> Column:
    """The cells of a line. Deeper <TABn> levels and marked lists come out joined by commas, as a cell holds several values."""
    plain = F.split(line, "\t", -1)
    old = F.split(F.regexp_replace(line, "<TAB0>", "\t"), "\t", -1)
    deeper = F.transform(old, lambda x: F.regexp_replace(F.regexp_replace(x, r"<TAB[1-9]>-(?=<TAB|$)", ","), r"<TAB[1-9]>", ","))
    marked = F.transform(plain, lambda x: F.when(x.rlike("^(ARRAY|HASH):"), F.regexp_replace(F.regexp_replace(x, "^(ARRAY|HASH):", ""), r"\|", ",")).otherwise(x))
    second = F.transform(plain, lambda x: F.regexp_replace(x, r"\\T", "\t"))
    kind = tsv_format(line)
    return F.when(kind == "v3", F.transform(deeper, char_unescape)).when(kind == "v2", F.transform(second, char_unescape)).otherwise(F.transform(F.when(kind == "v4", marked).otherwise(plain), char_unescape))


def checksum(df: DataFrame) -> dict:
    """Row count and an order-free checksum of a table, made in one pass."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns)))
    r = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.shiftrightunsigned(row, 32).cast("decimal(20,0)")).alias("s")).first()
    return {"rows": r["n"], "xor": r["x"] or 0, "sum": str(r["s"] or 0)}


def dump(catalog: Catalog, folder: str, names: list[str] | None = None) -> dict:
    """Write the tables' live rows and specs, and manifest.json with each table's checksum."""
    store = Store(catalog.spark, folder)
    out = {}
    for name in names or catalog.tables():
        t = catalog.table(name, links=False)
        t.df.write.parquet(store.at(f"tables/{name}"))
        out[name] = {"spec": t.spec.to_json(), "schema": t.df.schema.json(), **checksum(t.df)}
    store.create("manifest.json", json.dumps(out, ensure_ascii=False))
    return out


class Damaged(ValueError):
    """An archive whose rows don't match its manifest."""


def restore(catalog: Catalog, folder: str, *, force: bool = False) -> list[str]:
    """Take over an archive's tables in one commit, after a check of their sums; into an empty catalog unless forced."""
    from pyspark.sql.types import StructType

    store = Store(catalog.spark, folder)
    manifest = json.loads(store.read("manifest.json"))
    if catalog.tables() and not force:
        raise ValueError("the catalog isn't empty")
    frames = {}
    for name, m in manifest.items():
        df = catalog.spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(store.at(f"tables/{name}"))
        if checksum(df) != {k: m[k] for k in ("rows", "xor", "sum")}:
            raise Damaged(f"{name} doesn't match the manifest")
        frames[name] = df
    with catalog.transaction("restore") as t:
        for name, df in frames.items():
            t.tables[name] = {"spec": manifest[name]["spec"], "schema": manifest[name]["schema"], "parts": [], "deleted": [], "aliases": [], "counters": []}
            t.add(name, df, None)
    return list(frames)


def table_from(spark: SparkSession, path: str, spec: TableSpec, format: str = "parquet", **others: Table) -> Table:
    """A table over files of any format that Spark reads."""
    df = from_tsv(spark, path, spec) if format == "tsv" else spark.read.format(format).load(path)
    return Table(spec, df, others)
