"""The driver's tables as tables of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.core import Table
from ..spec import TableSpec, table_spec

REGION = table_spec("region", [("r_regionkey", "auto_id"), "r_name"])
NATION = table_spec("nation", [("n_nationkey", "auto_id"), "n_name", ("n_regionkey", "num", "region;1")])
CUSTOMER = table_spec("customer", [("c_custkey", "auto_id"), "c_name", ("c_nationkey", "num", "nation;1"), ("c_acctbal", "num"), "c_mktsegment"], match=[2, 4], sort=[3], facet=[2, 4])
PART = table_spec(
    "part", [("p_partkey", "auto_id"), "p_name", "p_brand", "p_type", ("p_size", "num"), ("p_retailprice", "num")],
    match=[1, 2, 3, 4], search=[1, 3], sort=[1, 5], facet=[2, 3, 4], suggest=[1], slug=[1], extra={"ascii_text": True},
)
ORDERS = table_spec(
    "orders", [("o_orderkey", "auto_id"), ("o_custkey", "num", "customer;1"), "o_orderstatus", ("o_totalprice", "num"), ("o_orderdate", "datetime"), "o_orderpriority"],
    match=[2, 5], sort=[3], facet=[2, 5], use_junk=True, junk_rules=["o_orderstatus eq P"], facet_rules=["o_totalprice > 1000"],
)
DOCUMENTS = table_spec("documents", [("doc_id", "auto_id"), "text", "lang", "source", ("n_chars", "num")], match=[2, 3], search=[1], facet=[2, 3])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, spec: TableSpec) -> Table:
    """A table with the tables that its links lead to."""
    known = {s.name: s for s in (REGION, NATION, CUSTOMER)}
    others = {b.link.table: table(spark, sf_dir, known[b.link.table]) for b in spec.blocks if b.link and b.link.table in known}
    return Table(spec, read(spark, sf_dir, spec.name), others)
