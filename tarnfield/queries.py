"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, cells, dates, text
from .functions.locales import locale
from .operators import core, dml, facet, link, read, search, sets
from .plans import index, star
from .session import importable, scratch
from .spec import table_spec
from .streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _part(spark: SparkSession, d: str) -> core.Table:
    return star.table(spark, d, star.PART)


def _orders(spark: SparkSession, d: str) -> core.Table:
    return star.table(spark, d, star.ORDERS)


def _customer(spark: SparkSession, d: str) -> core.Table:
    return star.table(spark, d, star.CUSTOMER)


# -- scans and point reads


@query("SELECT * FROM part ORDER BY p_partkey DESC LIMIT 20 OFFSET 40")
def read_all_page(spark, d):
    return read.read_all(_part(spark, d), 40, 20).df


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 25")
def read_all_sorted_asc(spark, d):
    return read.read_all(_part(spark, d), 0, 25, sort=-5).df.select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 25 OFFSET 100")
def read_all_sorted_desc(spark, d):
    return read.read_all(_part(spark, d), 100, 25, sort=5).df.select("p_partkey", "p_retailprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 500")
def read_all_range(spark, d):
    return read.read_all(_customer(spark, d), filter={"c_acctbal": {"max": 500}}).df.select("c_custkey", "c_acctbal")


@query("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def read_id_first(spark, d):
    return read.read_first(_orders(spark, d), sort=3)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def read_id_last(spark, d):
    return read.read_last(_orders(spark, d), sort=3)


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def read_id_point(spark, d):
    return read.read_id(_orders(spark, d), 77)


@query("SELECT p.*, v.pos FROM part p JOIN (VALUES (0, 17), (1, 3), (2, 99), (3, 17), (4, 0)) v(pos, id) ON p.p_partkey = v.id")
def read_list_order(spark, d):
    return read.read_list(_part(spark, d), [17, 3, 99, 17, 0, 10**9], keep_pos=True)


@query("SELECT v.id AS p_partkey, p.p_partkey IS NOT NULL AS found FROM (VALUES (5::BIGINT), (1000000000::BIGINT), (7::BIGINT)) v(id) LEFT JOIN part p ON p.p_partkey = v.id")
def exist_list(spark, d):
    return read.exist_list(_part(spark, d), [5, 10**9, 7])


@query("SELECT count(*) AS n FROM lineitem")
def table_count(spark, d):
    return star.read(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT greatest(max(o_orderkey), 900000) AS last_id FROM orders")
def table_lastid(spark, d):
    t = _orders(spark, d)
    gone = t.df.limit(1).withColumn("o_orderkey", F.lit(900000).cast("long"))
    return read.table_lastid(core.Table(t.spec, t.df, t.others, deleted=gone))


@query("SELECT o_orderkey FROM orders")
def table_keys(spark, d):
    return read.table_keys(_orders(spark, d))


@query("SELECT CASE WHEN p_partkey < 100 THEN p_partkey + 1000 ELSE p_partkey END AS canonical, p_partkey FROM part WHERE p_size < 10")
def alias_links(spark, d):
    t = _part(spark, d)
    pairs = t.df.filter("p_partkey < 100").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000).alias("new"))
    return read.read_links(core.Table(t.spec, t.df, aliases=pairs), t.df.filter("p_size < 10").select("p_partkey"))


@query("SELECT v.id AS p_partkey, coalesce(n, 0)::BIGINT AS hits FROM (VALUES (1::BIGINT), (2::BIGINT), (1000000000::BIGINT)) v(id) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) c ON c.l_partkey = v.id")
def read_counters(spark, d):
    t = _part(spark, d)
    hits = star.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("hits"))
    return read.read_count(core.Table(t.spec, t.df, counters=hits), [1, 2, 10**9])


# -- by values


@query("SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def field_fetch_any(spark, d):
    return read.field_fetch(_orders(spark, d), 5, ["1-URGENT", "2-HIGH"], tier="AB").df


@query("SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(replace(p_name, ' ', ','), ','), ['red', 'bolt'])")
def field_fetch_multivalue(spark, d):
    t = _part(spark, d)
    t = t.with_df(t.df.withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit(","))))
    return read.field_fetch(t, "p_name", ["red", "bolt"]).df.select("p_partkey", F.replace("p_name", F.lit(","), F.lit(" ")).alias("p_name"))


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') AND p_size BETWEEN 5 AND 30 ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20")
def field_filter_and(spark, d):
    found = read.field_filter(_part(spark, d), {2: ["Brand#2", "Brand#4"], "p_size": {"min": 5, "max": 30}}, sort=5, limit=20)
    return found.df.select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("SELECT p_partkey FROM part WHERE (p_brand = 'Brand#2' OR p_type = 'SMALL') AND p_size >= 10")
def field_filter_or(spark, d):
    return read.field_filter(_part(spark, d), {2: "Brand#2", 3: "SMALL", 4: {"min": 10}}, type="or", keys_only=True).df


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1000.5 AND p_type = 'ECONOMY'")
def field_filter_range(spark, d):
    return read.field_filter(_part(spark, d), {"p_retailprice": {"min": 950, "max": 1000.5}, "p_type": "ECONOMY"}).df.select("p_partkey", "p_retailprice")


@query("SELECT p_partkey FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_partkey < 20) AND p_brand = 'Brand#4' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def field_filter_scoped(spark, d):
    t = _part(spark, d)
    sizes = [str(r[0]) for r in t.df.filter("p_partkey < 20").select("p_size").distinct().collect()]
    scope = star.read(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey")
    return read.field_filter(t, {"p_size": sizes, "p_brand": "Brand#4"}, base_ids=scope, keys_only=True).df


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')")
def read_field(spark, d):
    return read.read_field(_orders(spark, d), 2, ["F", "O"])


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand")
def field_count_all(spark, d):
    return read.field_count(_part(spark, d), 2)


@query("SELECT v.k AS value, count(p_partkey) AS n FROM (VALUES ('Brand#2'), ('Brand#4'), ('nothing')) v(k) LEFT JOIN part ON p_brand = v.k GROUP BY v.k")
def field_count_keys(spark, d):
    return read.field_count(_part(spark, d), "p_brand", "Brand#2, Brand#4, nothing")


@query("SELECT value, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value")
def field_count_multivalue(spark, d):
    t = _part(spark, d)
    return read.field_count(t.with_df(t.df.withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit(";")))), 1)


@query("SELECT DISTINCT 'p_brand' AS block, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_size', p_size::VARCHAR FROM part")
def field_keys(spark, d):
    return read.field_keys(_part(spark, d), [2, "p_size"])


@query("SELECT p_brand AS value, p_partkey // 512 AS part, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1, 2")
def field_keyvals(spark, d):
    return read.field_keyvals(_part(spark, d), 2, span=512).select("value", "part", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


# -- facets

_ACTIVE = "o_totalprice > 1000 AND o_orderstatus <> 'P'"


@query(f"SELECT 2 AS block, o_orderstatus AS value, count(*) AS n FROM orders WHERE {_ACTIVE} GROUP BY 2 UNION ALL SELECT 5, o_orderpriority, count(*) FROM orders WHERE {_ACTIVE} GROUP BY 2")
def facet_counts(spark, d):
    return facet.field_allfltkeys(_orders(spark, d))


@query(f"SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE {_ACTIVE} AND o_orderstatus = 'F' AND o_totalprice BETWEEN 0 AND 100000 GROUP BY 1")
def facet_counts_filtered(spark, d):
    return facet.field_fltkeys(_orders(spark, d), 5, {"f2": "F", 5: "2-HIGH", 3: {"max": 100000}})


@query("""SELECT 2 AS block, p_brand AS value, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_retailprice >= 920 GROUP BY 2
UNION ALL SELECT 3, p_type, count(*) FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') AND p_retailprice >= 920 GROUP BY 2
UNION ALL SELECT 4, p_size::VARCHAR, count(*) FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') AND p_type IN ('ECONOMY', 'SMALL') AND p_retailprice >= 920 GROUP BY 2""")
def facet_menu_disjunctive(spark, d):
    return facet.facet_menu(_part(spark, d), selected={"f2": "Brand#2,Brand#4", 3: ["ECONOMY", "SMALL"], 5: {"min": 920}}).counts


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') AND p_type IN ('ECONOMY', 'SMALL') AND p_retailprice >= 920")
def facet_menu_ids(spark, d):
    return facet.facet_menu(_part(spark, d), selected={"f2": "Brand#2,Brand#4", 3: ["ECONOMY", "SMALL"], 5: {"min": 920}}).page.df


@query("""WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1),
s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)
SELECT * FROM (SELECT 2 AS block, 'Nation' AS name, c_nationkey::VARCHAR AS value, n_name AS label, n, FALSE AS checked, row_number() OVER (ORDER BY n DESC, c_nationkey::VARCHAR)::INT AS rank FROM c JOIN nation ON n_nationkey = c_nationkey) WHERE rank <= 5
UNION ALL SELECT 4, 'Segment', c_mktsegment, c_mktsegment, n, c_mktsegment = 'MACHINERY', row_number() OVER (ORDER BY c_mktsegment)::INT FROM s""")
def facet_topn_labelled(spark, d):
    defs = [{"blk": 2, "label": "Nation", "name_idx": 1, "limit": 5}, {"blk": 4, "label": "Segment", "sort": "value", "sort_dir": "asc"}]
    return facet.facet_menu(_customer(spark, d), selected={4: "MACHINERY"}, facet_defs=defs).items


# -- search


def _single(sql: str) -> str:
    """Doubled letters written once, as English spelling rules have it."""
    for c in "bdfglmnprstz":
        sql = f"replace({sql}, '{c}{c}', '{c}')"
    return sql


_WORDS = f"string_split({_single('p_name')}, ' ')"
_TYPE = f"[{_single('lower(p_type)')}]"


@query(f"SELECT p_partkey FROM part WHERE list_contains({_WORDS}, 'red') AND list_contains({_WORDS}, 'bolt')")
def search_and(spark, d):
    return search.search_table(_part(spark, d), "Red BOLT", keys_only=True).df


@query(f"SELECT p_partkey FROM part WHERE list_contains({_WORDS}, 'red') OR list_contains({_WORDS}, 'bolt') OR list_contains({_TYPE}, 'bolt')")
def search_or(spark, d):
    return search.search_table(_part(spark, d), "red bolt", "or", keys_only=True).df


@query(f"SELECT p_partkey, p_size FROM part WHERE list_contains({_WORDS}, 'smal') AND p_brand IN ('Brand#2', 'Brand#3') AND p_size BETWEEN 0 AND 25 OR list_contains({_TYPE}, 'smal') AND p_brand IN ('Brand#2', 'Brand#3') AND p_size BETWEEN 0 AND 25 ORDER BY p_size DESC, p_partkey DESC LIMIT 10")
def search_filtered(spark, d):
    return search.search_table(_part(spark, d), "small", filter={2: ["Brand#2", "Brand#3"], 4: {"max": 25}}, sort=4, limit=10).df.select("p_partkey", "p_size")


@query(f"SELECT p_partkey FROM part WHERE list_contains({_WORDS}, 'ring') AND list_contains({_TYPE}, 'economy')")
def search_cross_block(spark, d):
    return search.read_search(_part(spark, d), "ring economy", cross_block=True)


@query(f"SELECT p_partkey FROM part WHERE list_contains({_WORDS}, 'ring') AND list_contains({_WORDS}, 'smal')")
def search_same_block(spark, d):
    return search.read_search(_part(spark, d), "ring small")


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[''’‘′ʼ-]', ' ', 'g'), '\s+')) AS w FROM documents),
p AS (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(w, '[^a-z0-9&.,_]+', ' ', 'g')), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), ' ')) AS w FROM t)
SELECT doc_id FROM p WHERE w IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT w) = 2""")
def search_documents(spark, d):
    return search.search_table(star.table(spark, d, star.DOCUMENTS), "the and", keys_only=True).df


_NORM = "SELECT unnest(string_split(p_name, ' ')) AS w FROM part"


@query(f"SELECT prefix, w AS word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, w)::INT AS rank FROM (SELECT w, n, unnest(list_transform(generate_series(2, least(12, length(w))), lambda k: substr(w, 1, k))) AS prefix FROM (SELECT w, count(*) AS n FROM ({_NORM}) WHERE length(w) >= 2 GROUP BY w))) WHERE rank <= 10")
def suggest_prefix(spark, d):
    return search.suggestions(_part(spark, d)).prefixes


@query("SELECT word, next, next AS next_ascii, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, next)::INT AS rank FROM (SELECT split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', 2) AS next, count(*) AS n FROM part GROUP BY 1, 2)) WHERE rank <= 300")
def suggest_next(spark, d):
    return search.suggestions(_part(spark, d)).transitions


# -- tiers and links


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY 1 DESC LIMIT 15")
def tier_a(spark, d):
    return read.read_all(_orders(spark, d), 0, 15, tier="A", keys_only=True).df


@query("SELECT o_orderkey FROM orders ORDER BY o_orderstatus = 'P', o_orderkey DESC LIMIT 50 OFFSET (SELECT count(*) - 25 FROM orders WHERE o_orderstatus <> 'P')")
def tier_ab(spark, d):
    t = _orders(spark, d)
    hot = read.read_all(t, tier="A").total
    return read.read_all(t, hot - 25, 50, tier="AB", keys_only=True).df


@query("SELECT o_orderkey FROM orders ORDER BY o_orderstatus <> 'P', o_orderkey DESC LIMIT 40")
def tier_ba(spark, d):
    return read.read_all(_orders(spark, d), 0, 40, tier="BA", keys_only=True).df


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'B' ELSE 'A' END AS tier, count(*) AS n FROM orders GROUP BY 1")
def tier_count(spark, d):
    return core.with_tier(_orders(spark, d)).groupBy(F.col(core.TIER).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey >= 2 AND c_acctbal > 100")
def fk_rule(spark, d):
    t = _customer(spark, d)
    t = core.Table(t.spec.with_(facet_rules=table_spec("x", ["a"], facet_rules=["c_nationkey->n_regionkey >= 2", "c_acctbal > 100"]).facet_rules), t.df, t.others)
    return core.with_rule(t, t.df, t.spec.facet_rules, "ok", every=True).filter("ok").select("c_custkey")


@query("SELECT c_custkey, c_name, n_nationkey::VARCHAR || ':' || n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inflate_display(spark, d):
    shown = link.inflate(_customer(spark, d))
    return shown.select("c_custkey", "c_name", F.array_join(F.transform(F.map_entries("c_nationkey"), lambda e: F.concat_ws(":", e["key"], e["value"])), ";").alias("nation"))


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def repeat_inflate(spark, d):
    items = star.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = link.nested(star.read(spark, d, "orders").select("o_orderkey"), items, "o_orderkey", "l_orderkey", "l_linenumber")
    return out.select("o_orderkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("items"))


@query("SELECT o_orderkey, coalesce(string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR), '') AS item_ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def repeat_ids(spark, d):
    items = star.read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("line")).distinct()
    out = link.nested(star.read(spark, d, "orders").select("o_orderkey"), items, "o_orderkey", "l_orderkey", "line")
    spec = table_spec("orders", ["o_orderkey", "item_ids", "items"], repeat_ids=1, repeat_start=2)
    return link.with_child_ids(core.Table(spec, out)).select("o_orderkey", "item_ids")


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY p_partkey) = 1 THEN base ELSE base || '-' || p_partkey END AS slug FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS base FROM part)")
def slug_build(spark, d):
    return link.slugs(_part(spark, d))


# -- sets


def _big(spark: SparkSession, d: str) -> DataFrame:
    return star.read(spark, d, "lineitem").filter("l_quantity > 40").select("l_orderkey")


def _rich(spark: SparkSession, d: str) -> DataFrame:
    return star.read(spark, d, "orders").filter("o_totalprice > 300000").select("o_orderkey")


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def set_union(spark, d):
    return sets.union([_big(spark, d), _rich(spark, d)])


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def set_intersect(spark, d):
    return sets.crop(_big(spark, d), _rich(spark, d))


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def set_except(spark, d):
    return sets.punch(_big(spark, d), _rich(spark, d))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40 ORDER BY 1 DESC LIMIT 30 OFFSET 10")
def set_slice(spark, d):
    return sets.sliced(_big(spark, d).distinct(), 10, 30)


# -- scalars


@query("SELECT p_partkey, rpad(substr(regexp_replace(lower(p_name), '[^a-z0-9_]', '', 'g'), 1, 8), 8, ' ') AS k FROM part")
def sortkey_string8(spark, d):
    return _part(spark, d).df.select("p_partkey", cells.sort_key(F.col("p_name"), "string").alias("k"))


@query("SELECT c_custkey, lpad((c_acctbal::DECIMAL(18, 6) + 1000000000000)::VARCHAR, 20, '0') AS k FROM customer")
def sortkey_num(spark, d):
    return _customer(spark, d).df.select("c_custkey", cells.sort_key(F.col("c_acctbal"), "num").alias("k"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS second_id, strftime(o_orderdate, '%Y%m') AS month_id, strftime(o_orderdate, '%d/%m/%Y') AS date_short, strftime(o_orderdate, '%B') AS month, strftime(o_orderdate, '%A') AS day FROM orders")
def date_ids(spark, d):
    c = F.col("o_orderdate")
    df = star.read(spark, d, "orders")
    return df.select("o_orderkey", dates.part(c, "second_id").alias("second_id"), dates.part(c, "month_id").alias("month_id"), dates.part(c, "date_short").alias("date_short"), dates.month_name(c).alias("month"), dates.day_name(c).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS a, strftime(o_orderdate, '%d/%m/%Y') AS b, strftime(o_orderdate, '%Y%m%d') AS c FROM orders")
def dateid_roundtrip(spark, d):
    df = star.read(spark, d, "orders").withColumn("s", F.date_format("o_orderdate", "d.M.yyyy"))
    a = dates.str2dateid(F.col("s"))
    return df.select("o_orderkey", a.alias("a"), dates.dateid2str(a).alias("b"), dates.str2dateid(dates.dateid2str(a)).alias("c"))


@query("SELECT o_orderkey, strftime(x, '%Y%m%d') AS day FROM (SELECT o_orderkey, unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 3, INTERVAL 1 DAY)) AS x FROM orders WHERE o_orderstatus = 'F')")
def day_range(spark, d):
    df = star.read(spark, d, "orders").filter("o_orderstatus = 'F'")
    first, last = dates.part(F.col("o_orderdate"), "day_id"), F.date_format(F.date_add("o_orderdate", 3), "yyyyMMdd")
    return df.select("o_orderkey", F.explode(dates.day_range(first, last)).alias("day"))


@query("SELECT o_orderkey, CASE WHEN x % 7 = 0 THEN x // 7 + 1 ELSE abs(x) // 7 + 2 END::INT AS week, strftime(o_orderdate - INTERVAL 60 DAY, '%Y%m%d') AS earlier, day(last_day(o_orderdate))::INT AS days FROM (SELECT *, dayofyear(o_orderdate) - 1 - dayofweek(o_orderdate) AS x FROM orders)")
def date_arithmetic(spark, d):
    c = F.col("o_orderdate")
    return star.read(spark, d, "orders").select("o_orderkey", dates.dateid2week(dates.part(c, "day_id")).cast("int").alias("week"), dates.offset2date(c, "-2M").alias("earlier"), dates.days_in_month(c).alias("days"))


@query("SELECT c_custkey, c_acctbal > 100 AS gt, c_mktsegment = 'MACHINERY' AS eq, c_mktsegment <> 'MACHINERY' AS ne, c_acctbal <= 0 AS le FROM customer")
def cmp_op(spark, d):
    a, s = F.col("c_acctbal"), F.col("c_mktsegment")
    return _customer(spark, d).df.select("c_custkey", cells.compare(a, ">", "100").alias("gt"), cells.compare(s, "eq", "MACHINERY").alias("eq"), cells.compare(s, "ne", "MACHINERY").alias("ne"), cells.compare(a, "<=", "0").alias("le"))


@query("SELECT event_id, CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+(\\.[0-9]+)?') THEN try_cast(trim(v) AS DOUBLE) ELSE 0 END AS num FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN ' ' || user_id || ' ' ELSE '' END AS v FROM events)")
def enc_num(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, F.col("event_type")).when(F.col("event_id") % 4 == 2, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" "))).otherwise("")
    return star.read(spark, d, "events").select("event_id", cells.cast_soft(v, "num").alias("num"))


@query("SELECT p_partkey, list_sort([p_size, p_size + 1])[1]::VARCHAR || '|' || (p_size + 2)::VARCHAR AS a, p_size = 11 AS same FROM part")
def array_ops(spark, d):
    n = F.col("p_size")
    one, two = F.array(n, n + 1, n), F.array(n + 1, n + 2)
    both = arrays.punch(arrays.add(one, two), F.array(n + 1))
    return star.read(spark, d, "part").select("p_partkey", F.array_join(arrays.nodup(both).cast("array<string>"), "|").alias("a"), arrays.same(F.array(n), F.array(F.lit(11))).alias("same"))


@query("SELECT event_id, replace(replace(props, '=', '&#61;'), '|', '&#124;') AS escaped, props AS back, regexp_replace(event_type || '-' || user_id, '[^a-zA-Z0-9_]', '', 'g') AS key FROM events")
def escapes(spark, d):
    c = F.col("props")
    return star.read(spark, d, "events").select("event_id", text.char_escape(c).alias("escaped"), text.uri_decode(text.uri_encode(text.char_unescape(text.char_escape(c)))).alias("back"), text.key_encode(F.concat_ws("-", "event_type", "user_id")).alias("key"))


@query("SELECT c_custkey, 'sha256$' || c_mktsegment || '$' || sha256(c_mktsegment || c_name) AS shadow FROM customer")
def password_hash(spark, d):
    return _customer(spark, d).df.select("c_custkey", text.hashed(F.col("c_name"), F.col("c_mktsegment")).alias("shadow"))


@query("SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS k, CASE WHEN event_type IN ('error') THEN 'bad' WHEN event_type IN ('click', 'view') THEN 'seen' END AS class FROM events")
def text_rules(spark, d):
    rules = [{"field": "k", "match": r'"k": ([0-9]+)', "type": "integer"}, {"field": "class", "map": [("^error", "bad"), ("^(click|view)", "seen")]}]
    df = star.read(spark, d, "events").withColumn("raw", F.concat_ws(" ", "event_type", "props"))
    return df.select("event_id", text.text_rules(F.col("raw"), rules).alias("r")).select("event_id", "r.k", "r.class")


_WHOLE = "(p_partkey * 1001 + p_size)"


@query(f"SELECT p_partkey, format('{{:,}}', {_WHOLE}::BIGINT) AS en, replace(format('{{:,}}', {_WHOLE}::BIGINT), ',', '.') AS tr, '$' || format('{{:,}}', {_WHOLE}::BIGINT) || '.00' AS money, upper(p_brand) AS upper FROM part")
def locale_formats(spark, d):
    tr, en = locale("tr"), locale("en")
    c = (F.col("p_partkey") * 1001 + F.col("p_size")).cast("string")
    return _part(spark, d).df.select("p_partkey", en.column("format_number", c).alias("en"), tr.column("format_number", c).alias("tr"), en.column("format_currency", c).alias("money"), en.column("upper", F.col("p_brand")).alias("upper"))


# -- writes


@query("SELECT * FROM part WHERE p_partkey >= 50 UNION ALL SELECT p_partkey, p_name, 'changed', p_type, p_size, p_retailprice FROM part WHERE p_partkey < 50 UNION ALL SELECT p_partkey + 1000000, p_name, 'new', p_type, p_size, p_retailprice FROM part WHERE p_partkey < 10")
def upsert(spark, d):
    t = _part(spark, d)
    old = t.df.filter("p_partkey < 50").withColumn("p_brand", F.lit("changed"))
    new = t.df.filter("p_partkey < 10").withColumn("p_brand", F.lit("new")).withColumn("p_partkey", F.col("p_partkey") + 1000000)
    return dml.update(t, old.union(new), force=True)[0]


@query("SELECT p_partkey, p_partkey % 7 = 0 AS gone FROM part")
def delete_keep(spark, d):
    t = _part(spark, d)
    left, gone = dml.delete(t, t.df.filter("p_partkey % 7 = 0").select("p_partkey"))
    return left.select("p_partkey", F.lit(False).alias("gone")).union(gone.select("p_partkey", F.lit(True).alias("gone")))


@query("SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'x' ELSE p_name END AS p_name FROM part")
def update_field(spark, d):
    return dml.update_field(_part(spark, d), 7, "p_name", "x").select("p_partkey", "p_name")


@query("SELECT count(*) AS n, min(p_partkey) AS lo, max(p_partkey) AS hi FROM (SELECT p_partkey FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER () FROM part WHERE p_size < 5)")
def insert_autoid(spark, d):
    t = _part(spark, d)
    last = read.table_lastid(t).first()[0]
    out, _ = dml.insert(t, dml.numbered(t.df.filter("p_size < 5"), "p_partkey", last))
    return out.agg(F.count("*").alias("n"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))


@query("SELECT 'p_name' AS block, p_name AS value, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_violations(spark, d):
    spec = table_spec("part", [{"id": "p_partkey"}, {"id": "p_name", "valid": "unique"}])
    return dml.unique_violations(spec, star.read(spark, d, "part"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#2' THEN 'Two' WHEN 'Brand#4' THEN 'Four' ELSE p_brand END AS p_brand FROM part")
def replace_values(spark, d):
    return dml.replace_values(_part(spark, d), 2, {"Brand#2": "Two", "Brand#4": "Four"}).select("p_partkey", "p_brand")


# -- events

_JOURNAL = "SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'del' ELSE 'edit' END AS action, props FROM events"


@query(f"""WITH RECURSIVE j AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ({_JOURNAL})),
s(user_id, i, a, p) AS (
  SELECT user_id, 0, 'none', NULL::VARCHAR FROM (SELECT DISTINCT user_id FROM j)
  UNION ALL
  SELECT s.user_id, s.i + 1,
    CASE s.a WHEN 'none' THEN j.action WHEN 'add' THEN CASE j.action WHEN 'del' THEN 'none' ELSE 'add' END WHEN 'edit' THEN CASE j.action WHEN 'del' THEN 'del' ELSE 'edit' END ELSE CASE j.action WHEN 'add' THEN 'edit' ELSE 'del' END END,
    CASE WHEN s.a IN ('none', 'add', 'edit') AND j.action = 'del' THEN NULL WHEN s.a = 'none' THEN j.props WHEN s.a IN ('add', 'edit') AND j.action = 'edit' THEN j.props WHEN s.a = 'del' AND j.action = 'add' THEN j.props ELSE s.p END
  FROM s JOIN j ON j.user_id = s.user_id AND j.i = s.i + 1)
SELECT s.user_id, s.a AS action, s.p AS payload FROM s JOIN (SELECT user_id, max(i) AS m FROM j GROUP BY user_id) x ON x.user_id = s.user_id AND x.m = s.i WHERE s.a <> 'none'""")
def events_coalesce(spark, d):
    action = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "del").otherwise("edit")
    journal = star.read(spark, d, "events").select("user_id", "event_id", action.alias("action"), "props")
    return feed.coalesced(journal, ["user_id"], "event_id", "action", "props")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def events_last_state(spark, d):
    return feed.last_state(star.read(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def events_tumbling(spark, d):
    return feed.windowed(star.read(spark, d, "events"), "ts", "1 hour", ["event_type"], {"n": F.count("*")})


@query("SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def events_sliding(spark, d):
    return feed.windowed(star.read(spark, d, "events"), "ts", "2 hours", [], {"n": F.count("*")}, slide="1 hour")


@query("""WITH g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n FROM g GROUP BY user_id, s""")
def events_sessions(spark, d):
    return feed.sessions(star.read(spark, d, "events"), "ts", "6 hours", ["user_id"], {"n": F.count("*")})


# -- built lists


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') AND p_type IN ('ECONOMY', 'SMALL')")
def indexed_filter(spark, d):
    t = index.build(_part(spark, d), scratch(spark, "lists"))
    return read.field_filter(t, {2: ["Brand#2", "Brand#4"], 3: ["ECONOMY", "SMALL"]}, keys_only=True).df


@query(f"SELECT p_partkey FROM part WHERE list_contains({_WORDS}, 'red') AND list_contains({_WORDS}, 'bolt')")
def indexed_search(spark, d):
    t = index.build(_part(spark, d), scratch(spark, "lists"))
    return search.search_table(t, "red bolt", keys_only=True).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20 OFFSET 7000")
def indexed_deep_page(spark, d):
    t = _orders(spark, d)
    places = index.presorted(t, 3, scratch(spark, "places"))
    return index.page_of(t, places, 7000, 20).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, CASE WHEN p_partkey < 20 THEN 'changed' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 5 <> 3")
def catalog_writes(spark, d):
    from .sources.catalog import Catalog

    c = Catalog(spark, scratch(spark, "catalog"), "driver")
    t = _part(spark, d)
    c.create(t.spec, t.df)
    with c.transaction("two writes"):
        c.update("part", t.df.filter("p_partkey < 20").withColumn("p_brand", F.lit("changed")))
        c.delete("part", t.df.filter("p_partkey % 5 = 3").select("p_partkey"))
    return c.table("part").df.select("p_partkey", "p_brand")


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def bulk_ingest(spark, d):
    """All orders written into a catalog and their value lists built; counted from what was written."""
    from .sources.catalog import Catalog

    c = Catalog(spark, scratch(spark, "ingest"), "driver")
    t = _orders(spark, d)
    c.create(t.spec, t.df)
    built = index.build(c.table("orders"), scratch(spark, "ingest-lists"))
    return built.postings.filter("block = 2").groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 97 = 5 AND o_orderkey < 97000")
def read_list_batch(spark, d):
    """A thousand point reads at once."""
    t = _orders(spark, d)
    return read.read_list(t, range(5, 97_000, 97)).select("o_orderkey", "o_totalprice")


@query("SELECT event_id::VARCHAR AS event_id, event_type, props FROM events")
def tsv_roundtrip(spark, d):
    from .sources import exchange

    folder = scratch(spark, "tsv")
    exchange.to_tsv(star.read(spark, d, "events").select("event_id", "event_type", "props"), folder)
    return exchange.from_tsv(spark, folder, table_spec("events", ["event_id", "event_type", "props"]))


from . import queries_more  # noqa: E402, F401  the rest of the queries put themselves into QUERIES


def queries() -> dict[str, Query]:
    from functools import wraps

    def ready(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(importable(spark), sf_dir)

        return run

    return {k: ready(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
