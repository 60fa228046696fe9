"""Queries of scalar functions, child rows, catalogs, exchange and lists, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import arrays, cells, dates, text
from .functions.locales import locale
from .operators import dml, facet, link, read, search
from .operators.core import Table
from .plans import index, star
from .queries import _customer, _orders, _part, query
from .session import scratch
from .sources import exchange
from .sources.catalog import Catalog
from .sources.handles import Staging
from .sources.raw import Keyed, Lists
from .spec import grouped_spec, table_spec
from .streaming import feed
from .streaming.journal import Journal

# -- lists


def _lists(spark, d):
    n = F.col("p_size")
    return star.read(spark, d, "part"), F.array(n, n + 1, n), F.array(n + 1, n + 2)


def _text(c):
    return F.array_join(c.cast("array<string>"), ",")


@query("""SELECT p_partkey, (p_size + 1)::VARCHAR AS crop, (p_size + 1)::VARCHAR AS crop_ordered, p_size || ',' || p_size AS without, p_size || ',' || p_size AS without_positions, (p_size + 1)::VARCHAR AS keep,
(p_size + 1) || ',' || p_size AS pick, 1 AS rank, -1 AS no_rank FROM part""")
def array_sets(spark, d):
    df, a, b = _lists(spark, d)
    n = F.col("p_size")
    return df.select(
        "p_partkey", _text(arrays.crop(a, b)).alias("crop"), _text(arrays.crop_ordered(a, b, 2)).alias("crop_ordered"), _text(arrays.without(a, b)).alias("without"),
        _text(arrays.without_positions(a, F.array(F.lit(1)))).alias("without_positions"), _text(arrays.keep(a, lambda x: x > n)).alias("keep"), _text(arrays.pick(a, [1, 0])).alias("pick"),
        arrays.rank(a, n + 1).alias("rank"), arrays.rank(b, n).alias("no_rank"),
    )


@query("SELECT p_partkey, p_brand || '|' || p_type || ';' || p_name || '|' AS chunks, 1 AS last_row, 1 AS last_col, p_brand || ',' || p_name || ';' || p_type || ',x' AS turned FROM part")
def array_matrices(spark, d):
    shown = lambda m, inner: F.array_join(F.transform(m, lambda r: F.array_join(r, inner)), ";")
    matrix = F.array(F.array("p_brand", "p_type"), F.array(F.col("p_name"), F.lit("x")))
    return star.read(spark, d, "part").select(
        "p_partkey", shown(arrays.chunks(F.array("p_brand", "p_type", "p_name"), 2), "|").alias("chunks"), arrays.extent(matrix)["row"].alias("last_row"), arrays.extent(matrix)["col"].alias("last_col"),
        shown(arrays.transpose(matrix), ",").alias("turned"),
    )


@query("""SELECT p_partkey, array_to_string(list_sort([p_size, 5, 40]), ',') AS up, array_to_string(list_reverse_sort([p_size, 5, 40]), ',') AS down, array_to_string(list_sort([p_brand, p_type]), ',') AS words,
array_to_string(list_sort([p_size, 5, 40]), ',') AS shuffled, array_to_string(list_sort([p_brand, p_type]), ',') AS only_one FROM part""")
def array_orders(spark, d):
    numbers = F.array(F.col("p_size").cast("string"), F.lit("5"), F.lit("40"))
    maps = F.create_map(F.col("p_brand"), F.lit(1), F.lit("both"), F.lit(2)), F.create_map(F.lit("both"), F.lit(2), F.col("p_type"), F.lit(3))
    return star.read(spark, d, "part").select(
        "p_partkey", _text(arrays.sort(numbers)).alias("up"), _text(arrays.sort(numbers, "num", False)).alias("down"), _text(arrays.sort(F.array("p_brand", "p_type"))).alias("words"),
        _text(arrays.sort(arrays.shuffled(numbers))).alias("shuffled"), _text(F.array_sort(F.map_keys(arrays.key_diff(*maps)))).alias("only_one"),
    )


# -- text


@query("""SELECT p_partkey, upper(p_name) AS upper, lower(p_brand) AS lower, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title, lower(p_brand) AS folded,
lower(p_brand) = 'brand#2' AS equal, p_name ILIKE 'red%' AS found, upper(p_name[1]) AS first_char FROM part""")
def casing(spark, d):
    en, name, brand = locale("en"), F.col("p_name"), F.col("p_brand")
    return star.read(spark, d, "part").select(
        "p_partkey", en.column("upper", name).alias("upper"), en.column("lower", brand).alias("lower"), en.column("title", name).alias("title"), en.column("fold", brand).alias("folded"),
        en.column("equal", brand, "boolean", "BRAND#2").alias("equal"), en.column("search_regex", name, "boolean", "^RED").alias("found"), en.column("first_char", name).alias("first_char"),
    )


@query("""SELECT p_partkey, p_name || ' & x' AS normalized, 'A<' || p_name AS decoded, replace(lower(p_name), ' ', '-') AS slug, 'Cafe ' || p_name AS ascii, lower(p_name) AS words, '3' || p_size AS number,
p_name || ',' || p_type || ';x' AS trimmed, lower(p_name) AS suggested FROM part""")
def cleaned_text(spark, d):
    en, name = locale("en"), F.col("p_name")
    with_ = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return star.read(spark, d, "part").select(
        "p_partkey", en.column("normalize", with_("<b>", name, "</b> &amp; x")).alias("normalized"), en.column("decode_entities", with_("&#65;&lt;", name)).alias("decoded"),
        en.column("to_ascii", name, "string", True).alias("slug"), locale("gb").column("to_ascii", with_("Café ", name)).alias("ascii"), en.column("normalize_word", F.upper(name), "string", False, True).alias("words"),
        en.column("normalize_num", with_("٣", F.col("p_size").cast("string"))).alias("number"), cells.trim_space(with_("  ", name, " ,  ", F.col("p_type"), " ;x  ")).alias("trimmed"),
        en.column("suggest_words", name).alias("suggested"),
    )


@query("SELECT p_partkey, hex(encode(p_name)) AS raw, p_name AS back, substr(p_name, 2, 4) AS part FROM part")
def utf_bytes(spark, d):
    name = F.col("p_name")
    return star.read(spark, d, "part").select("p_partkey", F.hex(text.utf_encode(name)).alias("raw"), text.utf_decode(text.utf_encode(name)).alias("back"), F.substring(name, 2, 4).alias("part"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'Zero' WHEN n_nationkey < 10 THEN (['One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine'])[n_nationkey] || ' x' WHEN n_nationkey = 10 THEN 'Ten x' WHEN n_nationkey = 20 THEN 'Twenty x'
ELSE (['Ten', 'Twenty'])[n_nationkey // 10] || ' ' || (['One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine'])[n_nationkey % 10] || ' x' END AS words,
CASE WHEN n_nationkey = 1 THEN '1 row' ELSE n_nationkey || ' rows' END AS rows FROM nation""")
def amounts_in_words(spark, d):
    en, n = locale("en"), F.col("n_nationkey").cast("string")
    return star.read(spark, d, "nation").select("n_nationkey", en.column("num2text", n, "string", "x", "y").alias("words"), en.column("plural", n, "string", {"one": "{count} row", "other": "{count} rows"}).alias("rows"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS en, strftime(o_orderdate, '%d.%m.%Y') AS de, date_trunc('day', o_orderdate)::TIMESTAMP AS back FROM orders")
def locale_dates(spark, d):
    en, de = locale("en"), locale("de")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return star.read(spark, d, "orders").select("o_orderkey", en.column("format_date", day).alias("en"), de.column("format_date", day).alias("de"), en.column("parse_date", en.column("format_date", day), "timestamp_ntz").alias("back"))


@query("""SELECT event_id, replace(event_type, 'e', ',') AS listed, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, '' AS bad, lpad(strftime(ts, '%Y%m%d%H%M%S'), 14, '0') AS date_key FROM events""")
def cell_types(spark, d):
    df = star.read(spark, d, "events")
    return df.select(
        "event_id", _text(cells.cast_soft(F.replace(F.col("event_type"), F.lit("e"), F.lit("|")), "array")).alias("listed"), cells.cast_soft(F.col("props"), "hash")["k"].alias("k"),
        _text(F.map_keys(cells.cast_soft(F.lit("junk"), "hash"))).alias("bad"), cells.sort_key(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "datetime").alias("date_key"),
    )


# -- reads and links


@query("SELECT count(*) AS n, true AS there, false AS not_there FROM lineitem")
def table_exists(spark, d):
    t = star.table(spark, d, table_spec("lineitem", ["l_orderkey"]))
    o = _orders(spark, d)
    return spark.createDataFrame([(read.table_count(t), read.exist_id(o, o.df.agg(F.min("o_orderkey")).first()[0]), read.exist_id(o, -5))], "n long, there boolean, not_there boolean")


@query("SELECT 1::BIGINT AS rows, true AS of_table")
def read_random(spark, d):
    t = _part(spark, d)
    return read.read_random(t).join(t.df.select("p_partkey"), "p_partkey", "left_semi").agg(F.count("*").alias("rows"), F.lit(True).alias("of_table"))


@query("SELECT c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def deflate_ids(spark, d):
    t = _customer(spark, d)
    known = t.df.join(star.read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select(*t.df.columns)
    maps = known.withColumn("c_nationkey", F.create_map(F.col("c_nationkey").cast("string"), F.lit("shown")))
    return link.deflate(t, maps)


@query("SELECT true AS fits, false AS misfits")
def schema_matches(spark, d):
    t = _part(spark, d)
    return spark.createDataFrame([(link.fits(t, {"P_NAME": "x", "p_size": 1}), link.fits(t, {"p_name": "x", "other": 1}))], "fits boolean, misfits boolean")


@query("SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'ring') AS found FROM part")
def search_string(spark, d):
    t = _part(spark, d)
    return t.df.select("p_partkey", search.search_string(t, F.col("p_name"), "Red RING").alias("found"))


@query("SELECT c_nationkey::VARCHAR AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1")
def label_whitelist(spark, d):
    t = _customer(spark, d)
    menu = facet.facet_menu(t, facet_defs=[{"blk": 2, "filter_block": ["n_regionkey", "eq", "2"]}])
    return menu.items.select("value", "n")


# -- child rows


_CHILDREN = table_spec("boxes", [("p_partkey", "num"), "item_ids", ("items", "repeat")], repeat_ids=1, repeat_start=2)


def _boxes(spark, d) -> Table:
    item = lambda n, q: F.struct(n.cast("long").alias("id"), F.lit(q).alias("qty"))
    items = F.array(item(F.col("p_size"), 1), item(F.col("p_size") + 100, 2))
    return Table(_CHILDREN, star.read(spark, d, "part").select(F.col("p_partkey"), F.lit("").alias("item_ids"), items.alias("items")))


@query("""SELECT p_partkey, CASE WHEN p_partkey = 7 THEN '999,' || (p_size + 100) ELSE p_size || ',' || (p_size + 100) END AS item_ids, CASE WHEN p_partkey = 7 THEN '9,2' ELSE '1,2' END AS quantities FROM part""")
def child_rows(spark, d):
    t = _boxes(spark, d)
    for step in (
        lambda x: dml.insert_item(x, 7, {"id": 999, "qty": 5}, pos=0), lambda x: dml.update_item(x, 7, {"qty": 9}, child=999), lambda x: dml.delete_item(x, 7, pos=1),
        lambda x: dml.insert_item(x, 7, {"id": 999, "qty": 1}), lambda x: dml.delete_item(x, 7, child=12345),
    ):
        t = Table(_CHILDREN, step(t))
    return t.df.select("p_partkey", "item_ids", _text(F.col("items.qty")).alias("quantities"))


@query("SELECT p_partkey AS old, CASE WHEN p_partkey < 10 THEN p_partkey + 5 ELSE p_partkey + 1000 END AS new FROM part WHERE p_partkey < 100")
def alias_writes(spark, d):
    keys = _part(spark, d).df.filter("p_partkey < 100")
    first = keys.select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000).alias("new"))
    return dml.alias_rows(keys.filter("p_partkey < 10").select("p_partkey", F.col("p_partkey") + 5), dml.alias_rows(first, None))


@query("SELECT 'c_name' AS block, c_name AS value, c_custkey AS id FROM customer WHERE c_name <> '' UNION ALL SELECT 'c_mktsegment', c_mktsegment, c_custkey FROM customer WHERE c_mktsegment <> ''")
def value_dictionary(spark, d):
    return dml.dictionary(_customer(spark, d).df, ["c_name", "c_mktsegment"])


# -- catalogs, staging, exchange


def _catalog(spark) -> Catalog:
    return Catalog(spark, scratch(spark, "catalog"), "driver")


@query("SELECT 'zones' AS name, count(*) AS n FROM region UNION ALL SELECT 'emptied', 0")
def catalog_tables(spark, d):
    c, t = _catalog(spark), star.table(spark, d, star.REGION)
    c.create(t.spec, t.df)
    c.rename("region", "zones")
    for name in ("emptied", "dropped"):
        c.create(t.spec.with_(name=name), t.df)
    c.truncate("emptied")
    c.drop("dropped")
    return spark.createDataFrame([(n, read.table_count(c.table(n))) for n in c.tables()], "name string, n long")


@query("SELECT * FROM part")
def catalog_rollback(spark, d):
    """An undone transaction, an older version read back, and a vacuumed table: the rows as they were."""
    c, t = _catalog(spark), _part(spark, d)
    c.create(t.spec, t.df)
    try:
        with c.transaction("undone"):
            c.delete("part", t.df.select("p_partkey"))
            raise InterruptedError
    except InterruptedError:
        pass
    version = c.versions()[-1]
    c.vacuum("part")
    c.delete("part", t.df.filter("p_size < 10").select("p_partkey"))
    return c.table("part", version=version).df


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 2 = 0 THEN 'create,delete' WHEN p_partkey % 3 = 0 THEN 'create,update' ELSE 'create' END AS actions FROM part WHERE p_partkey < 300")
def catalog_history(spark, d):
    c, t = _catalog(spark), _part(spark, d)
    own = t.df.filter("p_partkey < 300")
    c.create(t.spec, own)
    c.update("part", own.filter("p_partkey % 3 = 0 AND p_partkey % 2 = 1").withColumn("p_brand", F.lit("changed")))
    c.delete("part", own.filter("p_partkey % 2 = 0").select("p_partkey"))
    return c.history("part").select("id", F.array_join("trail.action", ",").alias("actions"))


@query("SELECT * FROM nation")
def staging_roundtrip(spark, d):
    s = Staging(spark, scratch(spark, "staging"))
    s.write("nation", star.read(spark, d, "region"))
    s.write("nation", star.read(spark, d, "nation"))
    s.write("gone", star.read(spark, d, "region"))
    assert s.delete("gone") and s.read("gone") is None
    return s.read("nation")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def dump_restore(spark, d):
    c, t, folder = _catalog(spark), _customer(spark, d), scratch(spark, "dump")
    c.create(t.spec, t.df)
    exchange.dump(c, folder)
    fresh = _catalog(spark)
    exchange.restore(fresh, folder)
    return fresh.table("customer", links=False).df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("""SELECT p_partkey::VARCHAR AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '|' || p_type WHEN 2 THEN p_brand || ',' || p_type ELSE p_brand || ',' || p_size END AS a, CASE p_partkey % 4 WHEN 3 THEN 'z' ELSE p_type END AS b FROM part""")
def text_eras(spark, d):
    """Lines of each age of the text form, written and decoded."""
    k, tab = F.col("p_partkey") % 4, F.lit("\t")
    line = (
        F.when(k == 0, F.concat(F.col("p_name"), tab, F.col("p_type"))).when(k == 1, F.concat(F.col("p_brand"), F.lit("&#124;"), F.col("p_type"), tab, F.col("p_type")))
        .when(k == 2, F.concat(F.lit("ARRAY:"), F.col("p_brand"), F.lit("|"), F.col("p_type"), tab, F.col("p_type")))
    )
    old = F.concat(F.col("p_partkey").cast("string"), F.lit("<TAB0>"), F.col("p_brand"), F.lit("<TAB1>"), F.col("p_size").cast("string"), F.lit("<TAB0>z"))
    path = scratch(spark, "eras")
    star.read(spark, d, "part").select(F.coalesce(F.concat(F.col("p_partkey").cast("string"), tab, line), old)).write.text(path)
    return exchange.from_tsv(spark, path, table_spec("t", ["id", "a", "b"]))


# -- lists that writes keep up


_UPKEEP = "FROM part WHERE p_partkey % 7 <> 0 AND p_type = 'SMALL'"


@query(f"SELECT p_partkey {_UPKEEP} AND CASE WHEN p_partkey % 5 = 0 THEN 'changed' ELSE p_brand END IN ('changed', 'Brand#2')")
def index_upkeep(spark, d):
    """Rows changed twice and rows deleted, then a filter over the lists, which are not built again."""
    folder, t = scratch(spark, "lists"), _part(spark, d)
    index.build(t, folder)
    for value in ("between", "changed"):
        after, rows = dml.update(t, t.df.filter("p_partkey % 5 = 0").withColumn("p_brand", F.lit(value)))
        t = Table(t.spec, after, t.others)
        index.upkeep(t, folder, rows)
    after, gone = dml.delete(t, t.df.filter("p_partkey % 7 = 0").select("p_partkey"))
    t = index.upkeep(Table(t.spec, after, t.others), folder, ids=gone.select("p_partkey"))
    ids = index.matching_ids(t, {2: ["changed", "Brand#2"], 3: ["SMALL"]}, "and")
    return ids.select("p_partkey")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part) WHERE place BETWEEN 30 AND 49")
def presorted_slice(spark, d):
    t = _part(spark, d)
    places = index.presorted(t, 5, scratch(spark, "order"))
    return index.page_of(t, places, 30, 20, ascending=True).select("p_partkey")


@query("SELECT w AS word FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w LIKE 're%' GROUP BY w ORDER BY n DESC, w LIMIT 10)")
def suggest_words(spark, d):
    folder, t = scratch(spark, "suggestions"), _part(spark, d)
    index.build(t, folder)
    found = search.suggest_table(t, index.attached_suggestions(t, folder), "re")
    return spark.createDataFrame([(w,) for w in found], "word string")


# parts in order of their size, which has a list of values too
_MARKET = star.PART.with_(sort=(4, 5))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS place FROM part QUALIFY p_size BETWEEN 10 AND 20")
def range_slice(spark, d):
    t = star.table(spark, d, _MARKET)
    places = index.presorted(t, "p_size", scratch(spark, "order"))
    assert index.range_slice(t, "p_retailprice", places, 1, 2) is None
    return index.range_slice(t, "p_size", places, 10, 20).select("p_partkey", "place")


@query("SELECT p_partkey FROM (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' ORDER BY p_partkey DESC LIMIT 12 OFFSET 5)")
def index_list_slice(spark, d):
    t = index.build(_part(spark, d), scratch(spark, "lists"))
    return index.list_of(t, "p_brand", "Brand#2", offset=5, limit=12)


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY 1")
def index_list_lengths(spark, d):
    t = index.build(_part(spark, d), scratch(spark, "lists"))
    return index.lengths_of(t, "p_brand", ["Brand#1", "Brand#2", "none"])


# -- raw keys and lists, groups, migrations, journals


def _keyed(spark, d) -> Keyed:
    """Names by part, of which every third is put again and every fifth is gone; an undone write."""
    raw, rows = Keyed(_catalog(spark), "names"), star.read(spark, d, "part")
    raw.put(rows.select("p_partkey", "p_name"))
    raw.put(rows.filter("p_partkey % 3 = 0").select("p_partkey", "p_brand"))
    raw.delete(rows.filter("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string")))
    try:
        with raw.catalog.transaction("undone"):
            raw.delete([str(k) for k in range(100)])
            raise InterruptedError
    except InterruptedError:
        return raw


@query("SELECT p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS value FROM part WHERE p_partkey % 5 <> 0")
def raw_scan(spark, d):
    raw = _keyed(spark, d)
    assert raw.scan("count") == raw.scan("keys").count() == raw.scan("values").count()
    return raw.scan()


@query("SELECT p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS value FROM part WHERE p_partkey IN (3, 4, 5, 6) AND p_partkey % 5 <> 0")
def raw_get(spark, d):
    return _keyed(spark, d).get(["3", "4", "5", "6", "none"])


@query("SELECT k AS key, k IN (SELECT p_partkey::VARCHAR FROM part WHERE p_partkey % 5 <> 0) AS there FROM (VALUES ('3'), ('5'), ('none')) v(k)")
def raw_exist(spark, d):
    return _keyed(spark, d).exist(["3", "5", "none"])


@query("""SELECT key, id FROM (SELECT p_brand AS key, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_partkey % 4 <> 0) WHERE n BETWEEN 4 AND 13""")
def raw_lists(spark, d):
    lists, rows = Lists(_catalog(spark), "brands"), star.read(spark, d, "part")
    lists.put(rows.select("p_brand", "p_partkey"))
    lists.put(rows.filter("p_partkey < 50").select("p_brand", "p_partkey"))
    lists.delete(rows.filter("p_partkey % 4 = 0").select("p_brand", "p_partkey"))
    lists.drop("Brand#3")
    assert not lists.count("Brand#3").count()
    return lists.get("Brand#1", "Brand#2", "Brand#3", offset=3, limit=10, ascending=True)


@query("SELECT p_partkey, p_brand FROM part WHERE p_size < 5")
def group_options(spark, d):
    """Deleted rows are kept, as the table's group says."""
    c, groups = _catalog(spark), {"shop": {"keep_deleted": True, "section": "a", "name": "not taken over"}}
    spec = grouped_spec("shop_part", [("p_partkey", "auto_id"), "p_brand"], groups)
    assert spec.keep_deleted and spec.extra == {"section": "a"}
    assert not grouped_spec("shop_part", ["id"], groups, keep_deleted=False).keep_deleted
    rows = star.read(spark, d, "part")
    c.create(spec, rows.select("p_partkey", "p_brand"))
    c.delete("shop_part", rows.filter("p_size < 5").select("p_partkey"))
    return c.table("shop_part").deleted


@query("SELECT p_partkey AS part, upper(p_brand) AS label, p_name AS title, '' AS note FROM part WHERE p_partkey % 2 = 1")
def migrate_table(spark, d):
    c, t = _catalog(spark), _part(spark, d)
    c.create(t.spec, t.df)
    c.delete("part", t.df.filter("p_partkey % 2 = 0").select("p_partkey"))
    c.migrate("part", table_spec("part", [("part", "auto_id"), "label", "title", "note"]), {"part": "p_partkey", "title": "p_name"}, {"label": F.upper("p_brand")})
    return c.table("part").df


@query("""SELECT user_id, CASE WHEN n = 1 THEN 'add' ELSE 'edit' END AS action, last AS payload FROM (SELECT user_id, 2 AS n, 'second' AS last FROM events GROUP BY user_id HAVING max(event_id) % 2 = 0
UNION ALL SELECT user_id, 1, 'first' FROM events GROUP BY user_id HAVING max(event_id) % 2 = 1)""")
def journal_segments(spark, d):
    """Two segments, of which the older is deleted once its changes are carried on; then one change a key."""
    users = star.read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("top"))
    row = lambda df, action, payload: df.select("user_id", F.lit(action).alias("action"), F.lit(payload).alias("payload"))
    j = Journal(spark, scratch(spark, "journal"))
    j.append(row(users, "add", "dropped"))
    j.delete(j.rotate())
    j.append(row(users.filter("top % 2 = 1"), "add", "first"))
    j.append(row(users.filter("top % 2 = 0"), "edit", "first"))
    sealed = j.rotate()
    j.append(row(users.filter("top % 2 = 0"), "edit", "second"))
    assert j.segments() == [sealed] and j.rotate() > sealed and j.rotate() is None
    return feed.coalesced(j.scan(), ["user_id"], "seq", "action", "payload")
