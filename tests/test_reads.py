"""Reads, orders, ranges, counts, tiers and links on small tables with known answers."""

from __future__ import annotations

import pytest

from tarnfield.functions import cells
from tarnfield.operators import core, facet, link, read, search, sets
from tarnfield.operators.core import Table
from tarnfield.plans import index
from tarnfield.spec import order_of, table_spec
from pyspark.sql import functions as F


def ids(page_or_df, column="id"):
    df = page_or_df.df if hasattr(page_or_df, "matched") else page_or_df
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def products(spark):
    df = spark.createDataFrame([(i, f"Product #{i}", "even" if i % 2 == 0 else "odd") for i in range(1, 11)], "id long, title string, category string")
    return Table(table_spec("products", [("id", "auto_id"), "title", "category"], match=[2]), df)


def test_newest_first_and_pages(products):
    assert ids(read.read_all(products)) == list(range(10, 0, -1))
    for up in ({"dir": "asc"}, {"sort": "asc"}, {"sort": {"reverse": 1}}):
        assert ids(read.read_all(products, **up)) == list(range(1, 11))
    first = read.read_all(products, 0, 4)
    assert (first.total, ids(first)) == (10, [10, 9, 8, 7])
    assert ids(read.read_all(products, 4, 4)) == [6, 5, 4, 3]
    even = read.field_fetch(products, 2, "even", 0, 3)
    assert (even.total, ids(even)) == (5, [10, 8, 6])
    assert ids(read.field_fetch(products, "CATEGORY", "even", 0, 3, dir="asc")) == [2, 4, 6]
    assert ids(read.read_all(products, 8, 10)) == [2, 1] and ids(read.read_all(products, 20, 10)) == []


def test_points_and_lists(spark, products):
    gone = spark.createDataFrame([(50, "old", "odd")], products.df.schema)
    alias = spark.createDataFrame([(77, 3)], "old long, new long")
    t = Table(products.spec, products.df, aliases=alias, deleted=gone)
    assert ids(read.read_id(t, 7)) == [7] and ids(read.read_id(t, 77)) == [3] and ids(read.read_id(t, 50)) == [50]
    assert ids(read.read_id(t, 999)) == [] and ids(read.read_id(t, "junk")) == []
    assert ids(read.read_id(t, 77, links=False)) == [] and ids(read.read_id(t, 50, deleted=False)) == []
    assert ids(read.read_first(t)) == [1] and ids(read.read_last(t)) == [10] and len(ids(read.read_random(t))) == 1
    assert ids(read.read_list(t, [5, 2, 5, 999, 77])) == [5, 2, 5, 3]
    assert [r["canonical"] for r in read.read_links(t, spark.createDataFrame([(77,), (4,)], "id long")).orderBy("id").collect()] == [4, 3]
    assert read.table_lastid(t).first()[0] == 50 and read.table_count(t) == 10 and read.exist_id(t, 4) and not read.exist_id(t, 50)
    assert [(r["id"], r["hits"]) for r in read.read_count(Table(t.spec, t.df, counters=spark.createDataFrame([(4, 9)], "id long, hits long")), [4, 5]).collect()] == [(4, 9), (5, 0)]


def test_orders(spark):
    rows = [(101, "Laptop", 1500.0, "2026-01-01 10:00:00"), (102, "Mouse", 25.0, "2026-01-02 11:00:00"), (103, "Monitor", 300.0, "2026-01-03 12:00:00"), (104, "Keyboard", 75.0, "2026-01-04 13:00:00")]
    spec = table_spec("products", [("id", "num"), "name", ("price", "num"), ("created_at", "date")], sort=[1, 2, 3])
    t = Table(spec, spark.createDataFrame(rows, "id long, name string, price double, created_at string"))
    assert ids(read.read_all(t, sort=2)) == [101, 103, 104, 102]
    assert ids(read.read_all(t, sort={"blk": 2, "reverse": 1})) == ids(read.read_all(t, sort=-2)) == [102, 104, 103, 101]
    assert ids(read.read_all(t, sort="3 asc")) == [101, 102, 103, 104]
    assert ids(read.read_all(t, sort=-1)) == [104, 101, 103, 102]
    assert ids(read.read_first(t, sort=2)) == [102] and ids(read.read_last(t, sort=2)) == [101]
    text = t.with_df(t.df.withColumn("price", F.col("price").cast("string")))
    assert ids(read.read_all(text, sort=2)) == [101, 103, 104, 102]
    assert (order_of("price desc").block, order_of("-price").ascending, order_of({"reverse": 0}).ascending) == ("price", True, False)


def test_sort_keys(spark):
    key = lambda v, k: spark.range(1).select(cells.sort_key(F.lit(v), k)).first()[0]
    assert key("0", "num") == "1000000000000.000000" and key("-150.75", "num") == "0999999999849.250000"
    assert key("Buzdolabı NoFrost", "string") == "buzdolab" and key("Çamaşır Makinesi", "string") == "camasirm" and key("Kısa", "string") == "kisa    "


def test_cells_hold_several_values(spark):
    rows = [(1, "10, 20", 150.0, "12"), (2, "10", 120.0, "12"), (3, "20", 200.0, "14"), (4, "20", 180.0, "12"), (5, "10", 300.0, "16"), (6, "10", 400.0, "14"), (7, None, None, ""), (8, " 0 ;", 1.0, "0")]
    t = Table(table_spec("c", ["id", "category", ("price", "num"), "brand"], match=[1, 3]), spark.createDataFrame(rows, "id long, category string, price double, brand string"))
    assert sorted(ids(read.field_fetch(t, 1, "10"))) == [1, 2, 5, 6] and sorted(ids(read.field_fetch(t, 1, ["20"]))) == [1, 3, 4]
    assert ids(read.field_fetch(t, 1, "0")) == [8]
    assert sorted(ids(read.field_filter(t, {1: "10", "brand": ["12", "14"]}))) == [1, 2, 6]
    assert sorted(ids(read.field_filter(t, {1: "20", 3: "16"}, type="or"))) == [1, 3, 4, 5]
    assert sorted(ids(read.field_filter(t, {1: "20", 3: "16", 2: {"min": 200}}, type="or"))) == [3, 5]
    assert sorted(ids(read.field_filter(t, {1: "10"}, base_ids=[1, 6, 7]))) == [1, 6]
    assert {r["value"]: r["ids"] for r in read.field_keyvals(t, 1).collect()} == {"10": [1, 2, 5, 6], "20": [1, 3, 4], "0": [8]}
    arrays = t.with_df(t.df.withColumn("category", F.split("category", ", ")))
    assert sorted(ids(read.field_fetch(arrays, 1, "20"))) == [1, 3, 4]


def test_counts(spark):
    rows = [(1, 45, 100, 10), (2, 45, 120, 10), (3, 45, 140, 20), (4, 68, 200, 20), (5, 68, 250, 30), (6, 712, 300, 30), (7, 1254, 400, 10), (8, 1254, 420, 10), (9, 1254, 440, 20), (10, 1254, 460, 30)]
    t = Table(table_spec("p", [("id", "auto_id"), ("firm", "num"), ("price", "num"), ("category", "num")], match=[1, 3]), spark.createDataFrame(rows, "id long, firm long, price long, category long"))
    got = lambda **k: {r["value"]: r["n"] for r in read.field_count(t, 1, **k).collect()}
    assert got(keys=[45, 68, 712, 1254]) == {"45": 3, "68": 2, "712": 1, "1254": 4} == got()
    assert got(keys=[45, 9999]) == {"45": 3, "9999": 0} and got(keys=45) == {"45": 3} and got(keys="45, 68, 712") == {"45": 3, "68": 2, "712": 1}
    assert {r["value"]: r["n"] for r in read.field_count(t, 3).collect()} == {"10": 4, "20": 3, "30": 3}


def test_ranges(spark):
    rows = [(1, "The Matrix", 1999), (2, "Gladiator", 2000), (3, "Memento", 2000), (4, "Inception", 2010), (5, "Interstellar", 2014), (6, "Dune", 2021), (7, "Oppenheimer", 2023), (8, "None", None)]
    t = Table(table_spec("m", ["id", "title", ("year", "num")]), spark.createDataFrame(rows, "id long, title string, year long"))
    text = t.with_df(t.df.withColumn("year", F.concat(F.lit("from "), F.col("year").cast("string"), F.lit(" on"))))
    for low, high, want in ((2000, 2021, [2, 3, 4, 5, 6]), (2000, 2000, [2, 3]), (None, 2000, [1, 2, 3]), (2005, 2022, [4, 5, 6]), (2001, 2009, []), (2020, 2010, []), (2014, None, [5, 6, 7])):
        for x in (t, text):
            assert sorted(ids(read.read_all(x, filter={"year": {"min": low, "max": high}}))) == want
    below = t.with_df(t.df.withColumn("year", F.col("year") - 2005))
    assert sorted(ids(read.read_all(below, filter={2: {"max": 5}}))) == [4]
    assert sorted(ids(read.read_all(below, filter={2: {"min": "-inf", "max": 5}}))) == [1, 2, 3, 4]


@pytest.fixture(scope="module")
def books(spark):
    names = lambda n, rows: Table(table_spec(n, ["id", "name"]), spark.createDataFrame(rows, "id long, name string"))
    others = {
        "category": names("category", [(1, "Roman"), (2, "Tarih"), (3, "Bilim Kurgu")]),
        "producer": names("producer", [(10, "Can Yayınları"), (20, "İş Bankası Kültür Yayınları"), (30, "İthaki Yayınları")]),
        "contributor": names("contributor", [(100, "Mustafa Kemal Atatürk"), (200, "Franz Kafka"), (300, "Frank Herbert"), (400, "Dostoyevski")]),
    }
    rows = [
        (1, 1, 10, 200, "Dönüşüm", "Karton", 1, 85.0), (2, 1, 10, 200, "Dava", "Ciltli", 1, 150.0), (3, 1, 20, 400, "Suç ve Ceza", "Ciltli", 1, 195.0), (4, 1, 20, 400, "Karamazov Kardeşler", "Karton", 1, 220.0),
        (5, 2, 20, 100, "Nutuk", "Ciltli", 1, 250.0), (6, 2, 20, 100, "Geometri", "Karton", 1, 75.0), (7, 3, 30, 300, "Dune", "Ciltli", 1, 280.0), (8, 3, 30, 300, "Dune Mesihi", "Karton", 1, 160.0), (9, 3, 30, 300, "Dune Çocukları (Pasif)", "Karton", 0, 140.0),
    ]
    spec = table_spec(
        "books", [("id", "auto_id"), ("cat", "num", "category;1"), ("pub", "num", "producer;1"), ("auth", "num", "contributor;1"), "title", "format", ("status", "num"), ("price", "num")],
        search=[4], match=[1, 2, 3, 5, 6], facet=[1, 2, 3, 5], use_junk=True, junk_rules=["status ne 1"], facet_rules=["status eq 1"], locale="tr",
    )
    return Table(spec, spark.createDataFrame(rows, "id long, cat long, pub long, auth long, title string, format string, status long, price double"), others)


DEFS = [{"blk": 1, "label": "Kategori", "name_idx": 1}, {"blk": 2, "label": "Yayınevi", "name_idx": 1}, {"blk": 3, "label": "Yazar", "name_idx": 1}, {"blk": 5, "label": "Format"}]


def shown(menu):
    return {g["blk"]: {r["label"]: r["count"] for r in g["records"]} for g in menu.groups}


def test_facet_menus(books):
    m = facet.facet_menu(books, facet_defs=DEFS)
    assert m.count == 8 and len(m.groups) == 4 and shown(m)[1]["Roman"] == 4 and shown(m)[3]["Frank Herbert"] == 2
    assert m.groups[0]["name"] == "Kategori" and m.groups[0]["records"][0] == {"uid": "fc_1_1", "param": "f1", "val": "1", "label": "Roman", "count": 4, "checked": 0}
    m = facet.facet_menu(books, selected={1: 1}, facet_defs=DEFS)
    assert sorted(ids(m.page)) == [1, 2, 3, 4] and shown(m)[1]["Tarih"] == 2 and shown(m)[2] == {"Can Yayınları": 2, "İş Bankası Kültür Yayınları": 2}
    assert m.active_counts == {1: 1} and m.groups_by_blk[1]["active"] == 1
    m = facet.facet_menu(books, selected={"f1": "1", 2: 10, 5: "Ciltli"}, facet_defs=DEFS)
    assert ids(m.page) == [2] and shown(m)[3] == {"Franz Kafka": 1}
    dune = search.search_table(books, "Dune", tier="A", keys_only=True)
    assert dune.total == 2
    assert shown(facet.facet_menu(books, facet_defs=DEFS, base_ids=dune.df))[1] == {"Bilim Kurgu": 2}
    priced = facet.facet_menu(books, selected={7: {"min": 100, "max": 200}}, facet_defs=DEFS)
    assert shown(priced)[1] == {"Roman": 2, "Bilim Kurgu": 1}
    assert shown(facet.facet_menu(books, facet_defs=DEFS, base_ids=[]))== {}
    few = facet.facet_menu(books, facet_defs=[{"blk": 3, "limit": 1, "name_idx": 1, "required": 1}, {"blk": 5, "csv_list": "Karton"}, {"blk": 1, "sort": "value", "name_idx": 1, "filter_block": [1, "ne", "Tarih"]}])
    assert [len(g["records"]) for g in few.groups] == [1, 1, 2] and [r["val"] for r in few.groups[2]["records"]] == ["3", "1"]
    assert {r["value"]: r["n"] for r in facet.field_fltkeys(books, 2, {1: 1, 2: 30}).collect()} == {"10": 2, "20": 2}


def test_tiers_and_link_rules(spark):
    producer = Table(table_spec("producer", ["id", "name", ("statu", "num")]), spark.createDataFrame([(1, "Aktif", 1), (2, "Pasif", 0)], "id long, name string, statu long"))
    spec = table_spec("product", ["id", ("firm", "num", "producer;1"), ("status", "num")], use_junk=True, junk_rules=["status ne 1", "firm->statu ne 1"], match=[1])
    t = Table(spec, spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 2, 1), (4, None, None)], "id long, firm long, status long"), {"producer": producer})
    assert {r["id"]: r[core.TIER] for r in core.with_tier(t).collect()} == {1: "A", 2: "B", 3: "B", 4: "A"}
    two = t.with_df(t.df.filter("id <= 2"))
    assert [ids(read.read_all(two, tier=x)) for x in ("A", "B", "AB", "BA", "ALL", "none")] == [[1], [2], [1, 2], [2, 1], [2, 1], [2, 1]]
    assert ids(read.field_filter(two, {"firm": 1}, tier="AB")) == [2, 1]
    assert ids(read.field_fetch(two, "firm", 1, tier="BA")) == [2, 1]


def test_search(spark):
    rows = [(1, "Sony Kablosuz Kulaklık", "stereo"), (2, "Philips Bluetooth Kulaklık", None), (3, "JBL Bluetooth Hoparlör", "mono"), (4, "Sony Bluetooth Hoparlör", "stereo ses"), (5, "Apple Kablosuz Kulaklık", ""), (6, "Sennheiser Kulaklık Pro", "Stereo"), (7, "Türkiye'nin kârın IĞDIR", "x")]
    t = Table(table_spec("c", ["id", "title", "desc"], search=[1, 2], locale="tr"), spark.createDataFrame(rows, "id long, title string, desc string"))
    find = lambda q, *a, **k: sorted(ids(search.search_table(t, q, *a, **k)))
    assert find("kulaklık") == find("KULAKLIK") == [1, 2, 5, 6] and find("hoparlör") == [3, 4] and find("sony") == [1, 4] and find("sony stereo") == [1, 4]
    assert find("apple philips") == [] and find("apple philips", "or") == [2, 5] and find("") == find("!") == []
    assert [find(q) for q in ("Türkiye", "Türkiye'nin", "Türkiyenin", "nin", "ığdır", "igdir", "kârın", "karin")] == [[7], [7], [7], [], [7], [7], [7], [7]]
    assert sorted(ids(search.read_search(t, "sony stereo"))) == [] and sorted(ids(search.read_search(t, "sony stereo", cross_block=True))) == [1, 4]
    assert sorted(ids(search.read_search(t, "stereo", [2]))) == [1, 4, 6]
    bare = Table(t.spec.with_(search=()), t.df)
    assert sorted(ids(search.search_table(bare, "sony stereo"))) == [1, 4]
    assert [r[0] for r in t.df.orderBy("id").select(search.search_string(t, F.col("title"), "sony kablosuz")).collect()] == [True] + [False] * 6


def test_lists_give_what_scans_give(spark, books, tmp_path):
    built = index.build(books, str(tmp_path))
    again = index.attached(books, str(tmp_path))
    assert index.differences(built) == {"postings": 0, "tokens": 0}
    for t in (built, again):
        for cond, kind in (({1: [1, 2]}, "and"), ({1: 1, 5: "Ciltli"}, "and"), ({1: 3, 5: "Ciltli"}, "or"), ({1: 9}, "and"), ({1: 1, 7: {"min": 100}}, "and")):
            assert ids(read.field_filter(t, cond, type=kind)) == ids(read.field_filter(books, cond, type=kind))
        for q in ("dune", "suç ceza", "nothing", "dune mesihi"):
            for mode in ("and", "or"):
                assert ids(search.search_table(t, q, mode)) == ids(search.search_table(books, q, mode))
    places = index.presorted(books, "price", str(tmp_path / "places"))
    assert ids(index.page_of(books, places, 2, 3)) == ids(read.read_all(books, 2, 3, sort="price", tier="ALL"))
    assert ids(index.page_of(books, places, 2, 3, ascending=True)) == ids(read.read_all(books, 2, 3, sort=-7, tier="ALL"))


def test_suggestions(spark):
    rows = [(1, "Can", "Orhan Pamuk", "Masumiyet Müzesi"), (2, "Can", "Orhan Kemal", "Şeker Portakalı"), (3, "Maruf Eticaret", "Orhan Pamuk", "Kar"), (4, "10, 20", None, "")]
    t = Table(table_spec("p", ["id", "publisher", "author", "title"], suggest=[1, 2, 3], suggest_join=[[2, 3]], locale="tr"), spark.createDataFrame(rows, "id long, publisher string, author string, title string"))
    s = search.suggestions(t)
    say = lambda q: search.suggest_table(t, s, q)
    assert "orhan" in say("or") and "şeker" in say("sek") and "şeker" in say("şek") and say("o") == []
    assert "orhan pamuk" in say("orhan p") and "orhan pamuk masumiyet" in say("orhan pamuk m") and "maruf eticaret" in say("maruf e")
    assert say("orhan ")[0] == "orhan pamuk" and say("") == []


def test_links_and_slugs(spark):
    brand = Table(table_spec("brand", ["id", "name"]), spark.createDataFrame([(1, "Acme"), (2, "Best")], "id long, name string"))
    author = Table(table_spec("author", ["id", "name"]), spark.createDataFrame([(1, "Ahmet Altan"), (2, "Maruf Çetin")], "id long, name string"))
    spec = table_spec("product", ["id", "title", ("brand", "num", "brand;1"), ("authors", "text", "author;1")], slug=[1])
    t = Table(spec, spark.createDataFrame([(1, "Hello World", 1, "1,2"), (2, "Hello World", None, "2; 9"), (3, "Unique: Title", 2, "")], "id long, title string, brand long, authors string"), {"brand": brand, "author": author})
    got = {r["id"]: r for r in link.inflate(t).collect()}
    assert got[1]["authors"] == {"1": "Ahmet Altan", "2": "Maruf Çetin"} and got[1]["brand"] == {"1": "Acme"} and got[2]["authors"] == {"2": "Maruf Çetin"} and got[2]["brand"] == {} and got[3]["authors"] == {}
    assert '"name":"Acme"' in {r["id"]: r for r in link.inflate(t, ["brand"], full=True).collect()}[1]["brand"]["1"]
    assert {r["id"]: r["authors"] for r in link.deflate(t, link.inflate(t)).collect()} == {1: "1,2", 2: "2", 3: ""}
    assert {r["id"]: r["slug"] for r in link.slugs(t).collect()} == {1: "hello-world", 2: "hello-world-2", 3: "unique-title"}
    assert ids(link.by_slug(t, "hello-world-2")) == [2]
    assert link.fits(t, {"Title": 1, "id": 2}) and not link.fits(t, {"other": 1}) and not link.fits(t, {})


def test_sets(spark):
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    a = one(50, 10, 30, 30, 70)
    b = spark.createDataFrame([(50, 0), (99, 1), (10, 2), (30, 3)], "id long, pos int")
    assert ids(sets.crop(a, b.select("id"), 1)) == [10, 30, 50] and ids(sets.crop(a, b, 2)) == [50, 10, 30]
    assert sorted(ids(sets.union([a, one(1)]))) == [1, 10, 30, 50, 70] and sorted(ids(sets.punch(a, one(10)))) == [30, 50, 70]
    assert sorted(ids(sets.encoded(one(0, -1, 5, 5)))) == [5] and sets.count(a).first()[0] == 4 and ids(sets.found(a, 10)) == [10]
    assert ids(sets.sliced(one(1, 2, 3, 4), 1, 2)) == [3, 2]


def test_filters_reach_the_scan(spark, sf_dir):
    from tarnfield.plans import star

    page = read.field_filter(star.table(spark, sf_dir, star.PART), {4: {"min": 5, "max": 9}, "p_brand": "Brand#2"}, keys_only=True)
    plan = page.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(p_size" in plan and "p_name" not in plan.split("ReadSchema")[1]


def test_lists_are_made_over_all_cores(spark, books, tmp_path, monkeypatch):
    tasks = []
    for where, name in ((index, "postings"), (search, "tokens")):
        make = getattr(where, name)
        monkeypatch.setattr(where, name, lambda t, make=make: tasks.append(t.df.rdd.getNumPartitions()) or make(t))
    index.build(books.with_df(books.df.coalesce(1)), str(tmp_path))
    assert len(tasks) == 2 and min(tasks) >= spark.sparkContext.defaultParallelism


def test_a_repeated_sentence_is_cut_once(spark):
    t = Table(table_spec("p", ["id", "name"], suggest=[1]), spark.createDataFrame([(i, "red bolt" if i < 90 else "red ring") for i in range(100)], "id long, name string"))
    s = search.suggestions(t)
    assert {(r["word"], r["next"], r["n"]) for r in s.transitions.collect()} == {("red", "bolt", 90), ("red", "ring", 10)}
    assert {(r["word"], r["n"]) for r in s.prefixes.collect()} == {("red", 100), ("bolt", 90), ("ring", 10)}
    for df in (s.prefixes, s.transitions):
        assert "Aggregate [sentence" in df._jdf.queryExecution().optimizedPlan().toString()


def test_changed_rows_are_made_once_for_all_lists(spark, books, tmp_path):
    built, seen = index.build(books, str(tmp_path)), spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(n):
        seen.add(1)
        return n

    key = books.id
    rows = books.df.limit(3).localCheckpoint().withColumn(key, same.asNondeterministic()(F.col(key)))
    index.upkeep(books, str(tmp_path), rows)
    assert built.postings is not None and seen.value == 3
    assert index.differences(index.attached(books, str(tmp_path))) == {"postings": 0, "tokens": 0}


def test_cells_of_one_value_and_cells_to_trim(spark):
    cells_of = lambda kind, *vs: [r[0] for r in spark.createDataFrame([(v,) for v in vs], f"c {kind}").coalesce(1).select(cells.values("c", spark.createDataFrame([], f"c {kind}").schema["c"].dataType)).collect()]
    assert cells_of("string", "a b", " a", "a ", "a  b", "a\tb", "a\u00a0b", "a\n", "", " ", None, "a, b;;c") == [["a b"], ["a"], ["a"], ["a b"], ["a b"], ["a b"], ["a"], [], [], [], ["a", "b", "c"]]
    assert cells_of("double", 1.5, None) == [["1.5"], []] and cells_of("int", -7) == [["-7"]]
