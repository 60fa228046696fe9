"""Writes, versions, transactions, archives and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarnfield.operators import dml, read
from tarnfield.operators.core import Table
from tarnfield.sources import exchange
from tarnfield.sources.catalog import Catalog, Conflict
from tarnfield.spec import TableSpec, table_spec
from tarnfield.streaming import feed

SPEC = table_spec("products", [("id", "auto_id"), "title", ("price", "num")], keep_deleted=True, use_alias=True)
SCHEMA = "id long, title string, price double"


def rows(t):
    return sorted(tuple(r) for r in t.df.collect())


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "db"), "ann")


def made(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_writes_are_versions(spark, catalog):
    catalog.create(SPEC, made(spark, (1, "a", 1.0), (2, "b", 2.0)))
    catalog.insert("products", made(spark, (3, "c", 3.0), (2, "late", 9.0), (3, "c again", 4.0), (5, "e", None)))
    assert rows(catalog.table("products")) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (5, "e", None)]
    catalog.update("products", made(spark, (2, "B", 2.5), (99, "no", 0.0)))
    catalog.delete("products", [1])
    t = catalog.table("products")
    assert rows(t) == [(2, "B", 2.5), (3, "c", 3.0), (5, "e", None)] and [r["id"] for r in t.deleted.collect()] == [1]
    assert [r["id"] for r in read.read_id(t, 1).collect()] == [1] and read.table_lastid(t).first()[0] == 5
    assert rows(catalog.table("products", version=1)) == [(1, "a", 1.0), (2, "b", 2.0)]
    catalog.update("products", made(spark, (99, "new", 0.0)), force=True)
    catalog.change("products", dml.update_field(catalog.table("products"), 3, "title", "C"), [3])
    catalog.alias("products", spark.createDataFrame([(7, 3), (7, 2)], "old long, new long").limit(1))
    catalog.count_reads("products", spark.createDataFrame([(3,), (3,), (2,)], "id long"))
    before = rows(catalog.table("products"))
    catalog.vacuum("products")
    assert rows(catalog.table("products")) == before == [(2, "B", 2.5), (3, "C", 3.0), (5, "e", None), (99, "new", 0.0)]
    assert catalog.purge() and rows(catalog.table("products")) == before
    t = catalog.table("products")
    assert [r["id"] for r in read.read_list(t, [7]).collect()] == [3] and [r["hits"] for r in read.read_count(t, [3, 5]).collect()] == [2, 0]
    trail = {r["id"]: [x["action"] for x in r["trail"]] for r in catalog.history("products").collect()}
    assert trail["1"] == ["create", "delete"] and trail["3"] == ["insert", "update"] and catalog.audit().filter("user = 'ann'").count() == catalog.audit().count()


def test_transactions_are_all_or_nothing(spark, catalog):
    catalog.create(SPEC, made(spark, (1, "a", 1.0)))
    catalog.create(SPEC.with_(name="other"), made(spark))
    with pytest.raises(RuntimeError), catalog.transaction("fails"):
        catalog.insert("products", made(spark, (2, "b", 2.0)))
        assert len(rows(catalog.table("products"))) == 2
        raise RuntimeError
    assert rows(catalog.table("products")) == [(1, "a", 1.0)]
    with catalog.transaction("both"):
        catalog.insert("products", made(spark, (2, "b", 2.0)))
        catalog.insert("other", made(spark, (1, "x", 2.0)))
    assert len(rows(catalog.table("products"))) == 2 and len(rows(catalog.table("other"))) == 1
    second = Catalog(spark, catalog.store.root)
    with pytest.raises(Conflict), catalog.transaction("slow"):
        catalog.delete("products", [1])
        second.delete("products", [2])
    assert rows(catalog.table("products")) == [(1, "a", 1.0)]


def test_tables_come_and_go(spark, catalog):
    catalog.create(SPEC)
    assert catalog.tables() == ["products"] and catalog.exists("products") and rows(catalog.table("products")) == []
    with pytest.raises(dml.Rejected):
        catalog.create(SPEC)
    catalog.rename("products", "goods")
    catalog.attr("goods", min_char=3)
    assert catalog.table("goods").spec.min_char == 3
    catalog.truncate("goods")
    catalog.drop("goods")
    assert catalog.tables() == []
    with pytest.raises(KeyError):
        catalog.table("goods")


def test_archives(spark, catalog, tmp_path):
    catalog.create(SPEC, made(spark, (1, "a", 1.0), (2, None, None)))
    exchange.dump(catalog, str(tmp_path / "out"))
    fresh = Catalog(spark, str(tmp_path / "db2"))
    assert exchange.restore(fresh, str(tmp_path / "out")) == ["products"]
    assert fresh.table("products").df.exceptAll(catalog.table("products").df).count() == 0
    with pytest.raises(ValueError):
        exchange.restore(fresh, str(tmp_path / "out"))
    made(spark, (1, "tampered", 1.0), (2, None, None)).write.mode("overwrite").parquet(str(tmp_path / "out/tables/products"))
    with pytest.raises(exchange.Damaged):
        exchange.restore(fresh, str(tmp_path / "out"), force=True)


def test_old_text_formats(spark, tmp_path):
    spec = table_spec("t", ["id", "a", "b"])
    lines = ["1\tplain\tx", "2\ttab\\tin\tpipe&#124;and&#38;", "3<TAB0>one<TAB1>two<TAB0>z", "4\tARRAY:p|q\ty", "5\tonly"]
    (tmp_path / "old.tsv").write_text("\n".join(lines) + "\n")
    got = {r["id"]: (r["a"], r["b"]) for r in exchange.from_tsv(spark, str(tmp_path / "old.tsv"), spec).collect()}
    assert got == {"1": ("plain", "x"), "2": ("tab\tin", "pipe|and&"), "3": ("one,two", "z"), "4": ("p,q", "y"), "5": ("only", "")}


def test_child_rows(spark):
    spec = table_spec("order", [("id", "num"), "item_ids", ("items", "repeat")], repeat_ids=1, repeat_start=2)
    t = Table(spec, spark.createDataFrame([(1, "", [(201, 2), (202, 1)]), (2, "", None)], "id long, item_ids string, items array<struct<id long, qty int>>"))
    step = lambda df: Table(spec, df)
    ids = lambda x: x.df.filter("id = 1").first()["item_ids"]
    t = step(dml.insert_item(t, 1, {"id": 203, "qty": 5}))
    assert ids(t) == "201,202,203"
    t = step(dml.insert_item(t, 1, {"id": 200}, pos=-3))
    assert ids(t) == "200,201,202,203" and ids(step(dml.insert_item(t, 1, {"id": 200}))) == "200,201,202,203"
    t = step(dml.update_item(dml_table := t, 1, {"qty": 9}, child=203))
    assert dml_table and t.df.filter("id = 1").first()["items"][3]["qty"] == 9
    t = step(dml.delete_item(t, 1, child=202))
    assert ids(t) == "200,201,203"
    t = step(dml.delete_item(step(dml.delete_item(step(dml.delete_item(t, 1, pos=0)), 1, pos=0)), 1, pos=0))
    assert ids(t) == "" and step(dml.insert_item(t, 2, {"id": 7})).df.filter("id = 2").first()["item_ids"] == "7"
    with pytest.raises(dml.Rejected):
        dml.update_field(t, 1, 0, 5)


def test_rules_of_writes(spark):
    spec = table_spec("u", [{"id": "id"}, {"id": "code", "valid": "unique"}, {"id": "n", "type": "num"}])
    t = Table(spec, spark.createDataFrame([(1, "a", 1.0)], "id long, code string, n double"))
    with pytest.raises(dml.Rejected):
        dml.insert(t, spark.createDataFrame([(2, "a", "1")], "id long, code string, n string"))
    with pytest.raises(dml.Rejected):
        dml.insert(t, spark.createDataFrame([(2, "b", "1"), (3, "b", "1")], "id long, code string, n string"))
    out, new = dml.insert(t, spark.createDataFrame([("x2", "b", " 5 "), ("0", "c", "1"), (None, "d", "1")], "id string, code string, n string"))
    assert [tuple(r) for r in new.collect()] == [(2, "b", 5.0)] and out.count() == 2
    left, gone = dml.delete(t, spark.createDataFrame([(1,), (9,)], "id long"))
    assert left.count() == 0 and gone.count() == 1
    numbered = dml.numbered(spark.range(50).repartition(4).select(F.lit(None).cast("long").alias("id"), F.col("id").cast("string").alias("v")), "id", 100)
    assert sorted(r["id"] for r in numbered.collect()) == list(range(101, 151))
    multi = Table(table_spec("m", ["id", "v"]), spark.createDataFrame([(1, "a, b,c"), (2, None)], "id long, v string"))
    assert {r["id"]: r["v"] for r in dml.replace_values(multi, 1, {"a": "z"}).collect()} == {1: "z,b,c", 2: None}


def test_handles(spark, catalog):
    from tarnfield.sources.handles import Cached, Staging, Users

    s = Staging(spark, catalog.store.root)
    assert s.read("x") is None
    s.write("x", made(spark, (1, "a", 1.0)))
    s.write("x", made(spark, (2, "b", 1.0)))
    assert [r["id"] for r in s.read("x").collect()] == [2] and s.delete("x") and s.read("x") is None
    clock, made_of, calls = [0.0], [1], []
    c = Cached(lambda: calls.append(1) or spark.range(3), 10, lambda: made_of[0], lambda: clock[0])
    assert c.read().count() == 3 and c.read() is c.read() and len(calls) == 1
    clock[0] = 9.0
    c.read()
    clock[0] = 18.0
    assert c.held and c.read() and len(calls) == 1
    made_of[0] = 2
    assert c.read() and len(calls) == 2
    clock[0] = 99.0
    assert not c.held and c.read() and len(calls) == 3
    c.drop()
    u = Users(catalog.store)
    assert u.add("ann", "pw") and not u.add("ann", "x") and u.verify("ann", "pw") and not u.verify("ann", "no") and u.names() == ["ann"]
    token = u.connect("ann", "pw")
    assert u.user_of(token) == "ann" and u.connect("ann", "bad") is None and u.password("ann", "new") and u.verify("ann", "new") and not u.password("bob", "x")
    u.disconnect(token)
    assert u.user_of(token) is None and u.delete("ann") and not u.delete("ann")


def test_specs_are_kept_as_json():
    spec = table_spec("t", [("id", "auto_id"), {"id": "b", "rdbm": "other;2", "valid": "unique"}], match=[1], junk_rules=["b ne 1"], facet_rules=[("b", "eq", "2")], suggest_join=[[0, 1]])
    assert TableSpec.from_json(spec.to_json()) == spec
    with pytest.raises(KeyError):
        spec.resolve("none")


def folded(changes):
    state, payload = "none", None
    for a, p in changes:
        if state == "none":
            state, payload = a, (None if a == "del" else p)
        elif state == "add":
            if a == "edit":
                payload = p if p is not None else payload
            elif a == "del":
                state, payload = "none", None
        elif state == "edit":
            if a == "edit":
                payload = p if p is not None else payload
            elif a == "del":
                state, payload = "del", None
        elif a == "add":
            state, payload = "edit", p if p is not None else payload
    return state, payload


def test_changes_are_folded(spark, monkeypatch):
    rng = random.Random(4)
    by_key: dict[int, list] = {}
    data = []
    for seq in range(3000):
        k, a = rng.choice([0, 0, 0, 0, 1, 2, 3, *range(4, 300)]), rng.choice(["add", "edit", "del"])
        p = None if a == "del" or rng.random() < 0.1 else f"p{seq}"
        by_key.setdefault(k, []).append((a, p))
        data.append((k, seq, a, p))
    want = {(k, *folded(c)) for k, c in by_key.items() if folded(c)[0] != "none"}
    for run in (7, 4096):
        monkeypatch.setattr(feed, "RUN", run)
        got = feed.coalesced(spark.createDataFrame(data, "k int, seq long, action string, payload string"), ["k"], "seq", "action", "payload")
        assert {tuple(r) for r in got.collect()} == want


def test_streams(spark, catalog, tmp_path):
    catalog.create(SPEC, made(spark, (1, "a", 1.0), (2, "b", 2.0)))
    journal = [(1, 1, "edit", '{"id":1,"title":"A","price":5}'), (2, 2, "del", None), (3, 3, "add", '{"id":3,"title":"c","price":3}'), (4, 4, "add", '{"id":4}'), (5, 4, "del", None)]
    spark.createDataFrame(journal, "seq long, id long, action string, payload string").coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):  # a second start has nothing new
        stream = spark.readStream.schema("seq long, id long, action string, payload string").json(str(tmp_path / "in"))
        q = feed.write_behind(stream, catalog, "products", key="id", seq="seq", action="action", payload="payload", checkpoint=str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert rows(catalog.table("products")) == [(1, "A", 5.0), (3, "c", 3.0)]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 02:00:00", "y")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k")
    events.write.parquet(str(tmp_path / "ev"))
    live = feed.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "ts", "1 hour", ["k"], {"n": F.count("*")}, late="10 minutes")
    q = live.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in spark.table("win").collect()) == sorted((r["k"], r["n"]) for r in feed.windowed(events, "ts", "1 hour", ["k"], {"n": F.count("*")}).collect()) == [("x", 2), ("y", 1)]
    assert feed.changes(spark, catalog.store.at("audit")).isStreaming
