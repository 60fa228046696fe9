"""Raw keys, lists, journals and groups: odd inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnfield.sources.catalog import Catalog
from tarnfield.sources.raw import Keyed, Lists
from tarnfield.spec import grouped_spec
from tarnfield.streaming.journal import Journal


def test_keys_with_odd_rows(spark, tmp_path):
    raw = Keyed(Catalog(spark, str(tmp_path)), "raw")
    assert raw.scan("count") == 0 and raw.get(["a"]).collect() == []
    raw.put(spark.createDataFrame([("a", "1"), ("a", "2"), (None, "x"), ("", None)], "k string, v string"))
    assert sorted(map(tuple, raw.scan().collect())) == [("", None), ("a", "2")]
    assert raw.scan("keys", keep=F.col("key") == "a", limit=5).collect() == [("a",)]
    assert dict(raw.exist(["", "a", "a", "b"]).collect()) == {"": True, "a": True, "b": False}
    raw.delete(["a", "none"])
    assert Keyed(Catalog(spark, str(tmp_path)), "raw").scan("keys").collect() == [("",)]
    with pytest.raises(ValueError):
        raw.scan("other")


def test_lists_with_odd_rows(spark, tmp_path):
    lists = Lists(Catalog(spark, str(tmp_path)), "lists")
    rows = spark.createDataFrame([("a b", 1), ("a b", 1), ("a b", 3), ("b", 2), (None, 1), ("a", None)], "k string, i long")
    lists.put(rows)
    lists.put(rows)
    assert [r["id"] for r in lists.get("a b", limit=5).collect()] == [3, 1] and lists.get("a").collect() == []
    assert sorted(map(tuple, lists.count("a b", "b", "c").collect())) == [("a b", 2), ("b", 1)]
    assert sorted(map(tuple, lists.get("a b", "b", offset=1).collect())) == [("a b", 1)]
    lists.drop("b")
    assert sorted(map(tuple, lists.df.select("key", "id").collect())) == [("a b", 1), ("a b", 3)]


def test_journal_numbers_go_on(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    one = lambda x: spark.createDataFrame([(x,)], "x string")
    assert j.scan() is None and j.rotate() is None
    j.append(one("a"))
    j.append(one("b"))
    first = j.rotate()
    j.delete(first)
    j.append(one("c"))
    j.rotate()
    j.append(one("d"))
    rows = sorted(map(tuple, j.scan().collect()))
    assert [x for _, x in rows] == ["c", "d"] and rows[0][0] > 0 and rows[0][0] < rows[1][0]


def test_segments_keep_their_order_after_all_are_deleted(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    names = []
    for x in "abc":
        j.append(spark.createDataFrame([(x,)], "x string"))
        names.append(j.rotate())
        j.delete(names[-1])
    assert names == sorted(set(names))


def test_groups():
    groups = {"shop": {"keep_deleted": True, "lang": "de", "name": "no"}}
    assert grouped_spec("shop_a", ["id"], groups).extra == {"lang": "de"}
    assert grouped_spec("a", ["id"], groups, group="shop", extra={"lang": "fr"}).extra == {"lang": "fr"}
    assert not grouped_spec("plain", ["id"], groups).keep_deleted
