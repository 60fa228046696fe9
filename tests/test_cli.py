"""The command line on a small catalog."""

from __future__ import annotations

import io
import json

from tarnfield.cli import run
from tarnfield.spec import table_spec


def test_actions(spark, tmp_path):
    spec = table_spec("part", [("id", "auto_id"), "name", ("size", "num")], match=[1], search=[1], facet=[1])
    (tmp_path / "spec.json").write_text(spec.to_json())
    spark.createDataFrame([(1, "red bolt", 5), (2, "blue ring", 7), (3, "red", 9)], "id long, name string, size long").write.parquet(str(tmp_path / "in"))

    def say(*args) -> list:
        out = io.StringIO()
        assert run(spark, [str(tmp_path / "db"), *map(str, args)], out) == 0
        return [json.loads(x) for x in out.getvalue().splitlines()]

    say("create", tmp_path / "spec.json", tmp_path / "in")
    assert say("tables") == [["part"]] and say("count", "part") == [3] and say("info", "part")[0]["rows"] == 3
    assert [r["id"] for r in say("read_all", "part", "--sort", "-2")] == [1, 2, 3]
    assert say("read_all", "part", "--limit", 2) == [{"total": 3}, {"id": 3, "name": "red", "size": 9}, {"id": 2, "name": "blue ring", "size": 7}]
    assert [r["id"] for r in say("search", "part", "red")] == [3, 1] and [r["id"] for r in say("fetch", "part", "name", "red")] == [3]
    assert [r["id"] for r in say("filter", "part", '{"size": {"min": 6}}')] == [3, 2] and [r["id"] for r in say("read_list", "part", "2,1")] == [2, 1]
    say("insert", "part", '[{"id": 4, "name": "green", "size": 1}]')
    say("update", "part", '[{"id": 1, "name": "black", "size": 2}]')
    say("delete", "part", "2")
    assert [(r["id"], r["name"]) for r in say("read_all", "part")] == [(4, "green"), (3, "red"), (1, "black")]
    assert {r["val"]: r["count"] for r in say("facets", "part")[0][0]["records"]} == {"black": 1, "green": 1, "red": 1}
    say("vacuum", "part")
    say("reindex", "part", tmp_path / "lists")
    assert say("check", "part", tmp_path / "lists") == [{"postings": 0, "tokens": 0}]
    say("export", "part", tmp_path / "tsv")
    assert say("dump", tmp_path / "out") == [{"part": 3}]
    say("rename", "part", "thing")
    assert sorted((r["value"], r["n"]) for r in say("count", "thing", "--block", "name", "--keys", "red,none")) == [("none", 0), ("red", 1)]
    assert [x["action"] for x in say("history", "part", "--id", 4)[0]["trail"]] == ["insert"]
    (tmp_path / "new.json").write_text(table_spec("thing", [("id", "auto_id"), "title", "note"]).to_json())
    say("migrate", "thing", tmp_path / "new.json", "--renamed", '{"title": "name"}')
    assert say("read", "thing", 3) == [{"id": 3, "title": "red", "note": ""}]
    say("truncate", "thing")
    assert say("count", "thing") == [0]
    say("drop", "thing")
    assert say("tables") == [[]] and say("restore", tmp_path / "out") == [["part"]] and say("read", "part", 4)[0]["name"] == "green"
