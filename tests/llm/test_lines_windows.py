"""Line dedup and decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarnfield.llm import linededup, queries, winnow
from tarnfield.llm.common import table

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def lines_by_hand(docs: list[tuple], min_docs: int) -> list[tuple]:
    keys = [[x.strip(BLANK).translate(LOWER) for x in (t or "").split("\n")] for _, t in docs]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t), ks in zip(docs, keys, strict=True):
        ls = (t or "").split("\n")
        kept = [x for x, k in zip(ls, ks, strict=True) if not k or seen[k] < min_docs]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def windows_by_hand(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    where: dict[tuple, set] = {}
    for i, t in items:
        ws = split(t)
        n = min(8, len(ws))
        if n:
            for a in range(len(ws) - n + 1):
                where.setdefault(tuple(ws[a : a + n]), set()).add(None if i is None else str(i))
    sizes = sorted({len(w) for w in where})
    out = []
    for i, t in docs:
        ws, hit, found = split(t), set(), set()
        for n in sizes:
            for a in range(len(ws) - n + 1):
                if got := where.get(tuple(ws[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= got
        out.append((i, len(ws), len(hit), len(found), sha(",".join(sorted(found - {None}))), len(found) >= 2))
    return sorted(out, key=repr)


LINES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
WINDOWS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("make", [cases.documents, cases.clashing, cases.empty])
def test_lines_of_odd_documents(spark, make):
    df = make(spark)
    out = linededup.dedup_lines(df, 1, 10)
    from pyspark.sql import functions as F

    got = cases.bag(out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")), *LINES)
    assert got == lines_by_hand(_pairs(df), 10)


def test_lines_of_the_table(spark, sf_dir):
    assert cases.bag(queries.op6_line_dedup(spark, sf_dir), *LINES) == lines_by_hand(_pairs(table(spark, sf_dir, "documents")), 10)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "one two"), (3, ""), (4, None), (None, "a"), (5, "over the lazy dog while the small cat looks"), (6, "Word1 of THE 1"), (2, "x"), (7, "中文")]


@pytest.mark.parametrize("make", [cases.documents, cases.clashing, cases.empty])
def test_windows_of_odd_documents(spark, make):
    df = make(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert cases.bag(winnow.contaminated(df, items), *WINDOWS) == windows_by_hand(_pairs(df), ITEMS)


def test_no_benchmark_hits_nothing(spark):
    df = cases.documents(spark)
    out = winnow.contaminated(df, spark.createDataFrame([], "item_id long, text string"))
    assert cases.bag(out, *WINDOWS) == windows_by_hand(_pairs(df), [])


def test_windows_of_the_table(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    assert cases.bag(queries.op7_winnowing(spark, sf_dir), *WINDOWS) == windows_by_hand(_pairs(table(spark, sf_dir, "documents")), items)


def test_equal_hashes_are_no_hits(spark, monkeypatch):
    """All words of a text have one hash: hits are told by words."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(winnow, "word_hashes", lambda ws: F.transform(ws, lambda w: F.lit(7).cast("long")))
    df = cases.documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert cases.bag(winnow.contaminated(df, items), *WINDOWS) == windows_by_hand(_pairs(df), ITEMS)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("a b c"), min_size=0, max_size=30).map(" ".join), min_size=1, max_size=12), st.lists(st.lists(st.sampled_from("a b c"), min_size=0, max_size=12).map(" ".join), max_size=4))
def test_windows_of_few_words(spark, texts, items):
    docs, bench = list(enumerate(texts)), list(enumerate(items))
    out = winnow.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert cases.bag(out, *WINDOWS) == windows_by_hand(docs, bench)
