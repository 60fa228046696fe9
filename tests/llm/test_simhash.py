"""SimHash fingerprints and components against all pairs."""

from __future__ import annotations

import random

import pytest
from xxhash import xxh64_intdigest

from tarnfield.llm import queries, simhash
from tarnfield.llm.common import table

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_by_hand(text: str | None) -> int:
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not ws:
        return 0
    hs = [xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def by_hand(docs: list[tuple]) -> list[tuple]:
    fps = [print_by_hand(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return sorted(((d, f"{fps[i]:016x}", low[find(i)] if d is not None else None) for i, (d, _) in enumerate(docs)), key=repr)


def _result(df):
    from pyspark.sql import functions as F

    return cases.bag(simhash.near_duplicates(df).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id"), "doc_id", "f", "component_id")


@pytest.mark.parametrize("make", [cases.documents, cases.clashing, cases.empty])
def test_odd_documents(spark, make):
    df = make(spark)
    assert _result(df) == by_hand([(r["doc_id"], r["text"]) for r in df.collect()])


def test_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert cases.bag(queries.op9_simhash_pivot(spark, sf_dir), "doc_id", "fingerprint", "component_id") == by_hand(docs)


def test_large_groups_in_cells(spark, monkeypatch):
    """Fingerprints one or two bits apart in long chains, with keys that hold far more rows than a cell."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(1)
    fps, x = set(), rng.getrandbits(64)
    for _ in range(300):
        fps.add(x)
        x ^= 1 << rng.randrange(64)
        if rng.random() < 0.5:
            x ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = lambda f: f - (1 << 64) if f >= 1 << 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    fs = sorted(fps)
    root = {f: f for f in fs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    groups: dict[int, list[int]] = {}
    for f in fs:
        groups.setdefault(find(f), []).append(signed(f))
    want = {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    assert got == want


def test_representatives_keep_rows_whole(spark):
    df = cases.clashing(spark)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    want = {c for d, _, c in by_hand([(r["doc_id"], r["text"]) for r in df.collect()]) if d is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2
