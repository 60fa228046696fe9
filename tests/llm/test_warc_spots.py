"""WARC archives read back, and SpotSigs against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from tarnfield.llm import queries, spotsigs, warc
from tarnfield.llm.common import scratch, table

from . import cases

WARC = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def captures_by_hand(pages: list[tuple]) -> list[tuple]:
    """A capture for each row; of equal long payloads the first by page_id (null last) is the response."""
    seen: dict[bytes, int | None] = {}
    out = []
    for i, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (h or "").encode()
        again = len(raw) >= 100 and raw in seen
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", seen[raw] if again else None))
        seen.setdefault(raw, i)
    return sorted(out, key=repr)


PAGES = [(1, "http://a/", "x" * 100), (2, "http://b/\r\nX: y", "x" * 100), (3, None, "x" * 99), (4, "http://d/", "x" * 99), (5, "", None), (6, "http://f/", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (0, "u", "WARC/1.1\r\n\r\nmixed\n\r\n\r\nWARC/1.1\r\n" * 20), (None, "u", "x" * 100), (9, "u", "\n" * 200), (10, "u", "a\x00b" * 40), (1, "http://a/", "x" * 100)]


def test_odd_pages(spark):
    df = spark.createDataFrame([(*p, 1, "y") for p in PAGES], "page_id long, url string, html string, first int, value string")
    got = cases.bag(warc.captures(df), *WARC)
    assert got == captures_by_hand([(p[0], p[2]) for p in PAGES])


def test_no_row_is_lost(spark):
    """Repeated page_ids with other payloads, equal rows, null ids, and pages of every size class."""
    pages = [(1, "x" * 200), (1, "y" * 150), (2, "x" * 200), (2, "x" * 200), (None, "z"), (None, "z"), (None, "q" * 300), (None, "q" * 300), (4, "k" * 120), (4, "k" * 120), (4, "k" * 120), (5, "m" * 40_000), (6, "n" * 1_200_000), (7, "n" * 1_200_000), (8, "s"), (8, "s")]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").repartition(3)
    got = cases.bag(warc.captures(df), *WARC)
    assert len(got) == len(pages) and got == captures_by_hand(pages)


def test_no_pages(spark):
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_table(spark, sf_dir):
    rows = [(r["page_id"], r["html"]) for r in table(spark, sf_dir, "pages").collect()]
    assert cases.bag(queries.op2_warc_transactions(spark, sf_dir), *WARC) == captures_by_hand(rows)


def test_transactions_are_nested(spark):
    df = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    rows = warc.assemble(warc.read(spark, warc.write(df, scratch(spark, "warc-test")))).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata" and r["response"]["type"] in ("response", "revisit")
        assert r["response"]["id"] == r["capture"]
    bodies = {r["capture"].rsplit(":", 1)[0]: bytes(r["response"]["block"]) for r in rows if r["response"]["type"] == "response"}
    assert bodies["urn:tarnfield:response:1"].endswith(b"\r\n\r\n" + b"x" * 100)


def test_broken_archives_are_refused():
    import io

    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"nothing\r\n")))


# -- SpotSigs

SPOTS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def spots_by_hand(docs: list[tuple]) -> list[tuple]:
    from tarnfield.llm.spotsigs import signatures, written

    docs = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0), (x[1] or "").encode()))
    out = []
    for k, (d, t) in enumerate(docs):
        own, following = t or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(own)
        edited = own[: n - n // 2] + following[: n // 2]
        a, b, c = (set(signatures(x).tolist()) for x in (own, edited, following))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), written(signatures(own)), written(signatures(edited)), near(a, b), near(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [cases.documents, cases.clashing, cases.empty])
def test_neighbours_of_odd_documents(spark, make):
    df = make(spark)
    assert cases.bag(spotsigs.neighbours_compared(df), *SPOTS) == spots_by_hand([(r["doc_id"], r["text"]) for r in df.collect()])


def test_neighbours_of_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert cases.bag(queries.op4_spotsigs(spark, sf_dir), *SPOTS) == spots_by_hand(docs)


def test_a_single_document_is_its_own_neighbour(spark):
    df = spark.createDataFrame([(1, "the old house on the hill")], "doc_id long, text string")
    assert cases.bag(spotsigs.neighbours_compared(df), *SPOTS) == spots_by_hand([(1, "the old house on the hill")])


def test_similar_pairs_are_all_found(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for g in range(12):
        own = [x for _ in range(40) for x in ("the", rng.choice(words), rng.choice(words), rng.choice(words))]
        for _ in range(4):
            other = list(own)
            for _ in range(rng.randrange(6)):
                other[rng.randrange(len(other))] = rng.choice(words)
            docs.append((len(docs) + 100 * g, " ".join(other)))
    df = spark.createDataFrame([*docs, (5000, docs[0][1]), (5001, ""), (5002, None)], "doc_id long, text string")
    pairs, members = spotsigs.similar_pairs(spotsigs.fingerprints(df))
    sets = {d: set(spotsigs.signatures(t or "").tolist()) for d, t in [(r["doc_id"], r["text"]) for r in df.collect()]}
    low: dict[frozenset, int] = {}
    for d, s in sorted(sets.items()):
        low.setdefault(frozenset(s), d)
    assert {r["doc_id"]: r["class"] for r in members.collect()} == {d: low[frozenset(s)] for d, s in sets.items()}
    reps = sorted(low.values())
    want = {(a, b) for a in reps for b in reps if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
