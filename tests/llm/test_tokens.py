"""Token files and attribution against the tokenizer itself."""

from __future__ import annotations

import os
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarnfield.llm import attribution, bpe, common, queries, tokenbin
from tarnfield.llm.common import scratch, table

from . import cases

COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


def by_hand(docs: list[tuple], tokenizer) -> list[tuple]:
    docs = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    out, at = [], 0
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [cases.documents, cases.clashing, cases.empty])
@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_odd_documents(spark, tokenizer, make, mode):
    df = make(spark)
    got = cases.bag(tokenbin.documents_of(df, queries.tokenizer(), mode=mode), *COLUMNS)
    assert got == by_hand([(r["doc_id"], r["text"]) for r in df.collect()], tokenizer)


def test_the_table(spark, sf_dir, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert cases.bag(queries.op3_token_bitplanes(spark, sf_dir), *COLUMNS) == by_hand(docs, tokenizer)


def test_a_range_is_read_by_the_index(spark, sf_dir, tokenizer):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect())
    ids = np.concatenate([np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for _, t in docs])
    folder = tokenbin.write(table(spark, sf_dir, "documents"), queries.tokenizer(), scratch(spark, "ranges"))
    for a, n in ((0, 10), (65_530, 20), (len(ids) - 5, 100), (1000, 70_000), (len(ids), 3)):
        assert np.array_equal(tokenbin.read_range(spark, folder, a, n), ids[a : a + n])


def _files(folder: str) -> list[str]:
    return [os.path.join(d, x) for d, _, names in os.walk(folder.removeprefix("file:")) for x in names if x.startswith("part-")]


def test_besides_the_blocks_few_files_are_written(spark, monkeypatch):
    n, old = 32, spark.conf.get("spark.sql.shuffle.partitions")
    folder = scratch(spark, "few-files")
    monkeypatch.setattr(tokenbin, "scratch", lambda _, name: f"{folder}/{name}")
    monkeypatch.setattr(common, "scratch", lambda _, name: f"{folder}/{name}")
    df = spark.range(2000).selectExpr("id AS doc_id", "repeat(concat('words of text ', id, ' '), 100) AS text")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        tokenbin.documents_of(df, queries.tokenizer()).write.parquet(f"{folder}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    files = _files(folder)
    blocks = [f for f in files if "/chunks/" in f]
    assert len(blocks) == n and len(files) <= n + n // 4, sorted(files)


def test_texts_of_many_blocks_need_all_of_them(spark, tokenizer):
    docs = [(d, f"some words {d} " * k) for d, k in enumerate((30_000, 1, 0, 90_000, 20, 25_000))]
    folder = tokenbin.write(spark.createDataFrame(docs, "doc_id long, text string"), queries.tokenizer(), scratch(spark, "long-texts"))
    assert cases.bag(tokenbin.read_documents(spark, folder), *COLUMNS) == by_hand(docs, tokenizer)
    spark.read.parquet(f"{folder}/chunks").filter("chunk != 1").write.parquet(f"{folder}/damaged/chunks")
    with pytest.raises(Exception, match="are missing"):
        tokenbin.read_documents(spark, f"{folder}/damaged").collect()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_blocks_round_trip(mode):
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, "u4"), np.array([0], "u4"), rng.integers(0, 50_257, 65_536, dtype="u4"), np.array([2**32 - 1, 0, 7], "u4")):
        pieces = np.array([(5, 0, 0, 0, 0, len(ids), len(ids))], dtype=tokenbin.PIECE)
        back, table_ = tokenbin.unpack(tokenbin.pack(ids, pieces, mode))
        assert np.array_equal(back, ids) and np.array_equal(table_, pieces)
    blob = bytearray(tokenbin.pack(np.arange(100, dtype="u4"), pieces, mode))
    blob[0] = 0
    with pytest.raises(ValueError):
        tokenbin.unpack(bytes(blob))


def test_checksums_are_joined():
    a, b = b"some bytes", b"and others that follow"
    assert tokenbin.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert tokenbin.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_units_give_the_tokenizers_ids(tokenizer):
    texts = [t or "" for _, t, *_ in cases.rows()] + ["a b  c", " lead", "trail ", "x\n y", "it's we'll 'tis", "1234 5,6.7", "a　b", "don't,stop.", ",.", "tab\there", "word, word. (word) \"word\"", "<|endoftext|> x"]
    enc = bpe.UnitEncoder(queries.tokenizer(), max_bytes=10_000)
    for raw, t in zip(enc.encode(texts), texts, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def attributed_by_hand(text: str | None, tokenizer, rule: str) -> tuple:
    parts = (text or "").split("\n")
    parts = [p + "\n" for p in parts[:-1]] + parts[-1:]
    borders = np.cumsum([len(p.encode()) for p in parts])
    enc = tokenizer.encode("".join(parts), add_special_tokens=False)
    ends = np.cumsum([len(t) for t in enc.tokens]).tolist()
    counts, crossing, a = [0] * len(parts), 0, 0
    for b in ends:
        held = [max(0, min(b, int(e)) - max(a, int(e) - len(p.encode()))) for e, p in zip(borders, parts, strict=True)]
        own = [i for i, h in enumerate(held) if h]
        crossing += len(own) > 1
        pick = own[0] if rule == "start" else own[-1] if rule == "end" else max(own, key=lambda i: (held[i], -i))
        counts[pick] += 1
        a = b
    return len(enc.ids), len(parts), crossing, counts


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, tokenizer, rule):
    df = cases.clashing(spark)
    got = sorted((tuple(r) for r in attribution.by_line(df, queries.tokenizer(), rule).collect()), key=repr)
    want = sorted(((r["doc_id"], *attributed_by_hand(r["text"], tokenizer, rule)) for r in df.collect()), key=repr)
    assert got == want
    assert all(sum(r[4]) == r[1] for r in got)


def test_attribution_of_the_table_and_of_fields(spark, sf_dir, tokenizer):
    got = sorted(tuple(r) for r in queries.op5_offset_attribution(spark, sf_dir).collect())
    want = sorted((r["doc_id"], *attributed_by_hand(r["text"], tokenizer, "majority")) for r in table(spark, sf_dir, "documents").collect())
    assert got == want
    assert attribution.by_line(cases.empty(spark), queries.tokenizer()).count() == 0
    df = spark.createDataFrame([(1, "ab", None), (2, None, "c d e")], "doc_id long, title string, body string")
    rows = {r["doc_id"]: r for r in attribution.by_field(df, ["title", "body"], queries.tokenizer()).collect()}
    assert rows[1]["n_sections"] == 2 and sum(rows[2]["section_tokens"]) == rows[2]["n_tokens"]
    with pytest.raises(ValueError):
        attribution.by_line(df.withColumnRenamed("title", "text"), queries.tokenizer(), "other")


def test_attribution_of_very_many_lines_takes_time_in_proportion(spark):
    n = 40_000
    df = spark.createDataFrame([(1, "a b\n" * n)], "doc_id long, text string")
    began = time.monotonic()
    (row,) = attribution.by_line(df, queries.tokenizer()).collect()
    assert time.monotonic() - began < 30
    assert row["n_sections"] == n + 1 and row["section_tokens"] == [3] * n + [0] and row["n_crossing"] == 0


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_texts_are_attributed_in_parts_of_bounded_bytes(monkeypatch, most):
    monkeypatch.setattr(attribution, "PART", most)
    texts = ["", "a", "\n", "é\n\n字 x\n", "", "b\n" * 30, "c", ""] * 70
    b = pa.RecordBatch.from_arrays([pa.array(range(1, len(texts))), pa.array(["gone\n", *texts]).slice(2)], ["doc_id", "text"])
    parts = list(attribution._parts(b))
    assert [x for ids, _, _ in parts for x in ids.to_pylist()] == list(range(1, len(texts)))
    assert [x for _, t, _ in parts for x in t.to_pylist()] == texts[1:]
    assert all(len(t) == 1 or len(t) <= 512 and sum(len(x.encode()) for x in t.to_pylist()) <= most for _, t, _ in parts)
    lines = [[p + "\n" for p in x.split("\n")[:-1]] + x.split("\n")[-1:] for x in texts[1:]]
    assert [e.tolist() for _, _, borders in parts for e in borders] == [np.cumsum([len(p.encode()) for p in x]).tolist() for x in lines]
