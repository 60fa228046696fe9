"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole. Its tokens' spans are interval-joined with its sections' spans (both are ascending, so
the join is a merge by binary search), and a token that crosses a border is given by one of these rules:
    start: to the section that holds its first byte;  end: to the one that holds its last byte;
    majority: to the one that holds most of its bytes, the earlier of equals.
Sections partition the document: lines (a line feed belongs to the line before it), or fields, joined by a separator that
belongs to the field before it. Every token is given to exactly one section, so the counts sum up to the document's.
Texts go to Python as they are, and the lines' borders are found there in the bytes: nothing is made for each line.

Null texts and fields are empty; an empty document has one empty section and no token. Repeated rows and null ids are kept
as they are; an empty table gives an empty result; no other columns than those named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of

RULES = ("start", "end", "majority")
#: Bytes of text whose spans are held at once; a longer text is held alone.
PART = 2 << 20


def spans(enc, texts: list[str] | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """First byte and the byte behind the last of each text's tokens, in UTF-8."""
    if enc.by_unit:
        out = []
        for raw in enc.encode(texts):
            ends = np.cumsum(enc.n_bytes[np.frombuffer(raw, dtype="<u4")])
            out.append((np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends))
        return out
    texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
    out = []
    for text, e in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))).astype("i8")
        o = np.array(e.offsets, dtype="i8").reshape(-1, 2)
        out.append((at[o[:, 0]], at[o[:, 1]]))
    return out


def attribute(start: np.ndarray, end: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and the number of tokens that cross a border; borders are the bytes behind each section."""
    first = np.minimum(np.searchsorted(borders, start, side="right"), len(borders) - 1)
    last = np.minimum(np.searchsorted(borders, np.maximum(end - 1, start), side="right"), len(borders) - 1)
    own = (first if rule != "end" else last).copy()
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for i in crossing.tolist():
            parts = range(int(first[i]), int(last[i]) + 1)
            held = [min(end[i], borders[s]) - max(start[i], borders[s - 1] if s else 0) for s in parts]
            own[i] = parts[int(np.argmax(held))]
    return np.bincount(own, minlength=len(borders)), len(crossing)


def _places(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the buffer of all, and where the last ends."""
    return np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")


def line_borders(texts: pa.Array) -> list[np.ndarray]:
    """The bytes behind each line of each text."""
    at, data = _places(texts), np.frombuffer(texts.buffers()[2] or b"", "u1")
    feeds = np.flatnonzero(data[at[0] : at[-1]] == 10) + at[0] + 1
    cuts = np.searchsorted(feeds, at, side="right").tolist()
    return [np.append(feeds[cuts[i] : cuts[i + 1]], at[i + 1]) - at[i] for i in range(len(texts))]


def _parts(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
    """doc_id, text and borders of at most 512 rows and about PART bytes of text at once."""
    text, a = b.column(1).cast(pa.string()), 0
    at = _places(text) if len(text) else np.zeros(1, dtype="i8")
    while a < b.num_rows:
        z = min(a + 512, max(a + 1, int(np.searchsorted(at, at[a] + PART, side="right")) - 1))
        part = text.slice(a, z - a)
        borders = line_borders(part) if b.num_columns == 2 else [np.cumsum(x) for x in b.column(2).slice(a, z - a).to_pylist()]
        yield b.column(0).slice(a, z - a), part, borders
        a = z


def _attributed(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        enc = encoder(path)
        for doc_id, texts, borders in (p for b in batches for p in _parts(b)):
            counts, crossing = [], []
            for (s, e), ends in zip(spans(enc, texts), borders, strict=True):
                n, c = attribute(s, e, ends, rule)
                counts.append(n)
                crossing.append(c)
            flat = pa.array(np.concatenate(counts).astype("i8"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(n) for n in counts]))).astype("i4")), flat)
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array([int(n.sum()) for n in counts], pa.int64()), pa.array([len(n) for n in counts], pa.int64()), pa.array(crossing, pa.int64()), lists],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    return run


_OUT = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"


def _run(rows: DataFrame, tokenizer: str, rule: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(_attributed(tokenizer, rule), _OUT)


def by_line(docs: DataFrame, tokenizer: str, rule: str = "majority") -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens (of each line) for every row."""
    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), tokenizer, rule)


def by_field(docs: DataFrame, fields: list[str], tokenizer: str, separator: str = "\n", rule: str = "majority") -> DataFrame:
    """The same for documents made of fields in that order; section_tokens has the fields' counts."""
    last = len(fields) - 1
    pieces = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if i < last else "")) for i, f in enumerate(fields)] or [F.lit("")]
    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*pieces).alias("text"), F.array(*map(F.octet_length, pieces)).alias("sizes")), tokenizer, rule)
