"""Token-ID output by bit-plane shuffling.

File format: a dataset folder with ``chunks/`` and ``index/``, both written by Spark's committed Parquet writer, so that
any file system that Spark reaches will do and a lost executor leaves no half-written shard. A row of ``chunks`` is a
shard's block of BLOCK token ids (the last may be shorter) in one binary value:

    "TFBP" | version u8 | mode u8 (0 byte planes, 1 bit planes) | planes u8 | 0 u8 | n_ids u32 | crc32 u32 | n_pieces u32
    | size of the packed piece table u32 | size of each packed plane u32 ... | piece table | planes

All integers are little-endian. Each plane holds one byte (or bit) of every id and is compressed by itself with zstandard;
planes above the largest id's highest bit are left out. The piece table lists the documents of the block: id, whether the
id is null, start of the document in its shard, offset in the document, start in the block, length, document's length.
``index`` has a row for each block: shard, chunk, first (the global position of its first id), n_ids, n_bytes. Shards are
ascending ranges of doc_id; ids within a shard are in ascending order of doc_id, then of text.

Nulls: a null text is an empty one (just the end id); a null doc_id sorts first and is kept. Repeated rows stay repeated.
An empty table gives an empty dataset. Only doc_id and text are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scratch

BLOCK = 65_536
#: Shards whose blocks are listed by one file of the index.
LISTED = 8
_HEAD = struct.Struct("<4sBBBBIIII")
PIECE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("doc_start", "<i8"), ("at", "<i8"), ("start", "<u4"), ("n", "<u4"), ("doc_n", "<i8")])
_CHUNK_SCHEMA = "shard int, chunk int, first long, n_ids int, n_bytes int, blob binary"
_ROW_SCHEMA = "doc_id long, shard int, doc_start long, at long, n long, doc_n long, crc long"
_DOC_COLUMNS = ["doc_id", "shard", "doc_start", "doc_n", "crc"]
_DOC_SCHEMA = "doc_id long, shard int, doc_start long, doc_n long, crc long"


def pack(ids: np.ndarray, pieces: np.ndarray, mode: str = "byte", level: int = 3) -> bytes:
    """One block: ids as unsigned 32-bit integers."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    ids = np.ascontiguousarray(ids, dtype="<u4")
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if mode == "byte":
        planes = [np.ascontiguousarray(ids.view("u1").reshape(-1, 4)[:, k]).tobytes() for k in range((bits + 7) // 8)]
    elif mode == "bit":
        planes = [np.packbits(((ids >> k) & 1).astype("u1"), bitorder="little").tobytes() for k in range(bits)]
    else:
        raise ValueError(f"mode is byte or bit, not {mode}")
    planes = [z.compress(p) for p in planes]
    table = z.compress(pieces.tobytes())
    head = _HEAD.pack(b"TFBP", 1, mode == "bit", len(planes), 0, len(ids), zlib.crc32(ids.tobytes()), len(pieces), len(table))
    return b"".join((head, struct.pack(f"<{len(planes)}I", *map(len, planes)), table, *planes))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the piece table of a block; raises if the block is damaged."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    magic, version, bit, n_planes, _, n, crc, _, n_table = _HEAD.unpack_from(blob)
    if magic != b"TFBP" or version != 1:
        raise ValueError("not a block of this format")
    sizes = struct.unpack_from(f"<{n_planes}I", blob, _HEAD.size)
    at = _HEAD.size + 4 * n_planes
    pieces = np.frombuffer(z.decompress(blob[at : at + n_table]) if n_table else b"", dtype=PIECE)
    at += n_table
    ids = np.zeros(n, dtype="<u4")
    for k, size in enumerate(sizes):
        raw = np.frombuffer(z.decompress(blob[at : at + size]), dtype="u1")
        at += size
        if bit:
            ids |= np.unpackbits(raw, count=n, bitorder="little").astype("<u4") << k
        else:
            ids.view("u1").reshape(-1, 4)[:, k] = raw
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("crc32 of a block differs")
    return ids, pieces


def _times_x(a: int, b: int) -> int:
    """Product of polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_join(a: int, b: int, n_b: int) -> int:
    """crc32 of two strings one behind the other, from their crc32 and the second's length in bytes."""
    shift, power = 0x80000000, 0x00800000  # x^0 and x^8
    while n_b:
        if n_b & 1:
            shift = _times_x(shift, power)
        power = _times_x(power, power)
        n_b >>= 1
    return _times_x(shift, a) ^ b


def _blocks(path: str, end_id: int, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        enc = encoder(path)
        shard, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
        buffer, pieces, chunk, first, done = bytearray(), [], 0, 0, 0

        def flush(n: int) -> tuple:
            nonlocal buffer, pieces, chunk, first
            now, later, at = [], [], 0
            for p in pieces:  # (doc_id, null, doc_start, at, start, n, doc_n); the last may reach into the next block
                room = n - p[4]
                now.append((*p[:5], min(p[5], room), p[6]))
                if p[5] > room:
                    later.append((*p[:3], p[3] + room, 0, p[5] - room, p[6]))
            blob = pack(np.frombuffer(bytes(buffer[: 4 * n]), dtype="<u4"), np.array(now, dtype=PIECE), mode)
            row = (shard, chunk, first, n, len(blob), blob)
            del buffer[: 4 * n]
            chunk, first, pieces = chunk + 1, first + n, later
            return row

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["shard", "chunk", "first", "n_ids", "n_bytes", "blob"])

        for b in batches:
            for a in range(0, b.num_rows, 2500):
                part = b.slice(a, 2500)
                ids = part.column(0).to_pylist()
                out = []
                for doc_id, raw in zip(ids, enc.encode(part.column(1)), strict=True):
                    n = len(raw) // 4 + 1
                    at = len(buffer) // 4
                    buffer += raw + end
                    pieces.append((doc_id or 0, doc_id is None, done, 0, at, n, n))
                    done += n
                    while len(buffer) >= 4 * BLOCK:
                        out.append(flush(BLOCK))
                        if len(out) >= 8:
                            yield batch(out)
                            out = []
                if out:
                    yield batch(out)
        if buffer:
            yield batch([flush(len(buffer) // 4)])

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, mode: str = "byte") -> str:
    """Encode doc_id, text of every row and write the dataset into the folder; the folder's name is returned."""
    spark = docs.sparkSession
    bounded_batches(spark, 2500)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (ordered.mapInArrow(_blocks(tokenizer, end_id, mode), _CHUNK_SCHEMA)
        .write.option("compression", "none").parquet(f"{folder}/chunks"))
    chunks = spark.read.schema(_CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    index = chunks.join(F.broadcast(_bases(chunks)), "shard").select("shard", "chunk", (F.col("first") + F.col("base")).alias("first"), "n_ids", "n_bytes")
    index.coalesce(max(1, n // LISTED)).write.parquet(f"{folder}/index")
    return folder


def _bases(chunks: DataFrame) -> DataFrame:
    """Global position of each shard's first id: a row for each shard, of which there are as many as shuffle partitions."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids, p = unpack(blob.as_py())
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(p["start"].tolist(), p["n"].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["doc_id"], mask=p["null"].astype(bool)), pa.array(np.full(len(p), shard, "i4")), *(pa.array(p[k].astype("i8")) for k in ("doc_start", "at", "n", "doc_n")), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "doc_start", "at", "n", "doc_n", "crc"],
            )


def _joined_crc(parts: list[dict]) -> int:
    out = 0
    for p in sorted(parts, key=lambda x: x["at"]):
        out = crc32_join(out, p["crc"], 4 * p["n"])
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of their pieces, which are all in one partition. Documents of one piece are passed on as they come; pieces
    of the others, one or two of each block, are held till the last is there."""
    held: dict[tuple, list] = {}  # by shard and start: the ids that are missing, the pieces
    for b in batches:
        one = pc.equal(b.column("n"), b.column("doc_n"))
        found = []
        for p in b.filter(pc.invert(one)).to_pylist():
            got = held.setdefault((p["shard"], p["doc_start"]), [p["doc_n"], []])
            got[0] -= p["n"]
            got[1].append(p)
            if not got[0]:
                del held[p["shard"], p["doc_start"]]
                found.append({c: p[c] for c in _DOC_COLUMNS} | {"crc": _joined_crc(got[1])})
        whole = b.filter(one).select(_DOC_COLUMNS)
        yield whole
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=whole.schema)
    if held:
        raise ValueError(f"blocks with pieces of {len(held)} documents are missing")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks; each block is decoded by itself, once."""
    chunks = spark.read.schema(_CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    pieces = chunks.select("shard", "blob").mapInArrow(_pieces, _ROW_SCHEMA).repartition("shard", "doc_start")
    return pieces.mapInArrow(_whole, _DOC_SCHEMA).join(F.broadcast(_bases(chunks)), "shard").select(
        "doc_id", (F.col("base") + F.col("doc_start")).alias("start"), F.col("doc_n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def read_range(spark: SparkSession, folder: str, start: int, n: int) -> np.ndarray:
    """n ids from a global position on: the index tells which blocks to read."""
    index = spark.read.parquet(f"{folder}/index").filter((F.col("first") < start + n) & (F.col("first") + F.col("n_ids") > start))
    chunks = spark.read.schema(_CHUNK_SCHEMA).parquet(f"{folder}/chunks").drop("first", "n_ids", "n_bytes")
    rows = index.join(chunks, ["shard", "chunk"]).select("first", "blob").orderBy("first").collect()
    ids = np.concatenate([unpack(bytes(r["blob"]))[0] for r in rows] or [np.zeros(0, "<u4")])
    return ids[start - rows[0]["first"] :][:n] if rows else ids


def documents_of(docs: DataFrame, tokenizer: str, end_id: int = 0, mode: str = "byte") -> DataFrame:
    folder = write(docs, tokenizer, scratch(docs.sparkSession, "token-planes"), end_id, mode)
    return read_documents(docs.sparkSession, folder)
