"""SimHash near-dedup with pivot distance tables.

Fingerprint: words are runs of other characters than [\\x20\\x09-\\x0D], A-Z lowered; a shingle is three words joined by
blanks (all of them when there are fewer), repeats included; a bit is 1 where over half the shingles' XXH64 (seed 42) have
it. A text without words has the fingerprint zero, which links like any other. Null texts are empty.

Links (Hamming distance of at most RADIUS): equal fingerprints are one node. For candidates the 64 bits are cut into five
blocks; fingerprints that differ in three bits agree on at least two blocks, so each goes under its ten pairs of blocks.
Under such a key rows are sorted by their distance to the first of the reference fingerprints (the pivot table's first
coordinate) and swept: a pair lives only while no coordinate differs by more than RADIUS; survivors are verified by XOR.
A key gives the edges of a spanning forest, never its pairs: at most one row for each row that came in. Keys with over
CELL rows are dealt into cells, and each pair of cells is a task's share, so no group is held whole and none is cut short.

Components: alternating large and small stars on written tables. Rows are nodes whether or not their doc_ids repeat; a
null doc_id gets a null component and names none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, small, stored, text_of

RADIUS = 3
CELL = 2048
_BLOCKS = [((1 << (13 if k < 4 else 12)) - 1) << (13 * k) for k in range(5)]
MASKS = [a | b for a, b in combinations(_BLOCKS, 2)]
#: Reference fingerprints: runs of bits, so that differences of coordinates tell apart what a far pivot cannot.
PIVOTS = np.array([0, 0xFFFFFFFF, 0xFFFF0000FFFF, 0xFF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555, 0xAAAA5555AAAA5555], dtype="u8")


def fingerprint(raw: bytes | None) -> int:
    """Of a text in UTF-8, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    w = (raw or b"").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [b" ".join(w)]  # noqa: B905
    return majority(np.fromiter((xxh64_intdigest(s, 42) for s in shingles), dtype="<u8", count=max(1, len(w) - 2)))


def majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype="i8")
    for a in range(0, len(h), 8192):
        ones += np.unpackbits(h[a : a + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(x) for x in b.column(1).to_pylist()], dtype="u8").view("i8")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (the 64 bits as a signed long) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), F.xxhash64(text_of()).alias("h"))
    return rows.mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each fingerprint, a column for each pivot."""
    return np.bitwise_count(fp.view("u8")[:, None] ^ PIVOTS[None, :]).astype("i1")


def sweep(group: np.ndarray, d0: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root's fingerprint) of a spanning forest of the links in each group; rows are sorted by group, then d0."""
    n = len(fp)
    table = distances(fp)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    live = np.arange(n - 1) if n > 1 else np.zeros(0, dtype="i8")
    step = 1
    while len(live):
        other = live + step
        near = (group[live] == group[other]) & (d0[other] - d0[live] <= RADIUS)
        live, other = live[near], other[near]
        if not len(live):
            break
        new = root[live] != root[other]
        a, b = live[new], other[new]
        for k in range(1, len(PIVOTS)):  # discard by the largest difference of coordinates
            ok = np.abs(table[a, k] - table[b, k]) <= RADIUS
            a, b = a[ok], b[ok]
        ok = np.bitwise_count((fp[a] ^ fp[b]).view("u8")) <= RADIUS
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        while not np.array_equal(root, root[root]):
            root[:] = root[root]
        step += 1
        live = live[live + step < n]
    ends = np.flatnonzero(root != np.arange(n))
    return fp[ends], fp[root[ends]]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, cells, d0; a key's rows of one pair of cells are at most a few CELL."""
    names, held = ["t", "part", "c0", "c1", "d0", "fp"], None
    out = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(cols: list[np.ndarray]) -> pa.RecordBatch:
        key = np.stack([c.astype("i8") for c in cols[:4]])
        group = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0)))) if key.shape[1] else np.zeros(0, "i8")
        return out(*sweep(group, cols[4].astype("i8"), cols[5]))

    for b in batches:
        cols = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
        n = len(cols[0])
        if not n:
            continue
        same = np.ones(n, dtype=bool)
        for c in cols[:4]:
            same &= c == c[-1]
        keep = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = [c[keep:] for c in cols]
        if keep:
            yield run([c[:keep] for c in cols])
    if held is not None:
        yield run(held)


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(nodes: DataFrame) -> DataFrame:
    """u, v: edges between distinct fingerprints (column fp) that have the components of all links."""
    d0 = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_long(int(PIVOTS[0])))))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("part")) for t, m in enumerate(MASKS)])
    rows = nodes.select("fp", d0.alias("d0"), F.explode(keys).alias("k")).select("k.t", "k.part", "d0", "fp")
    many = rows.groupBy("t", "part").agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
    rows = rows.join(small(stored(many, "large-keys")), ["t", "part"], "left").withColumn("cells", F.ceil(F.coalesce("n", F.lit(1)) / CELL).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("c0"), F.greatest(F.col("own"), o).alias("c1")))
    rows = rows.withColumn("own", own).select("t", "part", "d0", "fp", F.explode(pairs).alias("c")).select("t", "part", "c.c0", "c.c1", "d0", "fp")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "t", "part", "c0", "c1").sortWithinPartitions("t", "part", "c0", "c1", "d0")
    return dealt.mapInArrow(_edges, "u long, v long")


def _checked(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    df = stored(df, name)
    return df, tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of an edge and the smallest node that it reaches."""
    now, sign = _checked(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while sign[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        after = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now, new = _checked(after, "stars")
        if new == sign:
            break
        sign = new
    own = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp, component_id, root (the fingerprint that names the component) of every row."""
    fps = stored(fingerprints(docs), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    root = stored(components(links(nodes)), "components")
    low = root.join(nodes, root["node"] == nodes["fp"]).groupBy("root").agg(F.min("rep").alias("low"))
    held = root.join(low, "root").select("node", "root", "low")
    # rows that are alone in their component need no label
    labels = nodes.join(held, nodes["fp"] == held["node"], "left").filter("n > 1 or node is not null")
    labels = small(stored(labels.select(F.col("fp").alias("l_fp"), F.coalesce("low", "rep").alias("l_id"), F.coalesce("root", "fp").alias("l_root")), "labels"))
    out = fps.join(labels, F.col("fp") == F.col("l_fp"), "left")
    return out.select("doc_id", "h", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("l_id", "doc_id")).alias("component_id"), F.coalesce("l_root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp, component_id of every row."""
    return _labelled(docs).drop("root")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: the one with its smallest doc_id, and of several with
    that id the one with the least text hash; of rows that are the same in both, one. Rows with a null doc_id all stay."""
    rows = _labelled(docs).filter("doc_id is not null").groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    keep = rows.groupBy("root").agg(F.min(F.struct("doc_id", "h", "n")).alias("k"))
    keep = stored(keep.select(F.col("k.doc_id").alias("__tarnfield_id"), F.col("k.h").alias("__tarnfield_h"), F.col("k.n").alias("__tarnfield_n")), "representatives")
    key = (F.col("doc_id") == F.col("__tarnfield_id")) & (F.xxhash64(text_of()) == F.col("__tarnfield_h"))
    out = docs.filter("doc_id is not null").join(keep.filter("__tarnfield_n = 1"), key, "left_semi")
    if keep.filter("__tarnfield_n > 1").limit(1).count():
        again = docs.filter("doc_id is not null").join(small(keep.filter("__tarnfield_n > 1")), key, "left_semi").withColumn("__tarnfield_h", F.xxhash64(text_of()))
        out = out.unionByName(again.dropDuplicates(["doc_id", "__tarnfield_h"]).drop("__tarnfield_h"))
    return out.unionByName(docs.filter("doc_id is null"))
