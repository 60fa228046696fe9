"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor with the next CHAIN content words (words that are no anchors), hashed to 32 bits; a text's
fingerprint is its set of signatures, written as their ascending values in hexadecimal, eight digits each. A text whose
anchors give no chain has the signatures of its runs of CHAIN + 1 words, a shorter one that of all its words, one without
words that of its characters; the empty text (null too) has the empty fingerprint. Likeness is the Jaccard similarity of
two sets, 1 for two empty ones.

similar_pairs partitions fingerprints by the size of the set, so that sets whose sizes alone rule a pair out are never
met, and takes as candidates those that share one of their rarest signatures; candidates are compared by Jaccard. Equal
fingerprints are one class there: pairs are between classes, and membership gives each row's.

neighbours_compared walks documents by descending doc_id, ties by text, nulls last; null texts are empty; repeated rows are
neighbours of each other. A single row is its own neighbour; an empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of

CHAIN = 2
ANCHORS = frozenset(
    (
        "the a an is was are were be been to of and in that it for on with as by at from this or not have has had he she they which "
        "der die das und den dem des von zu mit sich auf für ist im nicht ein eine einen einer als auch es an werden aus er hat dass sie nach wird bei um "
        "le la les de du et à en un une que qui dans pour pas sur par est avec il au aux ce se son sont ne plus "
        "el los las y por con para no del al lo su una como más o pero sus"
    ).split()
)
_WORD = re.compile(r"\w+")


def signatures(text: str) -> np.ndarray:
    """The set of a text's signatures, ascending unsigned 32-bit integers."""
    from xxhash import xxh32_intdigest

    content: list[str] = []
    spots: list[tuple[str, int]] = []
    words = _WORD.findall(text.lower())
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    n = len(content) - CHAIN
    found = {f"{a} {' '.join(content[i : i + CHAIN])}" for a, i in spots if i <= n}
    if not found:
        found = {" ".join(words[i : i + CHAIN + 1]) for i in range(max(1, len(words) - CHAIN))} if words else {text} if text else set()
    return np.unique(np.fromiter(map(xxh32_intdigest, found), dtype="u4", count=len(found)))


def written(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype("u4")


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity; 0 without a comparison where the sizes keep it under at_least."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < at_least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pid, halo, doc_id, text) sorted; each row but halo ones is answered once its successor is known."""
    held, rows = None, []

    def flush() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [x.split()[0] for x in _OUT.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows.clear()
        return out

    size = 0
    for b in batches:
        for pid, halo, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if held is not None and held[0] == pid and held[1]:
                continue  # behind the first halo row of a part nothing is asked for
            now = (pid, halo, doc_id, text, signatures(text))
            if held is not None and held[0] == pid:
                own, n = held[3], len(held[3])
                edited = own[: n - n // 2] + text[: n // 2]
                e = signatures(edited)
                rows.append((held[2], n, hashlib.sha256(edited.encode()).hexdigest(), written(held[4]), written(e), likeness(held[4], e), likeness(held[4], now[4])))
                size += 3 * n
                if len(rows) >= 1000 or size > 1 << 24:
                    size = 0
                    yield flush()
            held = now
    if rows:
        yield flush()


def neighbours_compared(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text, and of its edited text, whose last half is replaced by the next document's start."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    cuts = src.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    bounds = F.lit(cuts or [0])
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(a, _i):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        above = F.get(bounds, mid) > F.col("doc_id")
        go = a["lo"] < a["hi"]
        return pair(F.when(go & above, mid + 1).otherwise(a["lo"]), F.when(go & ~above, mid).otherwise(a["hi"]))

    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(cuts) + 1)) + 1)))
    number = F.aggregate(steps, pair(F.lit(0), F.lit(len(cuts))), halve, lambda a: a["lo"])
    pid = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(number if cuts else F.lit(0))
    src = src.withColumn("pid", pid)
    # the first row of a part is wanted by the part before it too: a row for each part, as many as shuffle partitions
    tops = {r["pid"]: r["top"] for r in src.groupBy("pid").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    if not order:
        return spark.createDataFrame([], _OUT)
    target = {p: order[k - 1] for k, p in enumerate(order)}  # the first part's goes to the last
    size = order[-1] + 1
    top = F.get(F.lit([tops.get(p) if tops.get(p) is not None else -(1 << 63) for p in range(size)]), F.col("pid"))
    goal = F.get(F.lit([target.get(p, 0) for p in range(size)]), F.col("pid"))
    put = lambda p, h: F.struct(p.cast("int").alias("pid"), F.lit(h).alias("halo"))
    own = put(F.col("pid"), False)
    first = F.coalesce("doc_id", F.lit(-(1 << 63))) == top
    rows = src.select("doc_id", "text", F.explode(F.when(first, F.array(own, put(goal, True))).otherwise(F.array(own))).alias("x"))
    rows = rows.select("x.pid", "x.halo", "doc_id", "text").repartition(parts, "pid")
    return rows.sortWithinPartitions("pid", "halo", F.col("doc_id").desc_nulls_last(), "text").mapInArrow(_walk, _OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([written(signatures(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def similar_pairs(fps: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(a, b, likeness) between classes of equal fingerprints, a < b; and membership (doc_id, class). A class is its least doc_id."""
    classes = fps.groupBy("fingerprint").agg(F.min("doc_id").alias("class"))
    members = fps.join(classes, "fingerprint").select("doc_id", "class")
    sigs = F.regexp_extract_all("fingerprint", F.lit("([0-9a-f]{8})"), F.lit(1))
    sets = classes.filter("fingerprint <> ''").select("class", sigs.alias("sigs")).withColumn("n", F.size("sigs"))
    each = sets.select("class", "n", F.explode("sigs").alias("sig"))
    df = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(df, "sig").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("r"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    rare = ranked.select("class", "n", F.explode(F.slice("r", 1, keep)).alias("x")).select("class", "n", F.col("x.sig").alias("sig"))
    # part k has the sizes from (1 / threshold) ** k on; a set meets larger ones in its own part and the next
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    a = rare.select(F.col("class").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array(part, part + 1)).alias("part"))
    b = rare.select(F.col("class").alias("b"), F.col("n").alias("n_b"), "sig", part.alias("part"))
    met = a.join(b, ["part", "sig"]).filter((F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & ((F.col("n_a") < F.col("n_b")) | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    sa, sb = sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    out = met.join(sa, "a").join(sb, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (both / (F.size("sa") + F.size("sb") - both)).alias("likeness"))
    return out.filter(F.col("likeness") >= threshold), members
