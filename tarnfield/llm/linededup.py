"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop frequent lines, reassemble.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lowered; it is compared by 128 bits of hash.
Keys of at least min_chars code points that stand in at least min_docs documents (rows) lose all their lines. Null and
empty texts are one empty line; a document all of whose lines go has the text "". Repeated rows are documents of their
own. Other columns than doc_id and text aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, stored, text_of

_BLANK = " \t\n\x0b\x0c\r"


def _keys(text: Column, min_chars: int) -> Column:
    """For each line the hash of its key, null for keys that are too short."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(_BLANK)))
    keys = F.transform(trimmed, ascii_lower)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"))))


def frequent_keys(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """a, b: the hash of each key in at least min_docs documents. Rows are counted before they are shuffled."""
    keys = docs.select(F.explode(F.array_distinct(_keys(text_of(), min_chars))).alias("k"))
    return keys.filter("k is not null").select("k.a", "k.b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("a", "b")


def dedup_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10) -> DataFrame:
    """doc_id, text (what is kept), n_lines, n_dropped."""
    src = docs.select("doc_id", text_of().alias("t"))
    hot = small(stored(frequent_keys(docs, min_chars, min_docs), "frequent-lines"))
    lines = src.select("doc_id", F.xxhash64("t").alias("h"), F.posexplode(_keys(F.col("t"), min_chars)).alias("pos", "k")).filter("k is not null")
    # equal rows have equal lines, so (doc_id, hash of the text) may stand for several rows
    gone = (
        lines.select("doc_id", "h", "pos", "k.a", "k.b").join(hot, ["a", "b"], "left_semi")
        .groupBy("doc_id", "h").agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "gone").hint("shuffle_hash")
    )
    joined = src.withColumn("h", F.xxhash64("t")).join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left")
    rows = joined.select("doc_id", F.split("t", "\n", -1).alias("ls"), "gone")
    index = F.sequence(F.lit(0), F.size("ls") - 1)
    kept = F.transform(F.array_except(index, F.col("gone")), lambda i: F.get("ls", i))
    text = F.when(F.col("gone").isNull(), F.array_join("ls", "\n")).otherwise(F.array_join(kept, "\n"))
    return rows.select("doc_id", text.alias("text"), F.size("ls").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
