"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z is lowered. A window is SPAN consecutive words of an item; an
item of fewer words, but not none, is one window. Fingerprints: of the K-word hashes within each SPAN words of a document
the smallest is kept, with its place (winnowing with K + GUARD - 1 = SPAN, so spans of SPAN equal words always keep an
equal hash). A kept hash carries the words around it. Those that some window has too are extended: each span of SPAN words
around them is compared with the windows, by its words and not by a hash. Items shorter than SPAN are looked up by the
hashes of spans of their own length and compared by words too.

The documents' texts are read once and never shuffled: rows of hits and a narrow row for each document are what remains.
Nulls: a null text has no words; a null doc_id is kept as it is; windows of items with a null item_id hit like any other,
and these items count together as one item that the digest leaves out. Equal rows are answered alike, each. An empty
benchmark hits nothing. Other columns than doc_id, text, item_id aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, stored, text_of

SPAN = 8
K = 5
GUARD = SPAN - K + 1
#: Marks (one long each) up to which the benchmark's side is broadcast; beyond, both sides are shuffled.
MARK_ROWS = 1_000_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(column: str = "text") -> Column:
    # splitting leaves an empty word where the text starts or ends with a gap
    return F.filter(F.split(ascii_lower(text_of(column)), _GAP), lambda w: w != "")


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _runs(hashes: Column, n: int) -> Column:
    """Hash of each run of n entries; empty if there are fewer."""
    last = F.size(hashes) - n
    some = F.transform(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, n)))
    return F.when(last >= 0, some).otherwise(F.array().cast("array<bigint>"))


def _winnowed(df: DataFrame) -> DataFrame:
    """Columns g (K-word hashes) and place (for each start of a span where its smallest hash stands) from wh."""
    df = df.withColumn("g", _runs(F.col("wh"), K))
    df = df.withColumn("placed", F.transform("g", lambda x, i: F.struct(x.alias("x"), i.cast("int").alias("i"))))
    # named more than once, so that Spark makes it once for a row and not in each step of the lambda
    starts = F.sequence(F.lit(1), F.greatest(F.size("placed") - GUARD + 1, F.lit(1)))
    low = F.transform(starts, lambda i: F.array_min(F.slice("placed", i, GUARD))["i"])
    return df.withColumn("place", F.when(F.size("placed") >= GUARD, low).otherwise(F.array().cast("array<int>"))).drop("placed")


def _joined(ws: Column, start: Column, n: int) -> Column:
    return F.array_join(F.slice(ws, start, n), " ")


def windows(benchmark: DataFrame) -> DataFrame:
    """span, full, mark, item: the distinct windows of each item; mark is the kept hash, full the words. item is "1" with the
    item_id behind it, or "0" for null."""
    item = F.coalesce(F.concat(F.lit("1"), F.col("item_id").cast("string")), F.lit("0"))
    items = benchmark.select(item.alias("item"), words().alias("ws")).withColumn("wh", word_hashes(F.col("ws"))).filter("size(wh) > 0")
    long = _winnowed(items.filter(F.size("wh") >= SPAN))
    found = F.transform("place", lambda p, i: F.struct(_joined(F.col("ws"), i + 1, SPAN).alias("full"), F.get("g", p).alias("mark")))
    long = long.select("item", F.explode(found).alias("x")).select(F.lit(SPAN).alias("span"), "x.full", "x.mark", "item")
    short = items.filter(F.size("wh") < SPAN).select(F.size("wh").alias("span"), F.array_join("ws", " ").alias("full"), F.xxhash64("wh").alias("mark"), "item")
    return long.union(short).distinct()


def hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each document (at = -1, with n_words) and one for each start of a span that is a window (full: its words)."""
    spans = sorted(r["span"] for r in found.select("span").distinct().collect())  # at most SPAN values
    src = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), words().alias("ws")).withColumn("wh", word_hashes(F.col("ws")))
    none = F.array().cast("array<string>")
    row = lambda span, at, mark, near, n: F.struct(F.lit(span).alias("span"), at.cast("int").alias("at"), mark.alias("mark"), near.alias("near"), n.cast("long").alias("n_words"))
    rows = [F.array(row(0, F.lit(-1), F.col("h"), none, F.size("wh")))]
    if SPAN in spans:
        src = _winnowed(src).withColumn("kept", F.array_distinct("place"))
        first = lambda p: F.greatest(p - (GUARD - 1), F.lit(0))
        rows.append(F.transform("kept", lambda p: row(SPAN, first(p), F.get("g", p), F.slice("ws", first(p) + 1, SPAN + GUARD - 1), F.lit(None))))
    for n in (s for s in spans if s < SPAN):
        src = src.withColumn(f"r{n}", _runs(F.col("wh"), n))
        rows.append(_short_rows(row, n))
    all_rows = src.select("doc_id", "h", F.explode(F.concat(*rows)).alias("x")).select("doc_id", "h", "x.*")
    marks = small(found.select(F.col("span").alias("m_span"), F.col("mark").alias("m_mark")).distinct(), MARK_ROWS)
    near = all_rows.join(marks, (F.col("span") == F.col("m_span")) & (F.col("mark") == F.col("m_mark")), "left").filter("at < 0 or m_mark is not null")
    near = stored(near.select("doc_id", "h", "span", "at", "near", "n_words"), "marks")
    own = near.filter("at < 0").select("doc_id", "h", "span", "at", F.lit(None).cast("string").alias("full"), "n_words")
    around = F.transform(F.sequence(F.lit(0), F.size("near") - F.col("span")), lambda j: F.struct((F.col("at") + j).alias("at"), F.array_join(F.slice("near", j + 1, F.col("span")), " ").alias("full")))
    spans_of = near.filter("at >= 0").select("doc_id", "h", "span", F.explode(around).alias("x")).select("doc_id", "h", "span", "x.at", "x.full")
    real = small(found.select(F.col("span").alias("m_span"), F.col("full").alias("m_full")).distinct(), MARK_ROWS)
    hit = spans_of.join(real, (F.col("span") == F.col("m_span")) & (F.col("full") == F.col("m_full")), "left_semi")
    return own.unionByName(hit.withColumn("n_words", F.lit(None).cast("long")))


def _short_rows(row, n: int) -> Column:
    return F.transform(f"r{n}", lambda m, i: row(n, i, m, F.slice("ws", i + 1, n), F.lit(None)))


def _covered(spans: Column) -> Column:
    """Number of words in the union of sorted (from, to) pairs."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["to"] - F.greatest(x["from"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["to"]).alias("to"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """doc_id, h (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    found = stored(windows(benchmark), "windows")
    rows = stored(hits(docs, found), "hits")
    hit = rows.filter("at >= 0")
    # windows with the same items count as one: a passage gives its items once
    sets = found.groupBy("span", "full").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("sign", F.sha2(F.array_join("items", ","), 256))
    signed = hit.join(small(sets.select("span", "full", "sign")), ["span", "full"]).select("doc_id", "h", "at", "span", "sign")
    by_doc = signed.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.struct(F.col("at").alias("from"), (F.col("at") + F.col("span")).alias("to")))).alias("spans"), F.collect_set("sign").alias("signs")
    )
    items = small(sets.select("sign", "items").distinct())
    ids = by_doc.select("doc_id", "h", F.explode("signs").alias("sign")).join(items, "sign").select("doc_id", "h", F.explode("items").alias("item"))
    ids = ids.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("i_id"), F.col("h").alias("i_h"), "items")
    covered = by_doc.select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), _covered(F.col("spans")).cast("long").alias("n_hit"))
    covered = covered.join(ids, F.col("s_id").eqNullSafe(F.col("i_id")) & (F.col("s_h") == F.col("i_h")))
    out = rows.filter("at < 0").select("doc_id", "h", "n_words").join(covered, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    n = F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))
    named = F.transform(F.filter("items", lambda x: x != "0"), lambda x: F.substring(x, 2, 1 << 30))
    return out.select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n.cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(named, ","), F.lit("")), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """The rows of docs, all columns, that share windows with fewer than min_items items."""
    bad = contaminated(docs, benchmark, min_items).filter("contaminated").select(F.col("doc_id").alias("__tarnfield_id"), F.col("h").alias("__tarnfield_h")).distinct()
    bad = small(stored(bad, "contaminated"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__tarnfield_id")) & (F.xxhash64(text_of()) == F.col("__tarnfield_h")), "left_anti")
