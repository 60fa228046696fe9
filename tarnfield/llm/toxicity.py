"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over all words that the examples have.

Terms are lower-case runs of letters; none that an example has is left out. A term weighs (1 + ln tf) * idf * lean: the
idf from the counts of all documents; the lean LEAST and, for terms that lean toxic, the difference of log-odds between the
term's examples and all (the term's count smoothed with PRIOR examples at the base rate). Without the lean, the accidental
words that two texts share decide who is near, and votes tell little (README has the figures). Vectors have length 1 within
the examples' terms; other words meet no example and rank none.

The index is an inverted one with block maxima. Examples that are alike stand together (a few centroids over the most
widespread terms, then by length) and are cut into blocks of BLOCK. Lists of terms that at most 1 / LONG of the examples
have are short: a query adds them up first. The long lists are kept by blocks, each with its largest weight; these maxima
bound what a block's examples can still gain. The FIRST examples with the largest bounds get their exact cosines, and then
all whose bound reaches the K-th best of those; no other can be a neighbour, so the K nearest are exact.

The vote is the cosine-weighted share of toxic neighbours, drawn to the base rate by weight PULL; a logistic fit on the
examples' leave-one-out votes makes it a probability. A text with none of the examples' terms has the examples' rate for
such texts, drawn the same way. Evidence: the neighbours' doc_ids.

MAX_ROWS bounds, in expectation, the labelled rows that are examples (chosen by a hash of doc_id); so the index has a
proven bound and goes to every worker. Document counts and scores cover all rows. Null and empty texts have no terms.
Rows with a null doc_id or label are never examples; a doc_id on several rows gives an example for each different text.
Neighbours with equal cosines: the smaller doc_id first, then the lesser text. Without examples of both kinds every score
is the base rate. Only doc_id, text and toxic are read; labels, lang and source are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import bounded_batches, crc_mod, text_of

MAX_ROWS = 8000
K = 15
BLOCK = 32
#: Examples that are looked at before any is ruled out.
FIRST = 64
#: Lists of terms that over 1 / LONG of the examples have are read by blocks.
LONG = 8
PULL = 0.5
#: Examples at the base rate that each term is given besides its own, and what every term weighs at least.
PRIOR = 5.0
LEAST = 0.05
#: Centroids that the examples are ordered by, and the most widespread terms that these see.
CENTROIDS, SEEN = 16, 256
WORD = re.compile(r"[^\W\d_]+")
NO_LETTER = re.compile(r"[\W\d_]")
#: Code points that words are found in at once.
AT_ONCE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Of each code point whether WORD takes it."""
    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    for m in WORD.finditer(np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = True
    return out


class Matcher:
    """Counts of the index's terms in texts: many texts at once, as arrays, with one look-up for equal words."""

    def __init__(self, terms: list[str]):
        self.place = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(terms)}

    def many(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the terms' numbers, ascending, and how often each stands in it."""
        key, n = self._keys(texts)
        ends = np.searchsorted(key, np.arange(len(texts) + 1) * len(self.place)).tolist()
        t, n = (key % max(1, len(self.place))).astype("i4"), n.astype("i4")
        return ((t[a:b], n[a:b]) for a, b in pairwise(ends))

    def holders(self, texts: list[str | None]) -> np.ndarray:
        """Of each term how many of the texts have it."""
        return np.bincount(self._keys(texts)[0] % max(1, len(self.place)), minlength=len(self.place))

    def counts(self, text: str | None) -> dict[int, int]:
        ((t, n),) = self.many([text])
        return dict(zip(t.tolist(), n.tolist(), strict=True))

    def _keys(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A text's place in the list times the number of terms, plus a term that it has: ascending; and how often."""
        keys, often = [np.zeros(0, dtype="i8")], [np.zeros(0, dtype="i8")]
        for row, part in _parts(texts):
            words, n_words = _words(part)
            known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
            term = np.fromiter(map(self.place.get, known, repeat(-1)), "i8", len(known))[words.indices.to_numpy()]
            key, n = np.unique((np.repeat(np.array(row) * len(self.place), n_words) + term)[term >= 0], return_counts=True)
            keys.append(key)
            often.append(n)
        key, n = np.concatenate(keys), np.concatenate(often)
        if (key[1:] <= key[:-1]).any():  # a text came in several parts
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, n).astype("i8")
        return key, n


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-case texts and their places in the list, about AT_ONCE code points at a time; longer ones are cut between words."""
    row, part, size = [], [], 0
    for i, text in enumerate(texts):
        text, start = text.lower() if text else "", 0
        while start < len(text):
            cut = NO_LETTER.search(text, start + AT_ONCE)
            piece = text[start : cut.start()] if cut else text[start:]
            row.append(i)
            part.append(piece)
            start, size = start + len(piece), size + len(piece)
            if size >= AT_ONCE:
                yield row, part
                row, part, size = [], [], 0
    if part:
        yield row, part


def _words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, one behind the other, in UTF-8, and how many each text has."""
    text = "\n".join(["", *texts, ""])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    n_words = np.diff(np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts)])))
    width = 1 + (points >= 0x80).astype("u1") + (points >= 0x800) + (points >= 0x10000)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")[np.repeat(letter, width)]
    at = np.cumsum(width, dtype="i8")  # from start - 1 to end - 1 a word's bytes; no word stands first
    ends = np.concatenate(([0], np.cumsum(at[end - 1] - at[start - 1])))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return words.dictionary_encode(), n_words


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then those from start[1] on, ..."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _alike(vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, length: np.ndarray) -> np.ndarray:
    """The examples' numbers in an order that has like ones together. vectors: terms and weights of length 1."""
    n = len(vectors)
    usual = np.argsort(-np.bincount(np.concatenate([t for t, _ in vectors]), minlength=n_terms), kind="stable")[:SEEN]
    row, m = np.full(n_terms, -1, dtype="i4"), np.zeros((n, len(usual)), dtype="f4")
    row[usual] = np.arange(len(usual))
    for d, (t, w) in enumerate(vectors):
        r = row[t]
        m[d, r[r >= 0]] = w[r >= 0]
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    centre = m[np.linspace(0, n - 1, min(n, CENTROIDS)).astype("i8")]
    for _ in range(6):
        near = np.argmax(m @ centre.T, axis=1)
        for c in np.unique(near).tolist():
            mean = m[near == c].mean(axis=0)
            centre[c] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return np.lexsort((np.arange(n), length, near))


class Index:
    """Block-max postings of the examples. ids and labels are those of the examples in order of doc_id and text."""

    def __init__(self, terms: list[str], idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: list):
        self.words, self.n_terms, self.idf, self.ids, self.labels = "\n".join(terms), len(terms), idf, ids, labels.astype("f8")
        self.base = (self.labels.sum() + 0.5) / (len(labels) + 1)
        self.slope, self.shift = 1.0, 0.0
        own = [self.vector(v) for v in vectors]
        some = np.array([d for d, (t, _) in enumerate(own) if len(t)], dtype="i4")
        bare = np.ones(len(own), dtype=bool)
        bare[some] = False
        self.bare = (self.labels[bare].sum() + PULL * self.base) / (bare.sum() + PULL) if len(labels) else self.base
        length = np.array([len(own[d][0]) for d in some.tolist()])
        order = some[_alike([own[d] for d in some.tolist()], len(terms), length)] if len(some) else some
        self.order, n = order, len(order)
        often = np.bincount(np.concatenate([np.zeros(0, dtype="i4"), *[own[d][0] for d in order.tolist()]]), minlength=len(terms))
        long = np.flatnonzero(often > n / LONG)
        #: Of each term the column of its long list, or -1; long lists as columns, and their maxima in each block.
        self.column = np.full(len(terms), -1, dtype="i4")
        self.column[long] = np.arange(len(long))
        self.long = np.zeros((n, len(long)))
        short: list[tuple[np.ndarray, np.ndarray]] = []
        for place, d in enumerate(order.tolist()):
            t, w = own[d]
            c = self.column[t]
            self.long[place, c[c >= 0]] = w[c >= 0]
            short.append((t[c < 0], w[c < 0]))
        self.tops = np.array([self.long[a : a + BLOCK].max(axis=0) for a in range(0, n, BLOCK)]).reshape(-(-n // BLOCK), len(long))
        # short lists, one behind the other by term, each in the order of the examples' places
        term = np.concatenate([np.zeros(0, dtype="i4"), *[t for t, _ in short]])
        by = np.argsort(term, kind="stable")
        self.place = np.repeat(np.arange(n, dtype="i4"), [len(t) for t, _ in short])[by]
        self.weight = np.concatenate([np.zeros(0), *[w for _, w in short]])[by]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms))))).astype("i4")
        self._calibrate(own, some)

    def matcher(self) -> Matcher:
        return Matcher(self.words.split("\n") if self.n_terms else [])

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        """counts: by term, or the terms' numbers, ascending, and their counts."""
        if isinstance(counts, dict):
            counts = np.array(sorted(counts), dtype="i4"), np.array([counts[i] for i in sorted(counts)])
        t, n = counts
        w = (1 + np.log(n)) * self.idf[t] if len(t) else np.zeros(0)
        return t, w / np.linalg.norm(w) if len(t) else w

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and cosines of the k examples with the largest positive cosines; ties go to the lower number."""
        partial, q, bound = self._bounds(t, w)
        best = np.argpartition(-bound, FIRST)[:FIRST] if len(bound) > FIRST else np.arange(len(bound))
        cosine = partial[best] + self.long[best] @ q
        floor = np.partition(cosine, len(cosine) - k)[len(cosine) - k] if len(cosine) > k else 0.0
        bound[best] = -1.0
        rest = np.flatnonzero((bound > 0) & (bound >= floor - 1e-9))
        place, cosine = np.concatenate((best, rest)), np.concatenate((cosine, partial[rest] + self.long[rest] @ q))
        near = cosine > 0
        if len(cosine) > k:
            near &= cosine >= np.partition(cosine, len(cosine) - k)[len(cosine) - k] - 1e-11
        number, cosine = self.order[place[near]], cosine[near]
        by = np.lexsort((number, -np.round(cosine, 12)))[:k]
        return number[by], cosine[by]

    def _bounds(self, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By place: what the short lists give, and the most that the cosine can be; between them the long lists' weights."""
        c, n = self.column[t], len(self.order)
        q = np.zeros(self.long.shape[1])
        q[c[c >= 0]] = w[c >= 0]
        t, w = t[c < 0], w[c < 0]
        size = self.ends[t + 1] - self.ends[t]
        at = _ranges(self.ends[t], size)
        partial = np.bincount(self.place[at], self.weight[at] * np.repeat(w, size), n)
        return partial, q, partial + np.repeat(self.tops @ q, BLOCK)[:n]

    def vote(self, t: np.ndarray, w: np.ndarray, but: int | None = None) -> tuple[float, np.ndarray]:
        p, c = self.nearest(t, w, K + (but is not None))
        if but is not None:
            p, c = p[p != but][:K], c[p != but][:K]
        return float((c @ self.labels[p] + PULL * self.base) / (c.sum() + PULL)), p

    def _calibrate(self, own: list[tuple[np.ndarray, np.ndarray]], some: np.ndarray) -> None:
        """Two parameters by Newton's method on leave-one-out votes, with a weak prior on the slope."""
        y = self.labels[some]
        if not len(y) or not 0 < y.sum() < len(y):
            return
        v = np.clip([self.vote(*own[d], but=d)[0] for d in some.tolist()], 1e-3, 1 - 1e-3)
        x = np.stack((np.log(v / (1 - v)), np.ones(len(v))), axis=1)
        theta = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            g = x.T @ (p - y) + np.array([theta[0] - 1, 0.1 * theta[1]])
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 0.1])
            theta = theta - np.clip(np.linalg.solve(h, g), -1, 1)
        self.slope, self.shift = max(float(theta[0]), 0.1), float(theta[1])

    def score(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[int]]:
        if not len(counts[0]) or not len(self.order):
            return float(self.bare), []
        v, near = self.vote(*self.vector(counts))
        v = min(max(v, 1e-3), 1 - 1e-3)
        return 1 / (1 + math.exp(-(self.slope * math.log(v / (1 - v)) + self.shift))), self.ids[near].tolist()


def examples(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, y, text of at most about max_rows labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learnable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return text.join(F.broadcast(known), "doc_id")  # bounded by max_rows


def build(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = MAX_ROWS) -> Index:
    bounded_batches(docs.sparkSession)
    rows = examples(docs, labels, learnable, max_rows).select("doc_id", "y", "text").collect()  # bounded by max_rows
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    labels_of = np.array([r["y"] for r in rows], dtype="i8")
    terms = sorted({w for r in rows for w in WORD.findall(r["text"].lower())})
    matcher = Matcher(terms)
    vectors = [v for i in range(0, len(rows), 500) for v in matcher.many([r["text"] for r in rows[i : i + 500]])]
    ids, size = np.array([r["doc_id"] for r in rows], dtype="i8"), len(terms)
    del rows, matcher
    n, a = np.zeros(size), np.zeros(size)
    for (t, _), y in zip(vectors, labels_of.tolist(), strict=True):
        n[t] += 1
        a[t] += y
    base = (labels_of.sum() + 0.5) / (len(ids) + 1)
    share = (a + PRIOR * base) / (n + PRIOR)
    lean = np.maximum(np.log(share / (1 - share)) - math.log(base / (1 - base)), 0) + LEAST
    n_docs, df = docs.count(), np.zeros(size)
    counted = document_counts(docs.select(text_of().alias("text")), terms).toArrow()  # a row a term
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    return Index(terms, idf * lean, ids, labels_of, vectors)


def document_counts(texts: DataFrame, terms: list[str]) -> DataFrame:
    """term (its number), n: the rows whose text has it; each task counts its own rows first."""
    def run(batches):
        matcher, n = Matcher(terms), np.zeros(len(terms), dtype="i8")
        for b in batches:
            n += matcher.holders(b.column(0).to_pylist())
        at = np.flatnonzero(n)
        for i in range(0, len(at), 50_000):
            x = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(n[x], pa.int64())], ["term", "n"])

    return texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


_SCORE = StructType([StructField("score", DoubleType()), StructField("evidence", ArrayType(LongType())), StructField("n_terms", IntegerType())])


def score_column(index: Index, text: Column) -> Column:
    """score, evidence (doc_ids of the nearest examples), n_terms."""
    made: dict[str, Matcher] = {}

    @F.arrow_udf(_SCORE)
    def of(text: pa.Array) -> pa.Array:
        if "m" not in made:
            made["m"] = index.matcher()
        own = list(dict.fromkeys(texts := text.to_pylist()))  # copies have the same
        answer = {t: (*index.score(counts), len(counts[0])) for t, counts in zip(own, made["m"].many(own), strict=True)}
        kinds = (pa.float64(), pa.list_(pa.int64()), pa.int32())
        parts = [pa.array(c, k) for c, k in zip(zip(*[answer[t] for t in texts], strict=True) if texts else ((), (), ()), kinds, strict=True)]
        return pa.StructArray.from_arrays(parts, ["score", "evidence", "n_terms"])

    return of(text)


def learnable() -> Column:
    return crc_mod(5) != 0


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row."""
    index = build(docs, labels, learnable())
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(index, text_of()).alias("s"))
    return out.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= threshold).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold."""
    index = build(docs, labels, learnable())
    return docs.withColumn("__tarnfield_s", score_column(index, text_of())).filter(F.col("__tarnfield_s.score") < threshold).drop("__tarnfield_s")
