"""Learned operators: held-out accuracy, exact neighbours, reached targets, and odd tables."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield.llm import mixing, quality, queries, toxicity
from tarnfield.llm.common import table

from . import cases

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(sf_dir) -> str:
    return LARGER if os.path.isdir(LARGER) else sf_dir


def _agreement(rows, labels: dict[int, int]) -> tuple[float, float]:
    """Accuracy and area under the curve over held-out rows."""
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    area = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    return sum(p == y for _, p, y in held) / len(held), area


def test_quality_of_held_out_documents(spark, larger):
    rows = queries.op1_quality_pu(spark, larger).collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, larger, "labels").collect()}
    assert len(rows) == table(spark, larger, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    accuracy, area = _agreement(rows, labels)
    assert accuracy >= 0.85 and area >= 0.9


def test_toxicity_of_held_out_documents(spark, larger):
    rows = queries.op8_toxicity_knn(spark, larger).collect()
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, larger, "labels").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    accuracy, area = _agreement(rows, labels)
    assert accuracy >= 0.96 and area >= 0.94
    toxic = [r for r in rows if labels.get(r["doc_id"]) == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)


@pytest.mark.parametrize("scored", [quality.scored, toxicity.scored])
@pytest.mark.parametrize("make", [cases.documents, cases.clashing, cases.empty])
def test_odd_documents_are_scored(spark, scored, make):
    df = make(spark)
    out = scored(df, cases.labels(spark)).collect()
    assert len(out) == df.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in out)


@pytest.mark.parametrize("scored", [quality.scored, toxicity.scored])
def test_no_labels(spark, scored):
    df = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in scored(df, none).collect()}) == 1


def test_the_risk_never_goes_below_zero_and_finds_the_class():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, quality.N_FEATURES)), rng.normal(-1, 1, (300, quality.N_FEATURES))
    m = quality.fit(good[:150], np.vstack((good[150:], bad)), prior=1 / 3)
    assert m.scores(good[150:]).mean() > 0.8 and m.scores(bad).mean() < 0.2
    assert np.allclose(quality.fit(np.zeros((0, quality.N_FEATURES)), bad, 0.3).scores(bad), 0.3)


def test_the_prior_is_that_of_the_unlabelled_rows():
    """However many of each kind were labelled: only positives and unlabelled rows are looked at."""
    rng = np.random.default_rng(3)
    draw = lambda mean, n: rng.normal(mean, 1, (n, quality.N_FEATURES)) * 0.2
    for share in (0.2, 0.5, 0.85):
        mixed = np.vstack((draw(1, int(3000 * share)), draw(-1, 3000 - int(3000 * share))))
        assert abs(quality.class_prior(draw(1, 1000), mixed) - share) < 0.05


def test_neighbours_are_the_exact_ones():
    rng = np.random.default_rng(2)
    terms = [f"t{i}" for i in range(40)]
    draw = lambda: {int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(0, 8), replace=False)}
    vectors = [draw() for _ in range(500)]
    idf = rng.uniform(1, 4, 40)
    index = toxicity.Index(terms, idf, np.arange(500), rng.integers(0, 2, 500), vectors)
    dense = np.zeros((500, 40))
    for d, v in enumerate(vectors):
        t, w = index.vector(v)
        dense[d, t] = w
    for _ in range(60):
        q = draw()
        if not q:
            continue
        t, w = index.vector(q)
        place, cosine = index.nearest(t, w)
        full = np.zeros(40)
        full[t] = w
        all_of = dense @ full
        best = [d for d in np.lexsort((np.arange(500), -np.round(all_of, 12))) if all_of[d] > 0][: toxicity.K]
        assert np.allclose(np.sort(cosine)[::-1], all_of[best]) and set(np.round(cosine, 9)) == set(np.round(all_of[best], 9)) and len(place) == len(best)


def test_terms_are_counted_as_words_are():
    m = toxicity.Matcher(["bad", "badly", "ugly"])
    assert m.counts("Bad bad, badly BADLANDS ugly-uglyish xbad") == {0: 2, 1: 1, 2: 1}
    assert m.counts(None) == {} and toxicity.Matcher([]).counts("bad") == {}


def _odd_texts(rng):
    draw = lambda: "".join(rng.choice(list("aBcÉΣσς 1_\n-日\U00010400½́İ"), rng.integers(0, 60)))
    odd = [None, "", "\n", "Σας ΣΑΣ ΟΔΟΣ", "İstanbul İ", "a1b_c²d½e٣f", "日本語テキスト。漢字", "\U0001f600x\U00020000y", "ǅ ﬁ ß ẞ", "a\x00b", "x" * 300]
    return odd + [draw() for _ in range(300)]


@pytest.mark.parametrize("at_once", [toxicity.AT_ONCE, 50, 1])
def test_terms_of_many_texts_are_those_of_each(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
    odd = _odd_texts(np.random.default_rng(6))
    words = [Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for t in odd]
    terms = sorted(set().union(*words))[::2]
    m = toxicity.Matcher(terms)
    got = list(m.many(odd))
    assert all((np.diff(t) > 0).all() for t, _ in got)
    assert [dict(zip(t.tolist(), n.tolist(), strict=True)) for t, n in got] == [{i: w[x] for i, x in enumerate(terms) if x in w} for w in words]
    assert m.holders(odd).tolist() == [sum(x in w for w in words) for x in terms]
    assert list(m.many([])) == [] and m.holders([]).tolist() == [0] * len(terms)


def test_equal_words_of_a_batch_are_looked_up_once():
    """A word is looked up once for all texts of a batch, not once for each."""
    looked_up = Counter()

    class Place(dict):
        def get(self, word, *other):
            looked_up[word] += 1
            return super().get(word, *other)

    m = toxicity.Matcher(["bad", "ugly"])
    m.place = Place(m.place)
    assert [dict(zip(t.tolist(), n.tolist(), strict=True)) for t, n in m.many(["Bad bad good", "ugly bad", "good"] * 100)] == [{0: 2}, {0: 1, 1: 1}, {}] * 100
    assert looked_up == {b"bad": 1, b"ugly": 1, b"good": 1}


def _votes_by_hand(docs, examples):
    """Votes and evidence of texts by plain dictionaries: every cosine with every example, no index."""
    words = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    have = sorted({w for _, t, _ in examples for w in words(t)})
    df = {w: sum(w in words(t) for _, t in docs) for w in have}
    base = (sum(y for *_, y in examples) + 0.5) / (len(examples) + 1)
    weight = {}
    for w in have:
        own = [y for _, t, y in examples if w in words(t)]
        share = (sum(own) + toxicity.PRIOR * base) / (len(own) + toxicity.PRIOR)
        lean = max(math.log(share / (1 - share)) - math.log(base / (1 - base)), 0) + toxicity.LEAST
        weight[w] = (math.log((len(docs) + 1) / (df[w] + 1)) + 1) * lean

    def vector(text):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in words(text).items() if w in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    known = [(i, t, y, vector(t)) for i, t, y in sorted(examples)]
    bare = [y for *_, y, v in known if not v]
    out = []
    for _, text in docs:
        q = vector(text)
        if not q:
            out.append(("bare", (sum(bare) + toxicity.PULL * base) / (len(bare) + toxicity.PULL), []))
            continue
        near = sorted(((-round(c, 12), k, c) for k, (*_, v) in enumerate(known) if (c := sum(x * v.get(w, 0) for w, x in q.items())) > 0))[: toxicity.K]
        total = sum(c for *_, c in near)
        out.append(("vote", (sum(c * known[k][2] for _, k, c in near) + toxicity.PULL * base) / (total + toxicity.PULL), [known[k][0] for _, k, _ in near]))
    return out


def test_scores_are_those_of_all_cosines(spark):
    """The query's scores and evidence against brute force: repeated ids with other texts, copies, ties, texts without words."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    usual = np.array([1 / (i + 1) for i in range(120)])
    usual /= usual.sum()
    rows = []
    for i in range(400):
        ws = rng.choice(vocabulary, rng.integers(0, 40), p=usual).tolist() + ["vile"] * int(i % 9 == 0) + ["rotten"] * int(i % 12 == 0)
        rows.append((i, " ".join(ws)))
    rows += [(i, rows[i][1]) for i in range(0, 60, 7)] + [(5, "vile other text"), (1000, None), (1001, "12 34"), (1002, "unheard ofx")]
    marks = {i: int(i % 9 == 0) for i in range(300)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, y in marks.items()], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, labels).collect()
    learned = [(i, t or "", marks[i]) for i, t in rows if i in marks and zlib.crc32(str(i).encode()) % 5]
    index = toxicity.build(docs, labels, toxicity.learnable())
    want = Counter()
    for (i, _), (kind, v, near) in zip(rows, _votes_by_hand(rows, learned), strict=True):
        clipped = min(max(v, 1e-3), 1 - 1e-3)
        score = v if kind == "bare" else 1 / (1 + math.exp(-(index.slope * math.log(clipped / (1 - clipped)) + index.shift)))
        want[(i, round(score, 9), tuple(near))] += 1
    assert Counter((r["doc_id"], round(r["score"], 9), tuple(r["evidence"])) for r in got) == want


def test_nearly_all_documents_have_neighbours(spark, sf_dir):
    rows = queries.op8_toxicity_knn(spark, sf_dir).collect()
    worded = {r["doc_id"] for r in table(spark, sf_dir, "documents").filter("text rlike '[a-zA-Z]'").collect()}
    assert sum(not r["evidence"] for r in rows if r["doc_id"] in worded) < 0.05 * len(worded)


def test_without_toxic_keeps_rows_whole(spark):
    df = cases.clashing(spark)
    out = toxicity.without_toxic(df, cases.labels(spark))
    assert out.columns == df.columns and out.count() <= df.count()


# -- mixing


def test_targets_are_reached(spark, larger):
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    rows = mixing.rated(docs, labels).collect()
    assert len(rows) == docs.count()
    totals = {k: sum(r["rate"] * r["n_words"] * r[f"p_{k}"] for r in rows) for k in mixing.TARGETS}
    before = {k: sum(r["n_words"] * r[f"p_{k}"] for r in rows) for k in mixing.TARGETS}
    for k, share in mixing.TARGETS.items():
        want = share / mixing.TARGETS["good"] * before["good"]
        assert abs(totals[k] - want) <= 0.01 * sum(totals.values()), (k, totals, before)
    for k, share in mixing.TARGETS.items():  # the copies' tokens, and not the rates' alone
        want = share / mixing.TARGETS["good"] * before["good"]
        got = sum(r["copies"] * r["n_words"] * r[f"p_{k}"] for r in rows)
        assert abs(got - want) <= 0.01 * want, (k, got, want)
    assert sum(r["rate"] == 1 for r in rows) >= 0.5 * len(rows)
    assert all(r["copies"] in (math.floor(r["rate"]), math.ceil(r["rate"])) for r in rows)
    assert all(r["rate"] >= 0 and abs(sum(r[f"p_{k}"] for k in mixing.TARGETS) - 1) < 1e-9 and r["copies"] >= 0 for r in rows)


def test_the_posterior_is_bayes_rule_by_hand(spark):
    df = cases.documents(spark)
    labels = cases.labels(spark).select("doc_id", mixing.domain_of().alias("domain"))
    model = mixing.Classifier(["a", "b"], {"a": 0.5, "b": 0.5}, {}, {})
    for r in mixing.with_posteriors(df, model, doc_id=F.col("doc_id")).collect():
        assert math.isclose(r["p_a"], 0.5)
    row = mixing.with_traits(spark.range(1), F.lit("Fox, HOUND! a |\tlonger\nfox")).first()
    assert sorted(row["traits"]) == sorted(["fox", "hound", "a", "", "longer", " end !", " end |", " signs 2", " fresh 10 false"]) and row["t"] == 6
    model = mixing.Classifier(["a", "b"], {"a": 0.5, "b": 0.5}, {"fox": {"a": 2.0, "b": 0.5}, "hound": {"a": -1.0, "b": 0.25}}, {"a": -0.5, "b": 0.125})
    row = mixing.with_posteriors(spark.createDataFrame([(1, "fox hound fox")], "doc_id long, text string"), model, doc_id=F.col("doc_id")).first()
    la, lb = math.exp(-0.5 + 2.0 - 1.0), math.exp(0.125 + 0.5 + 0.25)
    assert math.isclose(row["p_a"], la / (la + lb), rel_tol=1e-6) and row["t"] == 3
    assert labels.filter("domain = 'toxic'").count() == 5


def test_rates_follow_the_steps(spark):
    df = spark.createDataFrame([(0.7, 0.3), (0.0, 1.0)], "p_a double, p_b double")
    got = [r[0] for r in df.select(mixing.rate(["a", "b"], [[0.5, -0.25], [3.0, 0.1]])).collect()]

    def by_hand(pa, pb):
        r = 1.0
        for ga, gb in ([0.5, -0.25], [3.0, 0.1]):
            r = max(0.0, r - pa * ga - pb * gb)
        return r

    assert np.allclose(got, [by_hand(0.7, 0.3), by_hand(0.0, 1.0)])


@pytest.mark.parametrize("make", [cases.documents, cases.clashing, cases.empty])
def test_odd_documents_are_rated(spark, make):
    df = make(spark)
    out = mixing.rated(df, cases.labels(spark)).collect()
    assert len(out) == df.count() and all(r["rate"] >= 0 for r in out)
    mixed = mixing.mixed(df, cases.labels(spark))
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["copies"] for r in out)


def test_no_labelled_rows_change_nothing(spark):
    df = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r["p_good"], 6) for r in mixing.rated(df, none).collect()} == {round(1 / 3, 6)}


def _soft(spark):
    """Many good rows, soft low ones, and a tiny toxic domain in a few rows."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        low = float(rng.uniform(0.3, 0.7)) if i % 4 == 0 else 1e-6
        rows.append((float(rng.integers(5, 200)), 1 - low - 1e-7, low, 1e-7))
    rows += [(20.0, 0.1, 0.2, 0.7)] * 2
    return spark.createDataFrame(rows, "t double, p_good double, p_low double, p_toxic double"), rows


def test_soft_and_tiny_domains_reach_their_targets(spark):
    df, rows = _soft(spark)
    steps, info = mixing.fit(df, list(mixing.TARGETS), mixing.TARGETS, "good")
    rates = [r["rate"] for r in df.select(mixing.rate(list(mixing.TARGETS), steps).alias("rate")).collect()]
    good = sum(t * g for t, g, *_ in rows)
    for i, (k, share) in enumerate(mixing.TARGETS.items()):
        got = sum(r * row[0] * row[i + 1] for r, row in zip(rates, rows, strict=True))
        assert abs(got - share / 0.9 * good) <= 1e-3 * share / 0.9 * good, (k, got, share / 0.9 * good)
    assert info["met"] and min(rates) >= 0


def test_domains_that_no_row_is_of_have_no_target(spark):
    df, rows = _soft(spark)
    steps, info = mixing.fit(df.filter("p_toxic < 0.5"), list(mixing.TARGETS), mixing.TARGETS, "good")
    assert info["held"] == ["good", "low"] and info["met"] and abs(info["goal"]["low"] / info["goal"]["good"] - 0.07 / 0.9) < 1e-9
    assert steps[0][2] == 0


def test_targets_that_no_rates_meet_are_reported(spark, caplog):
    df = spark.createDataFrame([(10.0, 0.5, 0.5), (30.0, 0.5, 0.5)], "t double, p_a double, p_b double")
    steps, info = mixing.fit(df, ["a", "b"], {"a": 0.9, "b": 0.1}, "a")
    assert not info["met"] and abs(info["reached"]["a"] - (info["goal"]["a"] + info["goal"]["b"]) / 2) < 0.01
    mixing.rated(cases.documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert "can't be reached" in caplog.text


def test_texts_without_toxic_words_have_neighbours_too(spark):
    """Few examples, so that no word's chi-square is large: every text with words is still searched for."""
    docs = spark.createDataFrame([(i, f"plain words {'foulword' if i % 10 == 0 else 'kindword'} number") for i in range(40)] + [(100, "plain number"), (101, "foulword"), (102, ""), (103, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    assert all(len(got[i]["evidence"]) == toxicity.K for i in [*range(40), 100]) and got[102]["evidence"] == got[103]["evidence"] == []
    assert {i % 10 for i in got[101]["evidence"]} == {0} and got[101]["score"] > got[1]["score"]
