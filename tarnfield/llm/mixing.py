"""Mixing to target weights by soft membership, with DataFrame functions only.

1. A labelled table teaches a naive Bayes classifier. A document's traits are its lower-case words (its
   blank-separated parts without MARKS around them), the characters that its parts end with, and in coarse steps how many
   of its different parts end with one of the SIGNS and how much it repeats itself;
   the TRAITS most telling ones (chi-square over the labelled rows' document counts) get a weight for each domain (Bernoulli
   model: what is absent counts too). Only traits that speak for another domain than the largest are taken: a short text that
   has none of them is the largest domain's.
2. Every document gets its posterior probability of each domain, p, and its number of words, t.
3. Rates r >= 0, one for each document, are those nearest to 1 (squares weighted by t) at which sum(r t p_k) is T_k for each
domain k: r = max(0, 1 - sum_k p_k g_k), with one vector g for all documents, found by Newton's method on the small system
of the domains. An evaluation is one aggregation over the stored table of p and t that gives a few numbers for each pair of
domains. Where no rates meet the targets, the misses' squares, each divided by the domain's tokens, are least; goal and
totals are then logged as a warning. Domains that are no document's most probable one have no target (also logged).

T: the shares of the other domains' targets in a total that leaves the anchor domain's expected tokens as they are (without
the anchor: all tokens). Rows whose rate is within SLACK of 1 are then held at exactly 1, so that documents which mixing
has no quarrel with are neither lost nor doubled, and the others' rates are fitted again to what the held rows leave of the
targets; where that can't be, no row is held. Copies of a document are its rate rounded at random by a hash of doc_id and
text, so the expected copies are the rate. Of SEEDS hashes each domain's
own rows get the one with which realised tokens are nearest to the targets; one aggregation tells.

TRAIN_ROWS bounds, in expectation, the labelled rows that teach (by a hash of doc_id); all else covers all rows. Null and
empty texts have the traits of an empty text and no tokens, so any rate fits them; repeated rows are rated each; a null
doc_id is rated like any other. With no labelled rows the posterior is uniform. Only doc_id and text are read of documents.
"""

from __future__ import annotations

import logging
import math
import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

log = logging.getLogger(__name__)

TRAIN_ROWS = 20_000
TRAITS = 256
MIN_CHI = 60.0
MIN_ROWS = 5
#: Weight of a miss against the distance from 1: so small that targets which can be met are.
SOFT = 1e-6
SLACK = 0.1
SEEDS = 32
MARKS = ".,;:!?\"'()[]{}#$%&*|<>=+-_/~^@`"
SIGNS = "!?#$%&*|<>=+_/~^@"
_BLANKS = "\n\t\r"
TARGETS = {"good": 0.9, "low": 0.07, "toxic": 0.03}


def domain_of() -> Column:
    """The domain of a row of the table labels."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def _parts(text: Column) -> Column:
    """What stands between blanks, tabs, line feeds and carriage returns; a literal separator is split without a pattern."""
    return F.split(reduce(lambda c, b: F.replace(c, F.lit(b), F.lit(" ")), _BLANKS, text), " ")


def with_traits(df: DataFrame, text: Column, **keep: Column) -> DataFrame:
    """`keep`, t (number of words) and traits (distinct strings). Each step is a projection of its own, as a function with a
    lambda is worked out anew wherever it stands; parts are made unlike first, so that each is looked at once."""
    df = df.select(*[c.alias(f"k_{n}") for n, c in keep.items()], _parts(F.lower(text)).alias("parts"))
    own = [f"k_{n}" for n in keep]
    df = df.select(*own, F.array_distinct("parts").alias("unlike"), F.size("parts").alias("n"), F.size(F.array_remove("parts", "")).cast("double").alias("t"))
    df = df.select(*own, "t", "n", "unlike", F.transform("unlike", lambda w: F.substring(w, -1, 1)).alias("ends"))
    words = F.array_distinct(F.transform("unlike", lambda w: F.trim(w, F.lit(MARKS))))
    ends = F.transform(F.array_intersect("ends", F.lit(list(SIGNS))), lambda e: F.concat(F.lit(" end "), e))
    joined = F.array_join("ends", "")
    signs = F.octet_length(joined) - F.octet_length(F.regexp_replace(joined, "[" + re.escape(SIGNS) + "]", ""))
    share = F.concat(F.lit(" signs "), (signs * 8 / F.size("ends")).cast("int").cast("string"))
    fresh = F.concat_ws(" ", F.lit(" fresh"), F.floor(F.size("unlike") * 10 / F.col("n")).cast("string"), F.col("n") > 20)
    return df.select(*[F.col(f"k_{n}").alias(n) for n in keep], "t", F.concat(words, ends, F.array(share, fresh)).alias("traits"))


class Classifier:
    def __init__(self, domains: list[str], prior: dict[str, float], weights: dict[str, dict[str, float]], base: dict[str, float] | None = None):
        self.domains, self.prior, self.weights, self.base = domains, prior, weights, base or {}

    def posterior(self, traits: Column) -> Column:
        """A struct with the log of prior times likelihood of each domain (of an untaught classifier: of the prior)."""
        order = sorted(self.weights)
        if not order:
            return F.struct(*[F.lit(math.log(self.prior[k])).alias(k) for k in self.domains])
        known = F.lit(order)
        found = F.transform(F.array_intersect(traits, known), lambda b: F.array_position(known, b).cast("int") - 1)
        weights = {k: F.lit([round(self.weights[b][k], 6) for b in order]) for k in self.domains}
        start = F.struct(*[F.lit(self.base[k]).alias(k) for k in self.domains])
        # one pass that sums for all domains: a function with a lambda is evaluated anew wherever it stands
        sums = F.aggregate(found, start, lambda acc, s: F.struct(*[(acc[k] + F.get(weights[k], s)).alias(k) for k in self.domains]))
        return sums


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = TRAIN_ROWS) -> Classifier:
    """labelled: doc_id, domain."""
    known = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "domain").dropDuplicates(["doc_id"])
    share = min(1.0, max_rows / max(1, known.count()))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(known), "doc_id")  # bounded by max_rows
    rows = with_traits(rows, F.col("text"), domain=F.col("domain")).withColumnRenamed("traits", "ts")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    prior = {k: (sizes.get(k, 0) + 1) / (n + len(domains)) for k in domains}
    if not n:
        return Classifier(domains, prior, {})
    # the outer form, as for the inner one Spark would ask beforehand whether the traits are empty, and so make them twice
    counts = rows.select("domain", F.explode_outer("ts").alias("b")).groupBy("b").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == k, 1)).alias(f"n_{k}") for k in domains])

    def chi(k: str) -> Column:
        size = sizes.get(k, 0)
        a, b = F.col(f"n_{k}").cast("double"), (F.col("n") - F.col(f"n_{k}")).cast("double")
        c, d = size - a, (n - size) - b
        return F.when(a * d > b * c, n * F.pow(a * d - b * c, 2) / F.greatest(F.lit(1.0), (a + b) * (c + d) * (a + c) * (b + d))).otherwise(0.0)

    usual = max(domains, key=lambda k: sizes.get(k, 0))
    best = counts.filter(F.col("n") >= MIN_ROWS).withColumn("chi", F.greatest(F.lit(0.0), F.lit(0.0), *[chi(k) for k in domains if k != usual])).filter(F.col("chi") >= MIN_CHI)
    weights, absent = {}, dict.fromkeys(domains, 0.0)
    for r in best.orderBy(F.desc("chi"), "b").limit(TRAITS).collect():
        share_of = {k: (r[f"n_{k}"] + (r["n"] + 0.5) / (n + 1)) / (sizes.get(k, 0) + 1) for k in domains}
        weights[r["b"]] = {k: math.log(x) - math.log1p(-min(x, 0.999)) for k, x in share_of.items()}
        for k, x in share_of.items():
            absent[k] += math.log1p(-min(x, 0.999))
    return Classifier(domains, prior, weights, {k: math.log(prior[k]) + absent[k] for k in domains})


def with_posteriors(docs: DataFrame, model: Classifier, **keep: Column) -> DataFrame:
    """`keep` and p_<domain>, t of every row."""
    traits = with_traits(docs, text_of(), **keep)
    scores = traits.select(*keep, "t", model.posterior(F.col("traits")).alias("l"))
    top = F.greatest(*[F.col("l")[k] for k in model.domains])
    parts = {k: F.exp(F.col("l")[k] - top) for k in model.domains}
    total = reduce(lambda a, b: a + b, parts.values())
    return scores.select(*[c for c in scores.columns if c != "l"], *[(parts[k] / total).alias(f"p_{k}") for k in model.domains])


def rate(domains: list[str], steps: list[list[float]]) -> Column:
    """The rate that the steps so far give a row with p_<domain>."""
    if not steps:
        return F.lit(1.0)
    moves = F.lit([[float(x) for x in g] for g in steps])
    # the probabilities travel in the accumulator, so that they are worked out once for a row and not in each step
    start = F.struct(F.lit(1.0).alias("r"), *[F.col(f"p_{k}").alias(f"p_{k}") for k in domains])

    def step(acc: Column, g: Column) -> Column:
        down = reduce(lambda a, b: a + b, [acc[f"p_{k}"] * F.get(g, F.lit(i)) for i, k in enumerate(domains)])
        return F.struct(F.greatest(F.lit(0.0), acc["r"] - down).alias("r"), *[acc[f"p_{k}"].alias(f"p_{k}") for k in domains])

    return F.aggregate(moves, start, step, lambda acc: acc["r"])


def fit(table: DataFrame, domains: list[str], targets: dict[str, float], anchor: str, tolerance: float = 1e-4, goals: dict[str, float] | None = None) -> tuple[list[list[float]], dict]:
    """The steps' vectors (one), and the totals reached; table has t and p_<domain>, and is read once for each evaluation.
    goals: the totals of the domains, where they aren't to be taken from the targets.

    The rates nearest to 1 (squares weighted by t) that meet the targets are max(0, 1 - sum_k p_k g_k), where g is the
    least point of the convex h(g) = sum t r(g)^2 / 2 + T g + SOFT sum s_k g_k^2 / 2; Newton's method finds it with a
    halved step where a whole one doesn't lower h, until the gradient is gone.
    """
    held, size = _held(table, domains)
    if goals:
        held = set(goals)
    at = [i for i, k in enumerate(domains) if k in held]
    used = [domains[i] for i in at]
    info = {"size": dict(zip(domains, size, strict=True)), "held": used, "goal": {}, "reached": {}, "met": True}
    if not used or not sum(targets[k] for k in used):
        return [], info
    if goals and not all(size[i] for i in at):
        return [], info
    share = np.array([targets[k] for k in used]) / sum(targets[k] for k in used)
    s = np.array([size[i] for i in at])
    goal = share * (s[used.index(anchor)] / share[used.index(anchor)] if anchor in used and targets[anchor] else s.sum())
    if goals:
        goal = np.array([goals[k] for k in used])
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]

    def spread(g: np.ndarray) -> list[float]:
        full = [0.0] * len(domains)
        for i, x in zip(at, g.tolist(), strict=True):
            full[i] = x
        return full

    def value(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """h, the totals, and the second derivatives of h."""
        rows = table.select(rate(domains, [spread(g)]).alias("r"), "t", *[f"p_{k}" for k in used])  # the rate is worked out once for all domains
        p = [F.col(f"p_{k}") for k in used]
        t, live = F.col("t"), F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        got = rows.agg(F.sum(t * F.col("r") * F.col("r")), *[F.sum(F.col("r") * t * x) for x in p], *[F.sum(live * p[i] * p[j]) for i, j in pairs]).first()
        second = np.diag(SOFT * s)
        for (i, j), x in zip(pairs, got[len(at) + 1 :], strict=True):
            second[i, j] += x
            second[j, i] += x if i != j else 0.0
        return got[0] / 2 + float(goal @ g) + SOFT * float(s @ g**2) / 2, np.array(got[1 : len(at) + 1]), second

    g = np.zeros(len(at))
    h, now, second = value(g)
    while True:
        slope = goal - now + SOFT * s * g
        if np.abs(slope).sum() <= 0.01 * tolerance * np.abs(goal).sum():
            break
        step = -np.linalg.solve(second, slope)
        length, fall = 1.0, float(slope @ step)
        while (new := value(g + length * step))[0] > h + 1e-4 * length * fall and length > 1e-9:
            length /= 2
        if new[0] >= h:  # no lower value can be told from h in doubles
            break
        g, (h, now, second) = g + length * step, new
    info |= {"goal": dict(zip(used, goal.tolist(), strict=True)), "reached": dict(zip(used, now.tolist(), strict=True)), "met": bool(np.abs(now - goal).sum() <= tolerance * np.abs(goal).sum())}
    return [spread(g)], info


def _held(table: DataFrame, domains: list[str]) -> tuple[set[str], list[float]]:
    """The domains that are the most probable one of a row with words, and the expected tokens of all."""
    top = F.greatest(*[F.col(f"p_{k}") for k in domains], F.lit(0.0))
    got = table.agg(*[F.sum(F.col("t") * F.col(f"p_{k}")) for k in domains], *[F.max((F.col("t") > 0) & (F.col(f"p_{k}") >= top)) for k in domains]).first()
    n = len(domains)
    return {k for k, x in zip(domains, got[n:], strict=True) if x}, [float(x or 0) for x in got[:n]]


def copies(r: Column, *key: Column, seed: Column | int = 0) -> Column:
    even = F.pmod(F.xxhash64(F.lit(12), F.lit(seed) if isinstance(seed, int) else seed, *key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(r + even).cast("int")


def _with_held(table: DataFrame, domains: list[str], steps: list[list[float]], info: dict) -> Column:
    """The rate with rows near 1 held at 1 and the others fitted to the rest, or as it is where that meets no targets."""
    plain = rate(domains, steps)
    if not info["met"] or not info["goal"]:
        return plain
    near = F.abs(plain - 1) <= SLACK
    rated = table.withColumn("__tarnfield_near", near)
    kept = rated.filter("__tarnfield_near").agg(*[F.coalesce(F.sum(F.col("t") * F.col(f"p_{k}")), F.lit(0.0)) for k in info["held"]]).first()
    goals = {k: info["goal"][k] - x for k, x in zip(info["held"], kept, strict=True)}
    again, new = fit(rated.filter(~F.col("__tarnfield_near")), domains, dict.fromkeys(domains, 1.0), "", goals=goals)
    miss = {k: abs(new["reached"][k] - goals[k]) for k in goals} if new["reached"] else goals
    if any(abs(x) > 1e-3 * info["goal"][k] for k, x in miss.items()):
        log.info("mixing: no rows are held at one copy; their rest can't meet the targets")
        return plain
    return F.when(near, 1.0).otherwise(rate(domains, again))


def _main_domain(domains: list[str]) -> Column:
    """The number of a row's most probable domain, the first of equals."""
    top = F.greatest(*[F.col(f"p_{k}") for k in domains], F.lit(0.0))
    return reduce(lambda c, i: c.when(F.col(f"p_{domains[i]}") >= top, i), range(1, len(domains)), F.when(F.col(f"p_{domains[0]}") >= top, 0)).otherwise(0)


def _seeds(rated: DataFrame, domains: list[str], info: dict) -> list[int]:
    """The hash for the rows of each most probable domain. Together their realised tokens are nearest to the targets: the
    largest miss, as a share of its goal, can't be lowered by another hash for one of them."""
    best = [0] * len(domains)
    if not info["goal"]:
        return best
    goal = info["reached"]  # where targets can't be met, what the rates give
    aims = np.array(list(goal.values()))
    whole = F.col("rate") == F.floor("rate")
    token = lambda k: F.col("t") * F.col(f"p_{k}")
    fixed = rated.filter(whole).agg(*[F.coalesce(F.sum(F.col("rate") * token(k)), F.lit(0.0)) for k in goal]).first()
    each = rated.filter(~whole).withColumn("__tarnfield_own", _main_domain(domains)).select("*", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("__tarnfield_seed"))
    n = copies(F.col("rate"), F.col("doc_id"), F.col("h"), seed=F.col("__tarnfield_seed"))
    tokens = np.zeros((len(domains), SEEDS, len(aims)))
    for r in each.groupBy("__tarnfield_own", "__tarnfield_seed").agg(*[F.sum(n * token(k)) for k in goal]).collect():  # SEEDS rows a domain
        tokens[r[0], r[1]] = r[2:]
    changed = True
    while changed:
        changed = False
        for d in range(len(domains)):
            others = np.array(fixed) + sum(tokens[e, best[e]] for e in range(len(domains)) if e != d)
            miss = (np.abs(others + tokens[d] - aims) / np.maximum(aims, 1e-9)).max(axis=1)
            if (low := int(np.argmin(miss))) != best[d] and miss[low] < miss[best[d]]:
                best[d], changed = low, True
    return best


def _fitted(docs: DataFrame, labels: DataFrame, keep: dict[str, Column], targets: dict[str, float], anchor: str):
    """`keep`, doc_id, h, t, p_<domain> of every row as a written table, and its rate; texts are classified once."""
    domains = list(targets)
    model = learn(docs, labels.select("doc_id", domain_of().alias("domain")), domains)
    key = {"doc_id": F.col("doc_id").cast("long"), "h": F.xxhash64(text_of())}
    table = stored(with_posteriors(docs, model, **keep, **key), "posteriors")
    steps, info = fit(table, domains, targets, anchor)
    if missing := sorted(set(domains) - set(info["held"])):
        log.warning("mixing: no document is of %s; the targets are those of the other domains", ", ".join(missing))
    if not info["met"]:
        log.warning("mixing: targets can't be reached: goal %s, reached %s", info["goal"], info["reached"])
    out = table.withColumn("rate", _with_held(table, domains, steps, info))
    seeds = _seeds(out.select("doc_id", "h", "t", "rate", *[f"p_{k}" for k in domains]), domains, info)
    n = copies(F.col("rate"), F.col("doc_id"), F.col("h"), seed=F.get(F.lit(seeds), _main_domain(domains)))
    return domains, out.withColumn("copies", n)


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "good") -> DataFrame:
    """doc_id, n_words, p_<domain>, rate, copies for every row."""
    domains, out = _fitted(docs, labels, {}, targets, anchor)
    return out.select("doc_id", F.col("t").cast("long").alias("n_words"), *[f"p_{k}" for k in domains], "rate", "copies")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "good") -> DataFrame:
    """The rows of docs, all columns, each as often as its copies."""
    _, out = _fitted(docs, labels, {"row": F.struct(*docs.columns)}, targets, anchor)
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
