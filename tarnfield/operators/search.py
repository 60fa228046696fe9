"""Full-text search over a table's search blocks, and suggestions while typing.

Words are compared exactly after normalisation. Without word lists a search is a scan that turns no row into several:
each row's words are made once a block and asked for the query's words, so there is no shuffle. With word lists
(plans.index) only the query's words are read from them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..spec import choices_of, order_of
from . import core
from .core import Page, Table

PREFIXES = 10
NEXT_WORDS = 300


def query_words(table: Table, query: str | None) -> list[str]:
    s = table.spec
    return table.locale.words(query, False, s.min_char, table.locale.stop_words(s.stop_words))


def _search_blocks(table: Table) -> list[tuple[int, str | None, int | str]]:
    """Block, the table whose text stands for it, and the block shown of that table."""
    out = []
    for b in table.spec.search:
        if isinstance(b, (tuple, list)):
            out.append((table.spec.resolve(b[0]), b[1], b[2] if len(b) > 2 else 1))
        else:
            at = table.spec.resolve(b)
            link = table.spec.blocks[at].link
            out.append((at, link.table if link else None, link.display if link else 1))
    return out


def with_texts(table: Table, df: DataFrame | None = None) -> tuple[DataFrame, dict[int, Column]]:
    """df with helper columns, and each search block's text: of links the shown texts of what the cell leads to."""
    df = table.df if df is None else df
    texts: dict[int, Column] = {}
    for at, target, shown in _search_blocks(table):
        own = table.column(at)
        if target is None or target not in table.others:
            texts[at] = F.concat_ws(" ", core.values_of(table, at)) if table.kind(at).typeName() == "array" else F.col(own)
            continue
        from .link import shown_texts

        name = f"__text{at}"
        df = shown_texts(table, df, at, table.others[target], shown, name)
        texts[at] = F.concat_ws(" ", name)
    if not texts:  # no search block: all plain fields but the id, as one text
        plain = [b.id for b in table.spec.blocks[1:] if b.id in table.df.columns and table.df.schema[b.id].dataType.typeName() not in ("array", "map", "struct")]
        texts[-1] = F.concat_ws(" ", *[F.col(c).cast("string") for c in plain])
    return df, texts


def word_column(table: Table, text: Column, write: bool = True) -> Column:
    s = table.spec
    make = W.ascii_words if s.extra.get("ascii_text") else W.words
    return make(text, table.locale, write, s.min_char, s.stop_words)


def tokens(table: Table) -> DataFrame:
    """block, word, tier, id: the word lists of all search blocks."""
    df, texts = with_texts(table, core.with_tier(table))
    parts = F.array(*[F.struct(F.lit(b).alias("block"), word_column(table, t).alias("ws")) for b, t in texts.items()])
    rows = df.select(F.col(table.id), F.col(core.TIER).alias("tier"), F.explode(parts).alias("p")).select("p.block", F.explode("p.ws").alias("word"), "tier", table.id)
    return rows


def _matching(table: Table, ws: list[str], mode: str, per_block: bool, blocks: Iterable[int] | None = None) -> DataFrame:
    """The rows that hold the words: anywhere in the search blocks, or all in one block."""
    if not ws:
        return table.df.filter(F.lit(False))
    need = len(ws) if mode == "and" else 1
    if table.tokens is not None:
        hits = table.tokens.filter(F.col("word").isin(ws))
        if blocks is not None:
            hits = hits.filter(F.col("block").isin([*blocks]))
        keys = [table.id, "block"] if per_block else [table.id]
        ids = hits.groupBy(*keys).agg(F.count_distinct("word").alias("n")).filter(F.col("n") >= need).select(table.id).distinct()
        return table.df.join(ids, table.id, "left_semi")
    df, texts = with_texts(table)
    if blocks is not None:
        texts = {b: t for b, t in texts.items() if b in set(blocks)}
    own = table.df.columns
    named = {b: f"__w{b if b >= 0 else 'all'}" for b in texts}
    join = (lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b)
    if table.spec.extra.get("ascii_text") or len(ws) > 62:
        df = df.select(*own, *[word_column(table, t).alias(named[b]) for b, t in texts.items()])
        held = lambda b, w: F.array_contains(named[b], w)
    else:
        s = table.spec
        df = df.select(*own, *[W.holds(t, table.locale, ws, True, s.min_char, s.stop_words).alias(named[b]) for b, t in texts.items()])
        held = lambda b, w: F.col(named[b]).bitwiseAND(F.lit(1 << ws.index(w))) != 0
    if per_block:
        test = reduce(lambda a, b: a | b, [reduce(join, [held(b, w) for w in ws]) for b in texts])
    else:
        test = reduce(join, [reduce(lambda a, b: a | b, [held(b, w) for b in texts]) for w in ws])
    return df.filter(test).select(*own)


def search_table(table: Table, query: str, mode: str = "and", offset: int = 0, limit: int = 0, *, filter: dict | None = None, sort=None, dir: str | None = None, keys_only: bool = False, tier: str | None = None, base_ids=None) -> Page:
    """Rows that hold all words of the query (or some, with "or"), each in any search block; then filters, order, page."""
    df = core.restricted(table, _matching(table, query_words(table, query), mode.lower(), False), base_ids)
    for b, v in choices_of(table.spec, filter).items():
        df = df.filter(core.choice(table, b, v))
    if (inside := core.range_condition(table, filter)) is not None:
        df = df.filter(inside)
    df, _ = core.in_tier(table, df, tier)
    return core.paged(table, df, order_of(sort, dir), "", offset, limit, keys_only)


def read_search(table: Table, query: str, blocks: Iterable[int | str] | None = None, cross_block: bool = False) -> DataFrame:
    """The ids of rows with all words in one block (or, cross_block, anywhere in the blocks)."""
    places = None if blocks is None else [table.spec.resolve(b) for b in blocks]
    return _matching(table, query_words(table, query), "and", not cross_block, places).select(table.id)


def search_string(table: Table, text: Column, query: str) -> Column:
    """Whether a text holds all words of the query."""
    ws = query_words(table, query)
    have = word_column(table, text)
    return reduce(lambda a, b: a & b, [F.array_contains(have, w) for w in ws]) if ws else F.lit(False)


# -- suggestions

_MARKS = r"""[.,:;()\[\]{}"“”?!\\/&_+*~^%#@=<>|]"""
_LONE = r"(?:^|\s)[-'’‘′ʼ]+(?=\s|$)"


def sentences(table: Table) -> DataFrame:
    """sentence: of each row the suggest blocks' values, values joined, and the joined pairs of suggest_join."""
    s = table.spec
    df = table.df
    left = {s.resolve(j[0]) for j in s.suggest_join}
    parts: dict[int, Column] = {}
    for b in s.suggest:
        real, target, shown = (s.resolve(b[0]), b[1], b[2] if len(b) > 2 else 1) if isinstance(b, (tuple, list)) else (s.resolve(b), None, 1)
        if target is None and s.blocks[real].link:
            target, shown = s.blocks[real].link.table, s.blocks[real].link.display
        c = F.col(table.column(real)).cast("string") if table.kind(real).typeName() != "array" else F.concat_ws(",", table.column(real))
        if target in table.others:
            from .link import shown_texts

            df = shown_texts(table, df, real, table.others[target], shown, f"__s{real}")
            parts[real] = F.col(f"__s{real}")
            continue
        whole = F.trim(F.coalesce(c, F.lit("")))
        split = F.filter(F.split(whole, r"\s*[,;]\s*"), lambda x: x != "")
        several = whole.rlike(r"^\d+(\s*[,;]\s*\d+)+$")
        if real in left:
            several = several | whole.rlike("[,;]")
        parts[real] = F.when(whole == "", F.array().cast("array<string>")).when(several, split).otherwise(F.array(whole))
    made = []
    for p in parts.values():
        made += [p, F.when(F.size(p) > 1, F.array(F.array_join(p, " "))).otherwise(F.array().cast("array<string>"))]
    for j in s.suggest_join:
        a, b = parts.get(s.resolve(j[0])), parts.get(s.resolve(j[1]))
        if a is None or b is None:
            continue
        lead = F.concat(a, F.when(F.size(a) > 1, F.array(F.array_join(a, " "))).otherwise(F.array().cast("array<string>")))
        made.append(_crossed(lead, b))
    all_of = F.array_distinct(F.concat(*made))
    return df.select(F.explode(F.filter(all_of, lambda x: F.char_length(x) >= 2)).alias("sentence"))


def _crossed(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws(" ", x, y))))


@dataclass(frozen=True)
class Suggestions:
    #: prefix, word, n, rank
    prefixes: DataFrame
    #: word, next, next_ascii, n, rank
    transitions: DataFrame


def suggestions(table: Table, top: int = PREFIXES, top_next: int = NEXT_WORDS) -> Suggestions:
    """Prefixes of 2 to 12 letters with their most frequent words, and words with those that most often follow them.

    Each different sentence is cut into words once, however many rows have it. Frequencies are counted before prefixes are
    spread out, so a frequent word is one row by then."""
    L = table.locale
    clean = F.regexp_replace(F.regexp_replace("sentence", _MARKS, " "), _LONE, " ")
    raw = F.transform(F.split(clean, r"\s+"), lambda w: F.regexp_replace(w, r"(?U)^[^\w\x80-\xff]+|[^\w\x80-\xff]+$", ""))
    text = F.array_join(F.filter(raw, lambda w: F.char_length(w) >= 2), "\n")
    lists = F.filter(F.transform(F.split(L.column("suggest_words", text), "\n"), lambda x: F.filter(F.split(x, " "), lambda w: F.char_length(w) >= 2)), lambda x: F.size(x) > 0)
    rows = sentences(table).groupBy("sentence").agg(F.count("*").alias("times")).select(lists.alias("ws"), "times")
    freq = rows.select(F.explode(F.flatten("ws")).alias("word"), "times").groupBy("word").agg(F.sum("times").alias("n")).withColumn("ascii", L.column("to_ascii", F.col("word")))
    ends = lambda c: F.transform(F.sequence(F.lit(2), F.least(F.lit(12), F.char_length(c))), lambda k: F.substring(c, F.lit(1), k))
    two = lambda c: F.when(F.char_length(c) >= 2, ends(c)).otherwise(F.array().cast("array<string>"))
    each = freq.select("word", "n", F.explode(F.array_distinct(F.concat(two(F.col("word")), two(F.col("ascii"))))).alias("prefix"))
    rank = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("word" if key == "prefix" else "next")))
    prefixes = each.withColumn("rank", rank("prefix")).filter(F.col("rank") <= top).select("prefix", "word", "n", "rank")
    follow = rows.select(F.explode(F.transform(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get("ws", i + 1).alias("b")))).alias("p"), "times")
    pairs = follow.select(F.explode("p.a").alias("word"), "p.b", "times").select("word", F.explode("b").alias("next"), "times").groupBy("word", "next").agg(F.sum("times").alias("n"))
    pairs = pairs.withColumn("ascii", L.column("to_ascii", F.col("word")))
    keys = F.when(F.col("ascii") != F.col("word"), F.array("word", "ascii")).otherwise(F.array("word"))
    pairs = pairs.select(F.explode(keys).alias("word"), "next", "n").groupBy("word", "next").agg(F.sum("n").alias("n"))
    transitions = pairs.withColumn("rank", rank("word")).filter(F.col("rank") <= top_next).select("word", "next", L.column("to_ascii", F.col("next")).alias("next_ascii"), "n", "rank")
    return Suggestions(prefixes, transitions)


def suggest_table(table: Table, index: Suggestions, query: str, limit: int = 10) -> list[str]:
    """Completions of the last word of what was typed, or the words that follow it."""
    typed = query.lstrip()
    L = table.locale
    ws = L.to_ascii(L.lower(typed)).lstrip(".,-_& ").split() if typed else []
    if not ws:
        return []
    if len(ws) == 1 and not typed[-1].isspace():
        if len(ws[0]) < 2:
            return []
        return [r["word"] for r in index.prefixes.filter(F.col("prefix") == ws[0]).orderBy("rank").limit(limit).collect()]
    if typed[-1].isspace():
        before, begin, lead = ws[-1], "", typed
    else:
        before, begin, lead = ws[-2], ws[-1], typed[: len(typed) - len(typed.split()[-1])]
    found = index.transitions.filter((F.col("word") == before) & F.col("next_ascii").startswith(begin)).orderBy("rank").limit(limit)
    return [lead + r["next"] for r in found.collect()]
