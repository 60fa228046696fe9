"""Search words of text columns: the locale's exact code, or built-in functions for columns of short ASCII cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .locales import SPLITTERS, Locale


def _doubles(rules: list[tuple[str, str]]) -> bool:
    """Whether all spelling rules only write a doubled letter once."""
    return all(len(p) == 2 and p == by + by for p, by in rules)


def _spelled(w: Column, rules: list[tuple[str, str]]) -> Column:
    """Lower-case text by a language's spelling rules. Doubled letters don't meet each other, so their rules are one pass."""
    if rules and _doubles(rules):
        return F.regexp_replace(w, "([" + re.escape("".join(by for _, by in rules)) + r"])\1", "$1")
    for pattern, to in rules:
        w = F.regexp_replace(w, f"(?i){pattern}", to)
    return w


def _plain_words(c: Column, locale: Locale, write: bool, min_char: int, stop: list[str]) -> Column:
    """As Locale.words does for a text of ASCII letters without & and <."""
    cut = "[" + re.escape(SPLITTERS) + "]+"
    rules = list(locale.data.get("phonetic", ()))
    if write:
        joint, by = rf"([a-zA-Z]+){cut}([a-zA-Z]+)", "$1 $1$2"
    else:
        joint, by = rf"(?<![a-zA-Z])([a-zA-Z]){cut}([a-zA-Z]+)|([a-zA-Z]{{2,}}){cut}[a-zA-Z]+", "$1$2$3"

    def cleaned(w: Column) -> Column:
        w = F.trim(F.regexp_replace(F.lower(w), r"[^a-zA-Z0-9&.,_\-]+", " "))
        w = _spelled(w, rules)
        return F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", "")

    long = lambda w: F.char_length(w) >= min_char
    tokens = F.filter(F.split(c, r"\s+"), long)
    parts = F.flatten(F.transform(tokens, lambda t: F.split(F.regexp_replace(t, joint, by), " ")))
    words = F.flatten(F.transform(parts, lambda w: F.split(cleaned(w), " ")))
    if _doubles(rules) and min_char > 0:  # letters, digits and blanks only: nothing to part or to clean
        words = F.when(c.rlike(r"^[a-zA-Z0-9\s]*$"), F.split(_spelled(F.lower(c), rules), r"\s+")).otherwise(words)
    words = F.array_distinct(F.filter(words, long))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def words(c: Column, locale: Locale, write: bool = False, min_char: int = 2, stop_words: str = "") -> Column:
    """Distinct search words of a text, in order; none of a null."""
    return locale.words_column(F.coalesce(c.cast("string"), F.lit("")), write, min_char, stop_words)


def holds(c: Column, locale: Locale, wanted: list[str], write: bool = True, min_char: int = 2, stop_words: str = "") -> Column:
    """Which of the wanted words a text has, as one bit each: Python sends back a number for a text and not its words."""
    import pyarrow as pa

    from .locales import locale as of_tag

    tag, stop, wanted = locale.language, frozenset(locale.stop_words(stop_words)), list(wanted)

    def of(values: pa.Array) -> pa.Array:
        own, out = of_tag(tag), []
        may = own.hint(tuple(wanted))
        for v in values.to_pylist():
            near = " ".join(filter(may, dict.fromkeys(v.split())))
            have = set(own.words(near, write, min_char, stop)) if near else ()
            out.append(sum(1 << i for i, w in enumerate(wanted) if w in have))
        return pa.array(out, pa.int64())

    of.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "long")(F.coalesce(c.cast("string"), F.lit("")))


def ascii_words(c: Column, locale: Locale, write: bool = False, min_char: int = 2, stop_words: str = "") -> Column:
    """The same for short cells known to be ASCII without & and <, in a language that leaves ASCII letters as they are but
    for lower case and spelling: no Python at all."""
    return _plain_words(F.coalesce(c.cast("string"), F.lit("")), locale, write, min_char, sorted(locale.stop_words(stop_words)))
