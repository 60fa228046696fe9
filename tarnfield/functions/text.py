"""Escapes, keys, passwords and text rules as column expressions."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import ascii_plain

#: Characters that a line of text can't hold as they are, and what stands for them, in order.
ESCAPES = [("&", "&#38;"), ("\\", "&#92;"), ("|", "&#124;"), ("=", "&#61;"), ("\x1e", "&#30;"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")]


def char_escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(c, F.lit("")))


def char_unescape(c: Column) -> Column:
    """The ampersand last, so that an escaped escape comes back as what it was; a doubled backslash is one."""
    back = [e for e in reversed(ESCAPES) if e[0] not in "&\\"] + [("\\", "&#92;"), ("&", "&#38;")]
    decoded = lambda x: reduce(lambda y, e: F.replace(y, F.lit(e[1]), F.lit(e[0])), back, x)
    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), r"\\\\", -1), decoded), "\\")


def uri_encode(c: Column) -> Column:
    """All but letters, digits and -_.~ as %XX of their UTF-8."""
    coded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def uri_decode(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def key_encode(c: Column) -> Column:
    """A key's letters, digits and underscores, accents taken off."""
    text = c.cast("string")
    return F.when(text.rlike(r"[^a-zA-Z0-9_]"), F.regexp_replace(ascii_plain(text), r"[^a-zA-Z0-9_]", "")).otherwise(text)


def utf_encode(c: Column, charset: str = "UTF-8") -> Column:
    return F.encode(c, charset)


def utf_decode(c: Column, charset: str = "UTF-8") -> Column:
    return F.decode(c, charset)


def hash_password(password: str, salt: str | None = None) -> str:
    """sha256$salt$hash; nothing for no password."""
    if not password:
        return ""
    salt = secrets.token_hex(8) if salt is None else salt
    return f"sha256${salt}${hashlib.sha256((salt + password).encode()).hexdigest()}"


def verify_password(password: str | None, stored: str | None) -> bool:
    """Anything goes where none is stored."""
    if not stored:
        return True
    kind, _, rest = stored.partition("$")
    salt, _, want = rest.partition("$")
    if not want:
        return False
    if kind != "sha256":
        return hmac.compare_digest(stored, password or "")
    return hmac.compare_digest(hashlib.sha256((salt + (password or "")).encode()).hexdigest(), want.lower())


def hashed(password: Column, salt: Column) -> Column:
    return F.when(F.coalesce(password, F.lit("")) == "", "").otherwise(F.concat(F.lit("sha256$"), salt, F.lit("$"), F.sha2(F.concat(salt, password), 256)))


def text_rules(c: Column, rules: list[dict], preprocess: list[tuple[str, str]] = ()) -> Column:
    """A struct of the rules' fields and raw_features. A rule has a field and one of
    map: [(pattern, value), ...], the first that is found;
    match: pattern whose first group is the value, as `type` integer, titlecase, trim or as it is;
    match_all: pattern whose numbers' largest (select "max") or smallest is the value."""
    text = reduce(lambda x, m: F.replace(x, F.lit(m), F.lit(" ")), ("\\n", "\\r", "\\t"), F.regexp_replace(c, r"(?i)<br\s*/?>", " "))
    text = reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), preprocess, text)
    out = []
    for r in rules:
        if "map" in r:
            v = F.coalesce(*[F.when(text.rlike(p), F.lit(str(to))) for p, to in r["map"]])
        elif "match_all" in r:
            found = F.transform(F.regexp_extract_all(text, F.lit(r["match_all"]), F.lit(1)), lambda x: x.try_cast("double"))
            best = (F.array_min if r.get("select", "max") == "min" else F.array_max)(found)
            v = F.when(best == F.floor(best), F.floor(best).cast("string")).otherwise(best.cast("string"))
        else:
            got = F.when(text.rlike(r["match"]), F.regexp_extract(text, r["match"], 1))
            kind = r.get("type", "")
            v = {"integer": got.try_cast("bigint").cast("string"), "titlecase": F.concat(F.upper(F.substring(got, 1, 1)), F.lower(F.substring(got, 2, 1 << 30))), "trim": F.regexp_replace(got, r"^\s+|\s+$", "")}.get(kind, got)
        out.append(v.alias(r["field"]))
    return F.struct(*out, c.alias("raw_features"))
