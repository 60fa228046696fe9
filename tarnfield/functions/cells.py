"""Column expressions for cells that may hold several values, soft casts, comparisons and sort keys."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StringType

from ..spec import DATES, LISTS, MAPS, NUMERIC, Order, Range

NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"


def trim_space(c: Column, flatten: bool = True) -> Column:
    """Blanks trimmed and squeezed, none around , and ;. Without flatten line feeds and tabs stay, blanks around them go."""
    c = F.regexp_replace(c, " ", " ")
    if flatten:
        squeezed = F.regexp_replace(c, r"\s+", " ")
        return F.trim(F.regexp_replace(squeezed, r" *([,;]) *", "$1"))
    c = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\r\n", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \r\f]+", " "), r" *([,;\n\t]) *", "$1")
    return c


def values(c: Column | str, kind: DataType | None = None) -> Column:
    """The values of a cell: its parts between , or ; trimmed, without empty ones. Arrays give all their leaves."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(kind, ArrayType):
        leaves = c
        inner = kind.elementType
        if isinstance(inner, ArrayType):
            leaves, inner = F.flatten(c), inner.elementType
        if hasattr(inner, "fields"):
            parts = F.flatten(F.transform(leaves, lambda s: F.array(*[s[f.name].cast("string") for f in inner.fields])))
        else:
            parts = leaves.cast("array<string>")
    else:
        parts = F.split(c.cast("string"), "[,;]")
    none = F.array().cast("array<string>")
    if isinstance(kind, NumericType):  # a number is one value
        return F.when(c.isNull(), none).otherwise(F.array(c.cast("string")))
    clean = F.transform(F.filter(parts, lambda x: x.isNotNull()), lambda x: trim_space(x))
    found = F.coalesce(F.filter(clean, lambda x: x != ""), none)
    if isinstance(kind, StringType):  # most cells are one value that needs no trimming
        found = F.when((c != "") & ~c.rlike(r"[,;\u00a0\t\n\x0B\f\r]|^ | $|  "), F.array(c)).otherwise(found)
    return found


def holds_any(c: Column | str, wanted: list[str], kind: DataType | None = None) -> Column:
    """Whether a cell holds one of the values; a null cell doesn't (and is null at most, which no filter lets pass)."""
    if not wanted:
        return F.lit(False)
    if kind is not None and kind.simpleString() in ("int", "bigint", "smallint", "tinyint"):
        # a whole number is one value; compared as it is, the scan can skip row groups
        whole = [int(w) for w in map(str, wanted) if w.lstrip("-").isdigit()]
        return (F.col(c) if isinstance(c, str) else c).isin(whole) if whole else F.lit(False)
    if kind is not None and not isinstance(kind, (StringType, ArrayType)):
        return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string").isin([str(w) for w in wanted]), F.lit(False))
    own = [str(w) for w in wanted]
    overlap = F.coalesce(F.arrays_overlap(values(c, kind), F.array(*map(F.lit, own))), F.lit(False))
    if isinstance(kind, ArrayType):
        return overlap
    # most cells are one value as it stands: only those with separators or odd blanks are taken apart
    cell = (F.col(c) if isinstance(c, str) else c).cast("string")
    plain = [w for w in own if w and not re.search(r"[,;\s]", w)]
    apart = F.coalesce(cell.rlike(r"[,;\s\x{a0}]"), F.lit(False)) & overlap
    return F.coalesce(cell.isin(plain), F.lit(False)) | apart if plain else apart


def first_number(c: Column) -> Column:
    return F.regexp_extract(c.cast("string"), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def in_range(c: Column | str, r: Range, kind: DataType | None = None) -> Column:
    """Bounds included. Text is read as the first number in it; what has none is outside."""
    c = F.col(c) if isinstance(c, str) else c
    name = kind.simpleString() if kind is not None else ""
    number, low, high = first_number(c), r.low, r.high
    if name in ("double", "float", "smallint", "int", "bigint"):
        number = c
    if name in ("smallint", "int", "bigint"):
        # bounds of the column's own type reach the scan
        most = {"smallint": 15, "int": 31, "bigint": 63}[name]
        whole = lambda x, to: int(min(max(to(x), -(1 << most)), (1 << most) - 1))
        if low >= 1 << most or (high is not None and high < -(1 << most)):
            return F.lit(False)
        low = low if math.isinf(low) else F.lit(whole(low, math.ceil)).cast(kind)
        high = None if high is None or math.isinf(high) else F.lit(whole(high, math.floor)).cast(kind)
    if not isinstance(low, Column):
        low = None if low == float("-inf") else F.lit(low)
    inside = number.isNotNull() if low is None else number >= low
    if high is not None:
        inside = inside & (number <= high)
    return inside


def compare(a: Column, op: str, b: str | Column) -> Column:
    """False where either side is empty; by number where both look like one, else by text (eq, ne) or never."""
    a = a.cast("string")
    b = b if isinstance(b, Column) else F.lit(str(b))
    full = F.coalesce((a != "") & (b != ""), F.lit(False))
    shape = r"^-?[0-9.]+$"
    both = a.rlike(shape) & b.rlike(shape)
    x, y = F.coalesce(a.try_cast("double"), F.lit(0.0)), F.coalesce(b.try_cast("double"), F.lit(0.0))
    if op in ("eq", "=="):
        hit = F.when(both, x == y).otherwise(a == b)
    elif op in ("ne", "!="):
        hit = F.when(both, x != y).otherwise(a != b)
    elif op in (">", ">=", "<", "<="):
        hit = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
    else:
        hit = F.lit(False)
    return full & hit


def cast_soft(c: Column, kind: str, valid: str = "", ascii_of=None) -> Column:
    """The value that a block of this type keeps of a text."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    if kind in NUMERIC:
        t = F.trim(text)
        return F.when(t.rlike(NUMBER), t.try_cast("double")).otherwise(F.lit(0.0))
    if kind == "ascii":
        return ascii_of(text) if ascii_of else text
    if kind in DATES:
        return F.when((text == "") & F.lit("auto_date" in valid), F.date_format(F.current_date(), "yyyy-MM-dd")).otherwise(text)
    if kind in LISTS:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"[,|]"))
    if kind in MAPS:
        return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return text


def sort_key(c: Column, kind: str, width: int = 8, ascii_of=None) -> Column:
    """A text that sorts as the value does: numbers and dates in fixed width, other text folded and cut to its width."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    if kind in NUMERIC:
        n = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.try_cast("double")).otherwise(F.lit(0.0))
        return F.format_string("%020.6f", n + F.lit(1e12))
    if kind in DATES:
        from .dates import str2dateid

        d = str2dateid(text)
        return F.when(F.coalesce(d, F.lit("")) == "", F.lit("0" * 14)).otherwise(F.rpad(d, 14, " "))
    folded = ascii_of(text) if ascii_of else ascii_plain(text)
    return F.rpad(F.substring(F.regexp_replace(F.lower(folded), r"[^A-Za-z0-9_]", ""), 1, width), width, " ")


_FROM = "çğıöşüÇĞİÖŞÜâàáäãåêèéëîìíïôòóõûùúñýÿÂÀÁÄÃÅÊÈÉËÎÌÍÏÔÒÓÕÛÙÚÑÝ"
_TO = "cgiosuCGIOSUaaaaaaeeeeiiiioooouuunyyAAAAAAEEEEIIIIOOOOUUUNY"


def ascii_plain(c: Column) -> Column:
    """Accents taken off by whole-character substitution, inside the JVM; the locale's UDF is the exact form."""
    c = F.translate(c, _FROM, _TO)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ø", "o"), ("ð", "d"), ("ł", "l")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def order_columns(order: Order, key: Column, id_column: str) -> list[Column]:
    """Key then id, both in the same direction."""
    return [key.asc(), F.col(id_column).asc()] if order.ascending else [key.desc(), F.col(id_column).desc()]
