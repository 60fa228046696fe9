"""Scalars: locales, dates, arrays, text."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfield.functions import arrays, cells, dates, text, words
from tarnfield.functions.locales import currencies, currency, locale


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_casing_and_words():
    tr, gb = locale("tr"), locale("gb")
    assert tr.upper("ışık") == "IŞIK" and tr.upper("istanbul") == "İSTANBUL" and tr.lower("İZMİR") == "izmir" and tr.lower("IĞDIR") == "ığdır"
    assert tr.normalize_word("Türkiye'de", True) == "turkiye turkiyede" and tr.normalize_word("Türkiye'de") == "turkiye"
    assert tr.equal("IĞDIR", "ığdır") and not tr.equal("a", None) and tr.equal(None, None)
    assert gb.words("The QUICK quick a letter's", True) == ["the", "quick", "leter", "leters"] and gb.words(None) == []
    assert gb.words("the cat", stop=gb.stop_words("The")) == ["cat"]
    assert gb.normalize("a &amp; <b>x</b>") == "a & x" and gb.to_ascii("Über Café", slug=True) == "uber-cafe"


def test_number_words_and_formats():
    tr = locale("tr")
    assert tr.num2text("-5") == "Eksi Beş TL" and tr.num2text("9.99") == "On TL" and tr.num2text("1.234,56") == "Bin İki Yüz Otuz Dört TL Elli Altı KR" and tr.num2text("abc") == "Sıfır"
    assert tr.format_number("1234567.89") == "1.234.567,89" and locale("en").format_number("1234567.89") == "1,234,567.89"
    assert tr.format_currency("1250.5") == "₺1.250,50" and locale("de").format_currency("1250.5") == "1.250,50 €"
    assert currency("eur")["symbol"] == "€" and "USD" in currencies()
    assert locale("en").plural(1, {"one": "{count} row", "other": "{count} rows"}) == "1 row"
    assert locale("en").plural(1200, {"one": "{count} row", "other": "{count} rows"}) == "1,200 rows"
    assert locale("en").format_date("2026-08-22") == "08/22/2026" and locale("en").parse_date("08/22/2026").day == 22 and tr.parse_date("22.08.2026").month == 8


def test_dates(spark):
    assert one(spark, dates.str2dateid(F.lit("2026-08-22"))) == one(spark, dates.str2dateid(F.lit("22/08/2026"))) == "20260822"
    assert one(spark, dates.str2dateid(F.lit("22.8.2026 9:05"))) == "20260822090500" and one(spark, dates.str2dateid(F.lit("soon"))) == ""
    assert one(spark, dates.dateid2str(F.lit("20260822"))) == "22/08/2026" and one(spark, dates.dateid2str(F.lit("202608"))) == "August 2026"
    assert one(spark, dates.day_range(F.lit("20260801"), F.lit("20260805"))) == ["20260801", "20260802", "20260803", "20260804", "20260805"]
    assert one(spark, dates.day_range(F.lit("20260805"), F.lit("20260801"))) == []
    assert one(spark, dates.offset2date(F.lit("2026-03-01").cast("date"), "-7D")) == "20260222"


def test_arrays(spark):
    a, b = F.lit([1, 2, 2, 3]), F.lit([3, 2])
    assert one(spark, arrays.nodup(F.lit(["a", "", "a", "b"]))) == ["a", "b"] and one(spark, arrays.crop(a, b)) == [3, 2] and one(spark, arrays.crop_ordered(a, b, 1)) == [2, 3]
    assert one(spark, arrays.punch(a, b)) == [1] and one(spark, arrays.without(F.lit([1, 1, 2]), F.lit([2]))) == [1, 1] and one(spark, arrays.without_positions(a, F.lit([0, 3]))) == [2, 2]
    assert one(spark, arrays.chunks(F.lit(["a", "b", "c"]), 2)) == [["a", "b"], ["c", ""]] and one(spark, arrays.transpose(F.lit([[1, 2], [3, 4]]))) == [[1, 3], [2, 4]]
    assert one(spark, arrays.sort(F.lit(["10", "9", "1,5"]))) == ["1,5", "9", "10"] and one(spark, arrays.sort(F.lit(["b", "a"]), ascending=False)) == ["b", "a"]
    assert one(spark, arrays.key_diff(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(2), F.lit("c"), F.lit(3)))) == {"a": 1, "c": 3}
    assert one(spark, arrays.rank(F.lit([5, 6]), F.lit(6))) == 1 and tuple(one(spark, arrays.extent(F.lit([[1, 2], [3, 4]])))) == (1, 1)


def test_soft_casts_and_comparisons(spark):
    n = lambda v: one(spark, cells.cast_soft(F.lit(v), "num"))
    assert (n(" 12.5 "), n("+3"), n("1e5"), n(""), n("x")) == (12.5, 3.0, 0.0, 0.0, 0.0)
    assert one(spark, cells.cast_soft(F.lit("a,b|c"), "array")) == ["a", "b", "c"] and one(spark, cells.cast_soft(F.lit("junk"), "hash")) == {}
    c = lambda a, op, b: one(spark, cells.compare(F.lit(a), op, b))
    assert c("10", ">", "9") and c("1.0", "eq", "1") and not c("", "ne", "1") and c("b", "ne", "a") and not c("a", "eq", "") and c("5", "<=", "5")
    assert one(spark, cells.trim_space(F.lit("  a ,  b ;c  "))) == "a,b;c"


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF), max_size=40))
def test_escapes_come_back(spark, s):
    assert one(spark, text.uri_decode(text.uri_encode(F.lit(s)))) == s
    got = one(spark, text.char_unescape(text.char_escape(F.lit(s))))
    assert got == s and "\t" not in one(spark, text.char_escape(F.lit(s)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abBdDlLrRxX'-. ,/_1", max_size=30), min_size=1, max_size=20))
def test_plain_words_are_the_exact_ones(spark, texts):
    gb = locale("gb")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for write in (True, False):
        rows = df.select("t", words.ascii_words(F.col("t"), gb, write).alias("w")).collect()
        for r in rows:
            assert sorted(r["w"]) == sorted(gb.words(r["t"], write)), r["t"]


def test_cells_of_plain_words_are_spelled_in_one_pass(spark):
    texts, gb = ["Red BOLT", "hotter  Ballroom\tnn nnn bb", " a aa 12 x1 ", "", "aabbccddd", "off-set small", "ll\n"], locale("gb")
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words.ascii_words(F.col("t"), gb, True).alias("w"))
    assert {r["t"]: sorted(r["w"]) for r in made.collect()} == {t: sorted(gb.words(t, True)) for t in texts}
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 10


def test_passwords_and_rules(spark):
    stored = text.hash_password("geheim")
    assert text.verify_password("geheim", stored) and not text.verify_password("x", stored) and text.verify_password("x", "") and text.hash_password("") == ""
    rules = [{"field": "page_count", "match": r"(\d+) s\.", "type": "integer"}, {"field": "paper_type", "map": [(r"1\. Hamur", "1. Hamur"), (r"2\. Hamur", "2. Hamur")]}, {"field": "publish_year", "match_all": r"((?:19|20)\d\d)"}, {"field": "none", "match": "(zzz)"}]
    r = one(spark, text.text_rules(F.lit("14 x 20 cmTürkçe133 s.İstanbul2. HamurAralık 2002"), rules))
    assert (r["page_count"], r["paper_type"], r["publish_year"], r["none"]) == ("133", "2. Hamur", "2002", None)
    assert one(spark, text.key_encode(F.lit("Çay-1 a"))) == "Cay1a"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("thean dTHÉéÅß&<>'’-.,\u0301 "), max_size=60), st.sampled_from(["en", "de", "fr", "tr"]))
def test_no_word_escapes_the_hint(t, tag):
    own, wanted = locale(tag), ("the", "and", "ante", "head")
    may = own.hint(wanted)
    near = " ".join(filter(may, dict.fromkeys(t.split())))
    assert {w for w in wanted if w in own.words(t, True)} == {w for w in wanted if w in own.words(near, True)}
