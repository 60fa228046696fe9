"""Language tables: letters, casing, transliteration, number words, names and formats (CLDR-style facts)."""

from __future__ import annotations

#: Fixed values, all of this file: letters, names, words and forms that results must agree with.
_EN_DOUBLES = [("bb", "b"), ("dd", "d"), ("ff", "f"), ("gg", "g"), ("ll", "l"), ("mm", "m"), ("nn", "n"), ("pp", "p"), ("rr", "r"), ("ss", "s"), ("tt", "t"), ("zz", "z")]
_EN_MONTHS = "January February March April May June July August September October November December".split()
_EN_DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
_TURKIC_ACCENTS = dict(zip("âÂàÀáÁêÊèÈéÉîÎìÌíÍôÔòÒóÓûÛùÙúÚ", "aAaAaAeEeEeEiİiİiİöÖoOoOuUuUuU", strict=True))


def _formats(short: str, medium: str, long: str, full: str) -> dict[str, str]:
    return {"short": short, "medium": medium, "long": long, "full": full, "time": "HH:mm", "datetime": f"{short} HH:mm"}


def _words(zero, ones, tens, hundred, thousand, million, billion, main, sub, bare_hundred=False, bare_thousand=False, negative="Minus"):
    return {"zero": zero, "ones": ones.split(), "tens": tens.split(), "units": (hundred, thousand, million, billion), "main": main, "sub": sub, "bare_hundred": bare_hundred, "bare_thousand": bare_thousand, "negative": negative}


_ENGLISH = {
    "phonetic": _EN_DOUBLES,
    "words": _words("Zero", "One Two Three Four Five Six Seven Eight Nine", "Ten Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety", "Hundred", "Thousand", "Million", "Billion", "USD", "cent"),
    "decimal": ".", "group": ",", "currency": "USD", "suffix": False, "gap": False, "months": _EN_MONTHS, "days": _EN_DAYS, "plural": {"one": "n == 1"},
}
#: Latin letters of two blocks without the signs for times and divided by, and six more.
_LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7)) + "ȘșȚțƏə"

LANGUAGES: dict[str, dict] = {
    "en": _ENGLISH | {"dates": _formats("MM/DD/YYYY", "MMM D, YYYY", "MMMM D, YYYY", "dddd, MMMM D, YYYY")},
    "gb": _ENGLISH
    | {
        "lower": {"İ": "i"}, "letters": _LATIN, "dates": _formats("YYYY-MM-DD", "D MMM YYYY", "D MMMM YYYY", "dddd, D MMMM YYYY"),
        "ascii": {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ə": "e", "Ə": "E"},
    },
    "tr": {
        "upper": {"i": "İ"}, "lower": {"I": "ı", "İ": "i"}, "letters": "çÇğĞıIİöÖşŞüÜ", "accents": _TURKIC_ACCENTS, "ascii": {"ı": "i"}, "phonetic": [("b$", "p"), ("d$", "t"), ("g$", "k")],
        "words": _words("Sıfır", "Bir İki Üç Dört Beş Altı Yedi Sekiz Dokuz", "On Yirmi Otuz Kırk Elli Altmış Yetmiş Seksen Doksan", "Yüz", "Bin", "Milyon", "Milyar", "TL", "KR", True, True, "Eksi"),
        "decimal": ",", "group": ".", "currency": "TRY", "suffix": False, "gap": False,
        "months": "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık".split(), "days": "Pazar Pazartesi Salı Çarşamba Perşembe Cuma Cumartesi".split(),
        "dates": _formats("DD.MM.YYYY", "D MMM YYYY", "D MMMM YYYY", "dddd, D MMMM YYYY"), "plural": {"one": "n == 1"},
        "search": {c: f"[{c}{d}]" for a, b in ("çÇ", "ğĞ", "ıI", "iİ", "öÖ", "üÜ", "şŞ") for c, d in ((a, b), (b, a))},
    },
    "az": {
        "upper": {"i": "İ"}, "lower": {"I": "ı", "İ": "i"}, "letters": "çÇğĞıIİöÖşŞüÜəƏ", "accents": _TURKIC_ACCENTS, "ascii": {"ə": "e", "Ə": "E", "Ǝ": "E", "ı": "i"}, "phonetic": [("d[dt]", "tt"), ("b$", "p"), ("d$", "t"), ("g$", "k")],
        "words": _words("Sıfır", "Bir İki Üç Dörd Beş Altı Yeddi Səkkiz Doqquz", "On İyirmi Otuz Qırx Əlli Altmış Yetmiş Səksən Doxsan", "Yüz", "Min", "Milyon", "Milyard", "AZN", "qəpik", True, True),
        "decimal": ",", "group": ".", "currency": "AZN", "suffix": True, "gap": True,
        "months": "Yanvar Fevral Mart Aprel May İyun İyul Avqust Sentyabr Oktyabr Noyabr Dekabr".split(), "days": ["Bazar", "Bazar ertəsi", "Çərşənbə axşamı", "Çərşənbə", "Cümə axşamı", "Cümə", "Şənbə"],
        "dates": _formats("DD.MM.YYYY", "D MMM YYYY", "D MMMM YYYY", "dddd, D MMMM YYYY"), "plural": {"one": "n == 1"},
    },
    "de": {
        "upper": {"ß": "SS"}, "letters": "äÄöÖüÜß", "ascii": {"ä": "ae", "Ä": "AE", "ö": "oe", "Ö": "OE", "ü": "ue", "Ü": "UE", "ß": "ss"}, "phonetic": [("b$", "p"), ("d$", "t"), ("g$", "k"), ("v$", "f")],
        "words": _words("Null", "Eins Zwei Drei Vier Fünf Sechs Sieben Acht Neun", "Zehn Zwanzig Dreißig Vierzig Fünfzig Sechzig Siebzig Achtzig Neunzig", "Hundert", "Tausend", "Million", "Milliarde", "EUR", "Cent"),
        "decimal": ",", "group": ".", "currency": "EUR", "suffix": True, "gap": True,
        "months": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(), "days": "Sonntag Montag Dienstag Mittwoch Donnerstag Freitag Samstag".split(),
        "dates": _formats("DD.MM.YYYY", "D. MMM YYYY", "D. MMMM YYYY", "dddd, D. MMMM YYYY"), "plural": {"one": "n == 1"},
    },
    "fr": {
        "letters": "àÀâÂæÆçÇèÈéÉêÊëËîÎïÏôÔœŒùÙûÛüÜÿŸ", "ascii": {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}, "phonetic": [("es$", "e"), ("s$", ""), ("x$", "")],
        "words": _words("Zéro", "Un Deux Trois Quatre Cinq Six Sept Huit Neuf", "Dix Vingt Trente Quarante Cinquante Soixante Soixante-Dix Quatre-Vingt Quatre-Vingt-Dix", "Cent", "Mille", "Million", "Milliard", "EUR", "centime", True, True),
        "decimal": ",", "group": " ", "currency": "EUR", "suffix": True, "gap": True,
        "months": "Janvier Février Mars Avril Mai Juin Juillet Août Septembre Octobre Novembre Décembre".split(), "days": "Dimanche Lundi Mardi Mercredi Jeudi Vendredi Samedi".split(),
        "dates": _formats("DD/MM/YYYY", "D MMM YYYY", "D MMMM YYYY", "dddd D MMMM YYYY"), "plural": {"one": "n <= 1"},
    },
    "es": {
        "letters": "áÁéÉíÍóÓúÚüÜñÑ¿¡", "ascii": {"ñ": "n", "Ñ": "N"}, "phonetic": [("d$", "t")],
        "words": _words("Cero", "Uno Dos Tres Cuatro Cinco Seis Siete Ocho Nueve", "Diez Veinte Treinta Cuarenta Cincuenta Sesenta Setenta Ochenta Noventa", "Ciento", "Mil", "Millón", "Billón", "EUR", "céntimo", True, True),
        "decimal": ",", "group": ".", "currency": "EUR", "suffix": True, "gap": True,
        "months": "Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Octubre Noviembre Diciembre".split(), "days": "Domingo Lunes Martes Miércoles Jueves Viernes Sábado".split(),
        "dates": _formats("DD/MM/YYYY", "D MMM YYYY", "D MMMM YYYY", "dddd, D MMMM YYYY"), "plural": {"one": "n == 1"},
    },
    "ru": {
        "letters": "Ѐ-ӿ",
        "words": _words("Ноль", "Один Два Три Четыре Пять Шесть Семь Восемь Девять", "Десять Двадцать Тридцать Сорок Пятьдесят Шестьдесят Семьдесят Восемьдесят Девяносто", "Сто", "Тысяча", "Миллион", "Миллиард", "RUB", "копейка", True, True),
        "decimal": ",", "group": " ", "currency": "RUB", "suffix": True, "gap": True,
        "months": "Январь Февраль Март Апрель Май Июнь Июль Август Сентябрь Октябрь Ноябрь Декабрь".split(), "days": "Воскресенье Понедельник Вторник Среда Четверг Пятница Суббота".split(),
        "dates": _formats("DD.MM.YYYY", "D MMM YYYY г.", "D MMMM YYYY г.", "dddd, D MMMM YYYY г."),
        "plural": {"one": "n % 10 == 1 and n % 100 != 11", "few": "2 <= n % 10 <= 4 and not 10 <= n % 100 < 20", "many": "n % 10 == 0 or 5 <= n % 10 <= 9 or 11 <= n % 100 <= 14"},
    },
    "ar": {
        "letters": "؀-ۿ",
        "words": _words("صفر", "واحد اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة", "عشرة عشرون ثلاثون أربعون خمسون ستون سبعون ثمانون تسعون", "مائة", "ألف", "مليون", "مليار", "SAR", "هللة", True, True),
        "decimal": "٫", "group": "٬", "currency": "SAR", "suffix": True, "gap": True,
        "months": "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر".split(), "days": "الأحد الإثنين الثلاثاء الأربعاء الخميس الجمعة السبت".split(),
        "dates": _formats("DD/MM/YYYY", "D MMM YYYY", "D MMMM YYYY", "dddd، D MMMM YYYY"),
        "plural": {"zero": "n == 0", "one": "n == 1", "two": "n == 2", "few": "3 <= n % 100 <= 10", "many": "11 <= n % 100 <= 99"},
    },
    "ja": {
        "letters": "぀-ゟ゠-ヿ一-龯＀-￯",
        "words": _words("零", "一 二 三 四 五 六 七 八 九", "十 二十 三十 四十 五十 六十 七十 八十 九十", "百", "千", "百万", "十億", "円", "銭", True, True),
        "decimal": ".", "group": ",", "currency": "JPY", "suffix": False, "gap": False,
        "months": [f"{m}月" for m in range(1, 13)], "days": [f"{d}曜日" for d in "日月火水木金土"],
        "dates": _formats("YYYY/MM/DD", "YYYY年M月D日", "YYYY年MM月DD日", "YYYY年MM月DD日(dddd)"), "plural": {},
    },
}
DEFAULT = "gb"

#: ISO 4217: code -> (number, name, symbol, digits).
CURRENCIES: dict[str, tuple[str, str, str, int]] = {
    "TRY": ("949", "Turkish Lira", "₺", 2), "USD": ("840", "US Dollar", "$", 2), "EUR": ("978", "Euro", "€", 2), "GBP": ("826", "Pound Sterling", "£", 2),
    "RUB": ("643", "Russian Ruble", "₽", 2), "AZN": ("944", "Azerbaijani Manat", "₼", 2), "SAR": ("682", "Saudi Riyal", "ر.س", 2), "JPY": ("392", "Japanese Yen", "¥", 0),
    "CHF": ("756", "Swiss Franc", "CHF", 2), "CAD": ("124", "Canadian Dollar", "CA$", 2), "AUD": ("036", "Australian Dollar", "A$", 2), "CNY": ("156", "Chinese Yuan", "¥", 2),
}
