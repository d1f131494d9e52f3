"""Numbers as Thai words, eras and currencies: native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saithong.functions.text import DIGIT_WORDS, as_column

#: The names of the places of a group of six digits, from the units on.
PLACES = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]
PLACES_ONE = "เอ็ด"  # one behind another place
MILLION, MINUS, POINT = "ล้าน", "ลบ", "จุด"


def _digits_to_words(digits: Column) -> Column:
    """Words of a whole number given by its digits, with or without a sign, however many.

    A chain of replacements, each used once, so that neither code nor work multiplies: digits are marked with their places in groups of six (a for ones to f, and ; behind a group), zeros go, and what is left is spelled.
    """
    steps = [
        (r"^\+?(-?)0*(\d+)$", "$100000$2"), (r"^(-?)\d*?(?=(?:\d{6})+$)", "$1"),  # whole groups
        (r"(\d)(\d)(\d)(\d)(\d)(\d)", "$1f$2e$3d$4c$5b$6a;"), ("0[a-f]", ""),
        ("(?<=[b-f])1a|(?<=;)1a(?=;$)", PLACES_ONE), ("1b", "b"), ("2b", "ยี่b"), (";$|a", ""), ("^-?$", DIGIT_WORDS[0]),
    ]
    for pattern, to in steps:
        digits = F.regexp_replace(digits, pattern, to)
    names = {str(i): w for i, w in enumerate(DIGIT_WORDS) if i} | dict(zip("bcdef", PLACES[1:], strict=True)) | {";": MILLION, "-": MINUS}
    for mark, name in names.items():
        digits = F.replace(digits, F.lit(mark), F.lit(name))
    return digits


def num_to_thaiword(x: Column | str) -> Column:
    """A whole number in words; null is empty. A text of digits may have any number of them; other numbers are rounded and may have 38."""
    x = as_column(x)
    text = F.trim(x.cast("string"))
    return F.coalesce(_digits_to_words(F.when(text.rlike(r"^[+-]?[0-9]+$"), text).otherwise(x.cast("decimal(38,0)").cast("string"))), F.lit(""))


def bahttext(x: Column | str) -> Column:
    """An amount of money in words, rounded to satang: exactly for decimals and whole numbers of any size. A fraction below zero loses its sign."""
    x = as_column(x)
    shown = F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))
    satang = F.substring_index(shown, ".", -1)
    said = F.concat(F.regexp_replace(_digits_to_words(F.substring_index(shown, ".", 1)), f"^{MINUS}{DIGIT_WORDS[0]}$", DIGIT_WORDS[0]), F.lit("บาท"))
    return F.when(x == 0, "ศูนย์บาทถ้วน").when(satang == "00", F.concat(said, F.lit("ถ้วน"))).otherwise(F.concat(said, _digits_to_words(satang), F.lit("สตางค์")))


def num_to_thaiword_float(x: Column | str) -> Column:
    """A number in words, decimals digit by digit as its shortest decimal form has them. NaN and infinities are errors."""
    x = as_column(x).cast("double")
    plain = F.abs(x).cast("string")  # 1.0E-5, say
    mantissa, exponent = F.regexp_extract(plain, r"^([0-9.]+)", 1), F.coalesce(F.nullif(F.regexp_extract(plain, r"E(-?\d+)$", 1), F.lit("")), F.lit("0")).cast("int")
    whole, part = F.regexp_extract(mantissa, r"^(\d+)", 1), F.regexp_extract(mantissa, r"\.(\d+)$", 1)
    digits, point = F.concat(whole, part), F.length(whole) + exponent
    left = F.when(point <= 0, "0").otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0")))
    right = F.when(point < 0, F.concat(F.repeat(F.lit("0"), -point), digits)).when(point == 0, digits).otherwise(F.substring(digits, point + 1, F.length(digits)))
    right = F.regexp_replace(right, "0+$", "")
    names = F.array(*(F.lit(w) for w in DIGIT_WORDS))
    spelled = F.array_join(F.transform(F.filter(F.split(right, ""), lambda c: c != ""), lambda c: F.get(names, c.cast("int"))), "")
    said = F.concat(F.when(x < 0, MINUS).otherwise(""), num_to_thaiword(left), F.lit(POINT), spelled)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull(), None).when(bad, F.raise_error(F.lit("not a finite number")).cast("string")).when(x == F.floor(x), num_to_thaiword(x)).otherwise(said)


#: Years from each era to the Buddhist one.
ERAS = {"be": 0, "ad": 543, "re": 2324, "ah": 1122}


def convert_years(year: Column | str, source: str = "be", target: str = "ad") -> Column:
    """A year (text or number) of one era in another, as text."""
    if source not in ERAS or target not in ERAS or source == target:
        raise NotImplementedError(f"no conversion from {source} to {target}")
    return (as_column(year).cast("int") + ERAS[source] - ERAS[target]).cast("string")


def reign_year_to_ad(year: Column | str, reign: Column | str) -> Column:
    """The year of a reign (7 to 10) as AD; 0 for others."""
    y, r = as_column(year).cast("int"), as_column(reign).cast("int")
    return F.when(r == 10, y + 2015).when(r == 9, y + 1945).when(r == 8, y + 1928).when(r == 7, y + 1924).otherwise(0)


def now_reign_year() -> Column:
    return F.year(F.current_date()) - 2015


#: Ancient units of money in baht.
CURRENCY = {"เบี้ย": 1 / 6400, "อัฐ": 1 / 64, "ไพ": 1 / 32, "เฟื้อง": 1 / 8, "สลึง": 1 / 4, "บาท": 1.0, "ตำลึง": 4.0, "ชั่ง": 80.0}


def convert_currency(value: Column | str, unit: str) -> Column:
    """A map of an amount in all units."""
    if unit not in CURRENCY:
        raise NotImplementedError(f"unknown unit {unit}")
    baht = as_column(value).cast("double") * CURRENCY[unit]
    return F.create_map(*(c for k, v in CURRENCY.items() for c in (F.lit(k), baht / v)))


#: The animals of the twelve years.
ZODIAC = {
    1: ["ชวด", "ฉลู", "ขาล", "เถาะ", "มะโรง", "มะเส็ง", "มะเมีย", "มะแม", "วอก", "ระกา", "จอ", "กุน"],
    2: ["RAT", "OX", "TIGER", "RABBIT", "DRAGON", "SNAKE", "HORSE", "GOAT", "MONKEY", "ROOSTER", "DOG", "PIG"],
}


def th_zodiac(year: Column | str, output: int = 1) -> Column:
    """The animal of an AD year: in Thai (1), English (2), or its number (3)."""
    place = F.pmod(as_column(year).cast("int") - 4, F.lit(12))
    if output == 3:
        return place + 1
    return F.get(F.array(*(F.lit(a) for a in ZODIAC[output])), place)
