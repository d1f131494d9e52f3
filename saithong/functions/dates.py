"""Thai dates and times: formats are compiled into native column expressions when a plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from saithong.chars import DIGITS
from saithong.functions.numbers import num_to_thaiword
from saithong.functions.text import as_column

# Thai names of days (from Monday) and months.
WEEKDAYS_SHORT = ["จ", "อ", "พ", "พฤ", "ศ", "ส", "อา"]
WEEKDAYS = ["วันจันทร์", "วันอังคาร", "วันพุธ", "วันพฤหัสบดี", "วันศุกร์", "วันเสาร์", "วันอาทิตย์"]
MONTHS_SHORT = ["ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค."]
MONTHS = ["มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม"]
MONTHS_SPOKEN = ["มกรา", "กุมภา", "มีนา", "เมษา", "พฤษภา", "มิถุนา", None, "สิงหา", "กันยา", "ตุลา", "พฤศจิกา", "ธันวา"]
#: Days from today that words for days mean.
DAY_WORDS = {
    0: ["วันนี้", "คืนนี้"], 1: ["พรุ่งนี้", "วันพรุ่งนี้", "คืนถัดจากนี้", "คืนหน้า"], 2: ["มะรืน", "มะรืนนี้", "วันมะรืนนี้", "ถัดจากพรุ่งนี้", "ถัดจากวันพรุ่งนี้"],
    -1: ["เมื่อวาน", "เมื่อวานนี้", "วานนี้", "เมื่อคืน", "เมื่อคืนนี้"], -2: ["วานซืน", "เมื่อวานซืน", "เมื่อวานของเมื่อวาน"],
}


def _name(names: list[str], at: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for n in names)), at)


def _directive(d: Column, c: str) -> Column:
    day0, month0 = F.weekday(d), F.month(d) - 1
    f = lambda p: F.date_format(d, p)
    year = F.lpad((F.year(d) + 543).cast("string"), 4, "0")
    iso = (F.extract(F.lit("YEAROFWEEK"), d) + 543).cast("string")
    short = lambda y: F.right(y, F.lit(2))
    day = F.lpad(F.dayofmonth(d).cast("string"), 2, " ")
    clock = f("HH:mm:ss")
    known = {
        "A": lambda: _name(WEEKDAYS, day0), "a": lambda: _name(WEEKDAYS_SHORT, day0), "B": lambda: _name(MONTHS, month0), "b": lambda: _name(MONTHS_SHORT, month0), "h": lambda: f("MMM"),
        "C": lambda: F.lpad((F.floor((F.year(d) + 543) / 100) + 1).cast("string"), 2, "0"),
        "c": lambda: F.concat(F.rpad(_name(WEEKDAYS_SHORT, day0), 2, " "), F.lit(" "), day, F.lit(" "), _name(MONTHS_SHORT, month0), F.lit(" "), clock, F.lit(" "), year),
        "D": lambda: F.concat(f("MM/dd/"), short(year)), "F": lambda: F.concat(year, f("-MM-dd")), "G": lambda: F.lpad(iso, 4, "0"), "g": lambda: short(iso),
        "v": lambda: F.concat(day, F.lit("-"), _name(MONTHS_SHORT, month0), F.lit("-"), year), "X": lambda: clock, "x": lambda: F.concat(f("dd/MM/"), year), "Y": lambda: year, "y": lambda: short(year),
        "+": lambda: F.concat(F.rpad(_name(WEEKDAYS_SHORT, day0), 2, " "), F.lit(" "), day, F.lit(" "), _name(MONTHS_SHORT, month0), F.lit(" "), (F.year(d) + 543).cast("string"), F.lit(" "), clock),
        "d": lambda: f("dd"), "e": lambda: day, "m": lambda: f("MM"), "H": lambda: f("HH"), "I": lambda: f("hh"), "M": lambda: f("mm"), "S": lambda: f("ss"), "f": lambda: f("SSSSSS"), "j": lambda: F.lpad(F.dayofyear(d).cast("string"), 3, "0"),
        "p": lambda: f("a"), "T": lambda: clock, "R": lambda: f("HH:mm"), "r": lambda: f("hh:mm:ss a"), "n": lambda: F.lit("\n"), "t": lambda: F.lit("\t"), "%": lambda: F.lit("%"), "u": lambda: (day0 + 1).cast("string"), "w": lambda: F.pmod(day0 + 1, F.lit(7)).cast("string"),
        "k": lambda: F.lpad(F.hour(d).cast("string"), 2, " "), "l": lambda: F.lpad(f("h"), 2, " "), "s": lambda: F.unix_timestamp(d).cast("string"), "V": lambda: F.lpad(F.weekofyear(d).cast("string"), 2, "0"), "Z": lambda: F.lit(""), "z": lambda: F.lit(""),
        "U": lambda: F.lpad(F.floor((F.dayofyear(d) + 6 - F.pmod(day0 + 1, F.lit(7))) / 7).cast("string"), 2, "0"), "W": lambda: F.lpad(F.floor((F.dayofyear(d) + 6 - day0) / 7).cast("string"), 2, "0"),
    }
    return known[c]() if c in known else F.lit(c)


def _to_thai(x: Column) -> Column:
    return F.translate(x, "0123456789", DIGITS)


def thai_strftime(d: Column | str, fmt: str = "%-d %b %y", thai_digits: bool = False) -> Column:
    """A date or timestamp by a format of strftime, years of the Buddhist era and Thai names. Between % and a directive: - drops a leading zero or space, _ makes it a space, 0 a zero, ^ upper case, # the other case, O Thai digits, E nothing."""
    d, parts = as_column(d), []
    for m in re.finditer(r"%([EO_0^#-])(.)|%([EO_0^#-])$|%(.)|%|[^%]+", fmt, re.S):
        how, c, alone, plain = m.groups()
        if how:
            x = _directive(d, c)
            first = F.substring(x, 1, 1)
            rest = F.substring(x, F.lit(2), F.length(x))
            if how == "-":
                x = F.when(first.isin(" ", "0"), rest).otherwise(x)
            elif how == "_":
                x = F.when(first == "0", F.concat(F.lit(" "), rest)).otherwise(x)
            elif how == "0":
                x = F.when(first == " ", F.concat(F.lit("0"), rest)).otherwise(x)
            elif how == "^":
                x = F.upper(x)
            elif how == "#":
                x = F.array_join(F.transform(F.split(x, ""), lambda ch: F.when(ch == F.upper(ch), F.lower(ch)).otherwise(F.upper(ch))), "")
            elif how == "O":
                x = _to_thai(x)
            parts.append(x)
        else:
            parts.append(F.lit(alone) if alone else _directive(d, plain) if plain else F.lit(m[0]))
    out = F.concat(F.lit(""), *parts)
    return _to_thai(out) if thai_digits else out


def thai_strptime(text: Column | str, fmt: str, year: str = "be", add_year: int | None = None, zone: str | None = "Asia/Bangkok") -> Column:
    """A timestamp from Thai text by a format with %d, %B (or %b), %Y and perhaps %H %M %S %f. Two-digit years count from add_year, else 2500 (be) or 2000 (ad). Without a match: null."""
    fmt = re.sub("%-([mdy])", r"%\1", fmt).replace("%b", "%B")
    months = [[m, s, short, f"{i:02}", str(i)] for i, (m, s, short) in enumerate(zip(MONTHS, MONTHS_SPOKEN, MONTHS_SHORT, strict=True), 1)]
    flat = [x for m in months for x in m if x]
    day = "(" + "|".join([*(str(i) for i in range(31, 0, -1)), *(f"0{i}" for i in range(1, 10))]) + ")"
    pattern = {"d": day, "B": "(" + "|".join(re.escape(x) for x in flat) + ")", "Y": "([0-9]{4}|[0-9]{2})", "H": "([0-9]{2}|[0-9])", "M": "([0-9]{2}|[0-9])", "S": "([0-9]{2}|[0-9])", "f": "([0-9]+)"}
    order: list[str] = []

    def group(m: re.Match[str]) -> str:
        if m[1] not in pattern:
            return m[0]
        order.append(m[1])
        return pattern[m[1]]

    full = re.sub("%(.)", group, fmt)
    for needed in "dBY":
        if needed not in order:
            raise KeyError(needed)
    text = as_column(text)
    get = lambda k: F.nullif(F.regexp_extract(text, full, order.index(k) + 1), F.lit("")) if k in order else F.lit("0")
    month = F.lit(None).cast("int")
    for i, names in reversed([*enumerate(months, 1)]):
        for n in names:
            if n:
                month = F.when(get("B") == n, i).otherwise(month)
    y = get("Y").cast("int")
    y = F.when(y < 100, y + (add_year if add_year is not None else {"be": 2500, "ad": 2000}[year])).otherwise(y) - (543 if year == "be" else 0)
    seconds = get("S").cast("decimal(18,6)") + get("f").cast("int") / F.lit(1_000_000).cast("decimal(18,6)")
    args = [y, month, get("d").cast("int"), get("H").cast("int"), get("M").cast("int"), seconds]
    return F.try_make_timestamp(*args, F.lit(zone)) if zone else F.try_make_timestamp_ntz(*args)


def thaiword_to_date(word: Column | str, today: Column | None = None) -> Column:
    """The date of a word for a day, counted from `today` (a date or timestamp; the current date by default); null for other words."""
    days = F.create_map(*(F.lit(v) for n, words in DAY_WORDS.items() for w in words for v in (w, n)))
    start = F.current_date() if today is None else today
    return start + F.make_dt_interval(days=F.try_element_at(days, as_column(word)))


def time_to_thaiword(t: Column | str, fmt: str = "24h", precision: str | None = None) -> Column:
    """A timestamp's time, or that of text as H:M or H:M:S, in words; fmt: 24h, 6h or m6h; precision: None, m or s."""
    if fmt not in ("24h", "6h", "m6h"):
        raise NotImplementedError(f"no time format {fmt}")
    x = as_column(t).cast("string")
    part = lambda k: F.nullif(F.regexp_extract(x, r"(?:^|[ T])(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", k), F.lit(""))
    h, m, s = part(1).cast("int"), part(2).cast("int"), F.coalesce(part(3).cast("int"), F.lit(0))
    say, cat = num_to_thaiword, F.concat
    six = (
        F.when(h == 0, "เที่ยงคืน").when(h < 7, cat(F.lit("ตี"), say(h))).when(h < 12, cat(say(h - 6), F.lit("โมงเช้า"))).when(h == 12, "เที่ยง").when(h == 13, "บ่ายโมง")
        .when(h < 18, cat(F.lit("บ่าย"), say(h - 12), F.lit("โมง"))).when(h == 18, "หกโมงเย็น").otherwise(cat(say(h - 18), F.lit("ทุ่ม")))
    )
    modified = F.when(h == 0, "เที่ยงคืน").when(h < 6, cat(F.lit("ตี"), say(h))).when(h < 12, cat(say(h), F.lit("โมง"))).when(h == 12, "เที่ยง").when(h < 19, cat(say(h - 12), F.lit("โมง"))).otherwise(cat(say(h - 18), F.lit("ทุ่ม")))
    hour = {"24h": cat(say(h), F.lit("นาฬิกา")), "6h": six, "m6h": modified}[fmt]
    minutes, seconds = cat(say(m), F.lit("นาที")), cat(say(s), F.lit("วินาที"))
    half = F.lit(fmt != "24h") & (m == 30)
    if precision in ("m", "s"):
        exact = half if precision == "m" else half & (s == 0)
        rest = F.when(exact, "ครึ่ง").otherwise(cat(minutes, seconds) if precision == "s" else minutes)
    else:
        rest = cat(F.when(m == 0, "").when(half & (s == 0), "ครึ่ง").otherwise(minutes), F.when(s == 0, "").otherwise(seconds))
    return cat(hour, rest)
