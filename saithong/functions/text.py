"""Normalization, cleaning and conversion of texts: native column expressions without Python at run time.

Every function takes a column (or a column's name) and returns a column; null stays null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from saithong import chars as C


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _chain(x: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


# Normalization


def remove_zw(x: Column | str) -> Column:
    """Without zero-width spaces and non-joiners."""
    return F.translate(as_column(x), "​‌", "")


def remove_dup_spaces(x: Column | str) -> Column:
    """Runs of spaces become one, runs of blank lines one line end; trimmed."""
    return _chain(as_column(x), [(" {2,}", " "), ("[ \n]*\n[ \n]*", "\n"), (r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")])


def remove_tonemark(x: Column | str) -> Column:
    return F.translate(as_column(x), C.TONE_MARKS, "")


def remove_spaces_before_marks(x: Column | str) -> Column:
    """Without a space between a consonant (that no vowel precedes) and a mark."""
    return F.regexp_replace(as_column(x), f"([{C.CONSONANTS}])(?<![{C.VOWELS}][{C.CONSONANTS}]) ([{C.NON_BASE}])", "$1$2")


def reorder_vowels(x: Column | str) -> Column:
    """Marks in the standard order: sara e twice is sara ae; vowels above or below come before tone marks; nikhahit with sara aa is sara am; tone marks come before following vowels; lakkhangyao is sara aa unless behind ฤ or ฦ."""
    tone, mid = C.TONE_MARKS, C.ABOVE_VOWELS + C.BELOW_VOWELS
    return _chain(as_column(x), [
        ("เเ", "แ"), (f"([{tone}์]+)([{mid}]+)", "$2$1"), (f"ํ([{tone}]*)า", "$1ำ"), (f"([{C.FOLLOW_VOWELS}]+)([{tone}]+)", "$2$1"), ("([^ฤฦ])ๅ", "$1า"),
    ])


def remove_repeat_vowels(x: Column | str) -> Column:
    """reorder_vowels(), then one of each repeated vowel or sign (with or without spaces between), and the last of several tone marks."""
    once = C.FOLLOW_VOWELS + C.LEAD_VOWELS + C.ABOVE_VOWELS + C.BELOW_VOWELS + "ฺ์ํ๎"
    steps = [(f"(?:{c} *)+{c}", c) for c in once]
    return _chain(reorder_vowels(x), [*steps, (f"[{C.TONE_MARKS}]*([{C.TONE_MARKS}])", "$1")])


def remove_dangling(x: Column | str) -> Column:
    """Without marks at the beginning and behind spaces, where they have no base."""
    return _chain(as_column(x), [(f"^[{C.NON_BASE}]+", ""), (f" +[{C.NON_BASE}]+", " ")])


def normalize(x: Column | str) -> Column:
    """The steps above in their fixed order."""
    return remove_dangling(remove_repeat_vowels(remove_spaces_before_marks(remove_dup_spaces(remove_zw(x)))))


def remove_trailing_repeat_consonants(x: Column | str) -> Column:
    """One consonant where it is repeated at the end of a word (before a space, a line end or the end). With words that keep repeats see operators.lexical."""
    return F.regexp_replace(as_column(x), "([ก-ฮ])\\1+(?=[ \n]|\\z)", "$1")


# Digits and keyboards


def thai_to_arabic_digits(x: Column | str) -> Column:
    return F.translate(as_column(x), C.DIGITS, "0123456789")


def arabic_to_thai_digits(x: Column | str) -> Column:
    return F.translate(as_column(x), "0123456789", C.DIGITS)


#: The names of the digits from 0 on.
DIGIT_WORDS = ["ศูนย์", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า"]


def digits_to_words(x: Column | str) -> Column:
    """Each digit, Thai or Arabic, spelled out."""
    x = thai_to_arabic_digits(x)
    for i, w in enumerate(DIGIT_WORDS):
        x = F.replace(x, F.lit(str(i)), F.lit(w))
    return x


def word_to_arabic_digit(x: Column | str) -> Column:
    """The digit of a digit's name; any other text is empty."""
    names = F.create_map(*(F.lit(v) for i, w in enumerate(DIGIT_WORDS) for v in (w, str(i))))
    return F.coalesce(F.try_element_at(names, as_column(x)), F.lit(""))


def word_to_thai_digit(x: Column | str) -> Column:
    return arabic_to_thai_digits(word_to_arabic_digit(x))


#: What the keys of an English keyboard type on a Thai one.
ENGLISH_KEYS = "ZzXxCcVvBbNnMm<,>.?/AaSsDdFfGgHhJjKkLl:;\"'QqWwEeRrTtYyUuIiOoPp{[}]|\\~`@2#3$4%5^6&7*8(9)0_-+="
THAI_KEYS = "(ผ)ปฉแฮอฺิ์ื?ทฒมฬใฦฝฤฟฆหฏกโดฌเ็้๋่ษาศสซว.ง๐ๆ\"ไฎำฑพธะํั๊ีณรฯนญยฐบ,ลฅฃ%_๑/๒-๓ภ๔ถูุ฿ึ๕ค๖ต๗จ๘ข๙ช"


def english_keys_to_thai(x: Column | str) -> Column:
    """Text typed on the wrong layout: English keys as Thai characters."""
    return F.translate(as_column(x), ENGLISH_KEYS, THAI_KEYS)


def thai_keys_to_english(x: Column | str) -> Column:
    """The inverse: the last key that types a character."""
    last = dict(zip(THAI_KEYS, ENGLISH_KEYS, strict=True))
    return F.translate(as_column(x), "".join(last), "".join(last.values()))


#: Rows of the standard Thai keyboard, plain and shifted.
KEY_ROWS = ["-ๅ/\0_ภถุึคตจขช", "ๆไำพะัีรนยบลฃ", "ฟหกดเ้่าสวง", "ผปแอิืทมใฝ"]
SHIFTED_ROWS = ["%+๑๒๓๔ู฿๕๖๗๘๙", "๐\"ฎฑธํ๊ณฯญฐ,ฅ", "ฤฆฏโฌ็๋ษศซ.", "()ฉฮฺ์?ฒฬฦ"]


def key_distance(a: Column | str, b: Column | str, shift: float = 0.0) -> Column:
    """Distance of two characters' keys; `shift` for different characters on one key. A character that isn't on the keyboard is an error."""
    places: dict[str, tuple[int, int]] = {}
    for rows in (KEY_ROWS, SHIFTED_ROWS):
        for r, row in enumerate(rows):
            for c, ch in enumerate(row):
                places.setdefault(ch, (r, c))
    at = lambda i: F.create_map(*(v for ch, p in places.items() if ch != "\0" for v in (F.lit(ch), F.lit(float(p[i])))))
    a, b = as_column(a), as_column(b)
    missing = lambda x: F.raise_error(F.concat(x, F.lit(" isn't on the keyboard"))).cast("double")
    coordinate = lambda x, i: F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(F.try_element_at(at(i), x), missing(x)))
    d = F.sqrt(F.pow(coordinate(a, 0) - coordinate(b, 0), 2) + F.pow(coordinate(a, 1) - coordinate(b, 1), 2))
    return F.when((d == 0) & (a != b), F.lit(float(shift))).otherwise(d)


# Morse

#: Morse codes of letters.
MORSE_ENGLISH = {
    "A": ".-", "B": "-...", "C": "-.-.", "D": "-..", "E": ".", "F": "..-.", "G": "--.", "H": "....", "I": "..", "J": ".---", "K": "-.-", "L": ".-..", "M": "--",
    "N": "-.", "O": "---", "P": ".--.", "Q": "--.-", "R": ".-.", "S": "...", "T": "-", "U": "..-", "V": "...-", "W": ".--", "X": "-..-", "Y": "-.--", "Z": "--..",
    "0": "-----", ",": "--..--", "1": ".----", ".": ".-.-.-", "2": "..---", "?": "..--..", "3": "...--", ";": "-.-.-.", "4": "....-", ":": "---...", "5": ".....",
    "'": ".----.", "6": "-....", "-": "-....-", "7": "--...", "/": "-..-.", "8": "---..", "(": "-.--.-",
}
MORSE_THAI = {
    "ก": "--.", "ข": "-.-.", "ค": "-.-", "ฆ": "-.-", "ง": "-.--.", "จ": "-..-.", "ฉ": "----", "ช": "-..-", "ฌ": "-..-", "ซ": "--..", "ญ": ".---", "ด": "-..",
    "ถ": "-.-..", "ฐ": "-.-..", "ฑ": "-..--", "ฒ": "-..--", "ท": "-..--", "ธ": "-..--", "ณ": "-.", "น": "-.", "บ": "-...", "ป": ".--.", "ผ": "--.-", "ฝ": "-.-.-",
    "พ": ".--..", "ภ": ".--..", "ฟ": "..-.", "ม": "--", "ย": "-.--", "ร": ".-.", "ล": ".-..", "ฬ": ".-..", "ว": ".--", "ศ": "...", "ษ": "...", "ส": "...", "ห": "....",
    "ฮ": "--.--", "ฎ": "-..", "ต": "-", "ฏ": "-", "ฤ": ".-.--", "่": "..-", "้": "...-", "๊": "--...", "๋": ".-.-.", "ั": ".--.-", "็": "---..", "์": "--..-",
    "ั้": ".---.", "ฯ": "--.-.", "ฯลฯ": "---.-", "ๆ": "---.-", "ะ": ".-...", "า": ".-", "ิ": "..-..", "ี": "..", "ึ": "..--.", "ื": "..--", "ุ": "..-.-", "ู": "---.",
    "เ": ".", "แ": ".-.-", "โ": "---", "ไ": ".-..-", "ใ": ".-..-", "ำ": "...-.", "อ": "-...-",
}


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(v) for kv in pairs.items() for v in kv))


def _letters(language: str) -> dict[str, str]:
    if language not in ("th", "en"):
        raise NotImplementedError(f"no Morse code for {language}")
    return MORSE_THAI if language == "th" else MORSE_ENGLISH


def morse_encode(x: Column | str, language: str = "th") -> Column:
    """Codes of a text's characters, joined by blanks; others are a blank."""
    table = _table(_letters(language))
    each = F.filter(F.split(F.upper(as_column(x)), ""), lambda c: c != "")
    return F.array_join(F.transform(each, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(" "))), " ")


def morse_decode(x: Column | str, language: str = "th") -> Column:
    """The inverse; of letters with one code the last. Unknown codes vanish (th) or are a blank (en)."""
    back = {code: letter for letter, code in _letters(language).items()}
    blank = "" if language == "th" else " "
    said = F.array_join(F.transform(F.split(as_column(x), " "), lambda c: F.coalesce(F.try_element_at(_table(back), c), F.lit(blank))), "")
    return said if language == "th" else F.regexp_replace(F.trim(said), " +", " ")


# Cleaning


def rm_useless_spaces(x: Column | str) -> Column:
    return F.regexp_replace(as_column(x), " {2,}", " ")


def rm_useless_newlines(x: Column | str) -> Column:
    return F.regexp_replace(as_column(x), "\n{2,}", " ")


def spec_add_spaces(x: Column | str) -> Column:
    """Spaces around slashes, hashes and line ends."""
    return F.regexp_replace(as_column(x), "([/#\n])", " $1 ")


def rm_brackets(x: Column | str) -> Column:
    """Without brackets that hold nothing or no letter or digit, and without what stands between a bracket and the next letter or digit inside it."""
    word, x = "a-zA-Z0-9ก-๙", as_column(x)
    kinds = (("\\(", "\\)"), ("\\{", "\\}"), ("\\[", "\\]"))
    steps = [f"{a}{b}" for a, b in kinds] + [f"{a}[^{word}]+{b}" for a, b in kinds] + [f"(?<={a})[^{word}]+(?=[{word}])" for a, _ in kinds] + [f"(?<=[{word}])[^{word}]+(?={b})" for _, b in kinds]
    return _chain(x, [(p, "") for p in steps])


def replace_url(x: Column | str, by: str = "xxurl") -> Column:
    """Addresses of web pages become a word. An address goes on up to white space or an angle bracket; brackets that don't close, and signs and quotes at its end, stay."""
    start = r"(?i)\b(?:https?://|www\d{0,3}[.]|[a-z0-9.\-]{1,253}[.][a-z]{2,4}/)"  # no name of a host is longer
    # Possessive: each sign, letter or bracketed piece has one place, so that a text takes time in proportion to its length.
    sign, letter = "[`!\\[\\]{};:'\".,?«»“”‘’]", "[^\\s`!()\\[\\]{};:'\".,<>?«»“”‘’]"
    bracket = "\\((?:[^\\s()<>]++|\\([^\\s()<>]++\\))*+\\)"
    solid = f"(?:{letter}++|{bracket})"
    body = f"(?:{sign}++|(?:{letter}|{bracket}){sign}*+){solid}(?:{sign}*+{solid})*+"
    return F.regexp_replace(as_column(x), start + body, by)


def fix_html(x: Column | str) -> Column:
    """Leftovers of markup as text, backslashes set apart, < and > from their entities, single spaces. For all named entities see lexical.unescape_html."""
    x = as_column(x)
    pairs = [("#39;", "'"), ("amp;", "&"), ("#146;", "'"), ("nbsp;", " "), ("#36;", "$"), ("\\n", "\n"), ("quot;", "'"), ("<br />", "\n"), ('\\"', '"'), ("<unk>", "xxunk"), (" @.@ ", "."), (" @-@ ", "-"), (" @,@ ", ","), ("\\", " \\ "), ("&lt;", "<"), ("&gt;", ">")]
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, " {2,}", " ")


def replace_rep_nonum(x: Column | str) -> Column:
    """A character four or more times in a row becomes one and the word xxrep."""
    return F.regexp_replace(as_column(x), r"(\S)\1{3,}", "$1 xxrep ")


def replace_rep_after(x: Column | str) -> Column:
    """The same with the number of repetitions behind xxrep. The text is cut at runs, so no Python is needed to count."""
    runs = F.regexp_extract_all(as_column(x), F.lit(r"(?s)(\S)\1{3,}|(?:(?!(\S)\2{3,}).)+"), F.lit(0))
    each = lambda s: F.when(s.rlike(r"(?s)^(\S)\1{3,}\z"), F.concat(F.substring(s, 1, 1), F.lit("xxrep"), F.length(s).cast("string"), F.lit(" "))).otherwise(s)
    return F.array_join(F.transform(runs, each), "")


def replace_wrep(tokens: Column | str, *, number: bool = True) -> Column:
    """A token repeated in a row becomes xxwrep, the number of its repeats behind the first (unless number is false) and the token; empty tokens go."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))

    def said(s: Column) -> Column:
        many = F.array(F.lit("xxwrep"), (s["n"] - 1).cast("string"), s["last"]) if number else F.array(F.lit("xxwrep"), s["last"])
        return F.when(s["n"] == 0, s["out"]).otherwise(F.concat(s["out"], F.when(s["n"] > 1, many).otherwise(F.array(s["last"]))))

    def step(s: Column, t: Column) -> Column:
        same = (s["n"] > 0) & (s["last"] == t)
        return F.when(same, F.struct(s["out"].alias("out"), s["last"].alias("last"), (s["n"] + 1).alias("n"))).otherwise(F.struct(said(s).alias("out"), t.alias("last"), F.lit(1).alias("n")))

    return F.aggregate(F.filter(as_column(tokens), lambda t: t != ""), state, step, said)


def lowercase_all(tokens: Column | str) -> Column:
    return F.transform(as_column(tokens), lambda t: F.lower(t))


def remove_space(tokens: Column | str) -> Column:
    """Tokens trimmed, empty ones dropped."""
    return F.filter(F.transform(as_column(tokens), lambda t: F.trim(t)), lambda t: t != "")


def strip_whitespace(tokens: Column | str) -> Column:
    """Tokens without spaces at their ends; those of spaces alone are dropped."""
    return remove_space(tokens)


def replace_newlines(x: Column | str) -> Column:
    """Line ends inside a trimmed text as spaces."""
    return F.translate(F.btrim(as_column(x), F.lit(" \t\n\r\x0b\x0c")), "\n", " ")


def replace_spaces(x: Column | str, by: str = "<_>") -> Column:
    return F.regexp_replace(as_column(x), " ", by)


# Characters


def is_thai_char(x: Column | str) -> Column:
    return as_column(x).rlike("^[฀-๿]$")


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in chars)


def is_thai(x: Column | str, ignore: str | None = ".") -> Column:
    """Whether all characters are Thai, or among those to ignore. The empty text is."""
    return ~as_column(x).rlike(f"[^฀-๿{_class(ignore or '')}]")


#: ASCII white space, digits and punctuation.
IGNORED = " \t\n\r\x0b\x0c0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def count_thai(x: Column | str, ignore: str | None = IGNORED) -> Column:
    """Percentage of Thai characters among those not ignored; 0 for none, and for null."""
    x = F.coalesce(as_column(x), F.lit(""))
    rest = F.regexp_replace(x, f"[{_class(ignore)}]", "") if ignore else x
    n = F.length(rest)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(rest, "[^฀-๿]", "")) / n * 100)


def display_thai_char(x: Column | str) -> Column:
    """A mark with a line before it; others as they are."""
    x = as_column(x)
    return F.when(x.rlike(f"^[{C.ABOVE_VOWELS}{C.TONE_MARKS}ำ์ํ๎]$"), F.concat(F.lit("_"), x)).otherwise(x)


def count_thai_chars(x: Column | str) -> Column:
    """A struct of the numbers of characters of each class. A vowel with a position counts in its position's class too; whatever no other class has is non_thai, ฤ, ฦ and ฿ among it."""
    x = F.coalesce(as_column(x), F.lit(""))
    signs = "".join(c for c in C.SIGNS if c not in C.ABOVE_VOWELS)
    classes = {"lead_vowels": C.LEAD_VOWELS, "follow_vowels": C.FOLLOW_VOWELS, "above_vowels": C.ABOVE_VOWELS, "below_vowels": C.BELOW_VOWELS, "consonants": C.CONSONANTS, "tonemarks": C.TONE_MARKS, "signs": signs, "thai_digits": C.DIGITS, "punctuations": C.PUNCTUATION}
    count = lambda chars: F.length(F.regexp_replace(x, f"[^{chars}]", "")).cast("long")
    return F.struct(count(C.VOWELS).alias("vowels"), *(count(v).alias(k) for k, v in classes.items()), F.length(F.regexp_replace(x, f"[{''.join(classes.values())}]", "")).cast("long").alias("non_thai"))


#: Names of Thai vowels and marks.
CHAR_NAMES = {
    "ะ": "สระ อะ", "ั": "ไม้หันอากาศ", "า": "สระ อา", "ำ": "สระ อำ", "ิ": "สระ อิ", "ี": "สระ อี", "ึ": "สระ อึ", "ื": "สระ อือ", "ุ": "สระ อุ", "ู": "สระ อู", "เ": "สระ เอ", "แ": "สระ แอ", "โ": "สระ โอ", "ใ": "สระ ใอ", "ไ": "สระ ไอ",
    "ๅ": "ไม้ม้วน", "ํ": "นฤคหิต", "็": "ไม้ไต่คู้", "่": "ไม้เอก", "้": "ไม้โท", "๊": "ไม้ตรี", "๋": "ไม้จัตวา", "ฯ": "ไปยาลน้อย", "ฺ": "พินทุ", "ๆ": "ไม้ยมก", "์": "การันต์", "๎": "ยามักการ", "๏": "ฟองมัน", "๚": "อังคั่นคู่", "๛": "โคมุต",
}


def char_name(c: Column | str) -> Column:
    """The name of a Thai vowel or mark; other characters are their own."""
    c = as_column(c)
    return F.coalesce(F.try_element_at(_table(CHAR_NAMES), c), c)


def display_cells(x: Column | str) -> Column:
    """Characters with the marks on them; ำ is taken apart first. Marks at the beginning form a cell of their own; null and the empty text have none."""
    marks = C.ABOVE_VOWELS + C.BELOW_VOWELS + C.TONE_MARKS + "ฺ์ํ๎"
    x = F.replace(F.coalesce(as_column(x), F.lit("")), F.lit("ำ"), F.lit("ํา"))
    return F.regexp_extract_all(x, F.lit(f"(?s)[^{marks}][{marks}]*|[{marks}]+"), F.lit(0))


def collation_key(x: Column | str) -> Column:
    """Orders Thai words as dictionaries do: tone marks aside, a leading vowel behind its consonant; the first tone mark last."""
    x = as_column(x)
    base = F.regexp_replace(F.regexp_replace(x, "[็-์]", ""), "([เ-ไ])([ก-ฮ])", "$2$1")
    return F.concat(base, F.regexp_extract(x, "([็-์])", 1))


def is_native_thai(x: Column | str) -> Column:
    """Whether a word looks native: a known exception; else none of the letters of borrowed words, and one consonant, a native final or a native prefix. False for null and blank."""
    x = F.btrim(F.coalesce(as_column(x), F.lit("")))
    known = x.isin("ฆ่า", "เฆี่ยน", "ศึก", "ศอก", "เศิก", "เศร้า", "ธ", "ณ", "ฯพณฯ", "ใหญ่", "หญ้า", "ควาย", "ความ", "กริ่งเกรง", "ผลิ")
    n = F.length(F.regexp_replace(x, "[^ก-ฬฮ]", ""))
    return F.when(known, True).when(x.rlike("[ฆณฌฎฏฐฑฒธศษฬ์]") | (n == 0), False).otherwise((n == 1) | x.rlike("[กดบนงมยว]$") | x.isin("กะ", "กระ", "ปะ", "ประ"))


def nighit(first: Column | str, second: Column | str) -> Column:
    """Pali sandhi of a word of a consonant and nikhahit with another word: the consonant, ั, the nasal of the other's first consonant, the other. An empty word gives the other one."""
    a, b = F.btrim(as_column(first)), F.btrim(as_column(second))
    start = F.regexp_extract(b, f"([{C.CONSONANTS}])", 1)
    nasal = F.when(start.rlike("[กชคขงยรลฬวศษสห]"), "ง").when(start.rlike("[จฉฌ]"), "ญ").when(start.rlike("[ฎฐฑณ]"), "ณ").when(start.rlike("[ดถทธน]"), "น").when(start.rlike("[ปผพภ]"), "ม")
    nasal = F.coalesce(nasal, F.raise_error(F.concat(F.lit("no sandhi with "), b)).cast("string"))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(F.substring(a, 1, 1), F.lit("ั"), nasal, b))
