"""Functions of single words, held against published examples: each row of a table picks an example by its key, and SQL knows what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saithong.operators import corpus as R
from saithong.operators import lexical as L
from saithong.operators import prosody as P
from saithong.operators import scripts as X
from saithong.operators import segment as S
from saithong.plans.registry import _table, query

# Inputs and outputs.
CLUSTERS = {
    "ประเทศไทย": ["ป", "ระ", "เท", "ศ", "ไท", "ย"], "พิสูจน์ได้ค่ะ": ["พิ", "สูจน์", "ได้", "ค่ะ"], "หอมรดกไทย": ["ห", "อ", "ม", "ร", "ด", "ก", "ไท", "ย"], "เรือน้อยลอยอยู่": ["เรื", "อ", "น้", "อ", "ย", "ล", "อ", "ย", "อ", "ยู่"],
    "ประสานงานกับลูกค้า": ["ป", "ระ", "สา", "น", "งา", "น", "กั", "บ", "ลู", "ก", "ค้า"], "ตากลม": ["ตา", "ก", "ล", "ม"], "เครื่องมือสื่อสารมีหลายชนิด": ["เค", "รื่อ", "ง", "มือ", "สื่อ", "สา", "ร", "มี", "ห", "ลา", "ย", "ช", "นิ", "ด"],
    "ประชาชน": ["ป", "ระ", "ชา", "ช", "น"], "ไหมไทย": ["ไห", "ม", "ไท", "ย"], "ยินดี": ["ยิ", "น", "ดี"], "ขุดหลุม": ["ขุ", "ด", "ห", "ลุ", "ม"], "": [],
}
FINE_CLUSTERS = {"ประเทศไทย": ["ป", "ระ", "เท", "ศ", "ไท", "ย"], "พิสูจน์ได้ค่ะ": ["พิ", "สูจน์", "ได้", "ค่ะ"], "หอมรดกไทย": ["ห", "อ", "ม", "ร", "ด", "ก", "ไท", "ย"], "เรือน้อยลอยอยู่": ["เรือ", "น้", "อ", "ย", "ล", "อ", "ย", "อ", "ยู่"], "": []}
ROMANIZED = {
    "": "", "abc": "abc", "หมอก": "mok", "หาย": "hai", "แมว": "maeo", "เดือน": "duean", "ดำ": "dam", "ดู": "du", "บัว": "bua", "กก": "kok", "พร": "phon", "กร": "kon", "กรร": "kan", "กรรม": "kam", "ฝ้าย": "fai", "ทีป|กร": "thipakon", "บ้าน|ไร่": "banrai", "ธรรพ์": "than", "ธรรม": "tham", "มหา": "maha", "หยาก": "yak", "อยาก": "yak",
    "ยมก": "yamok", "กลัว": "klua", "ชารินทร์": "charin", "ฤก": "rueok", "ฤดู": "rueadu", "ฤทธิ์": "rueot",
}
BRAILLE = {"กก": "⠛⠛", "ข": "⠅", "ง": "⠻", "น้ำ": "⠝⠲⠵", "กา": "⠛⠡", "ดี": "⠙⠆", "ลิ้น": "⠇⠃⠲⠝", "ว่าง": "⠺⠔⠡⠻", "แก้ม": "⠣⠛⠲⠍", "เรียน": "⠗⠷⠝"}
COMPLETE_SOUNDEX = {
    "": "", "ก้าน": "กก1Bน2-", "มารค": "มม1B-ก0-", "กลับ": "กก1Aบ0ล", "กมล": "กก1A-0-มม7Mน0-", "ใกล้": "กก1Aย2ล", "โก่ง": "กก7Nง1-", "เครื่อง": "คคBVง1ร", "ก้ม": "กก7Mม2-", "แกน": "กก6Lน0-", "ทราย": "ซซ1Bย0-", "สวรรค์": "ซศ1A-0-วว1Aน0-", "ปัน": "ปป1A0น-", "นา": "นน1B0--", "ปุญ": "ปป4G0น-", "ญา": "ยย1B0--*",
    "ปัญ": "ปป1A0น-", "บุญ": "บบ4G0น-", "ยา": "ยย1B0--",
}
SYLLABLES = {
    "live": ["ไป", "จริง", "กิน", "กำ", "มา", "สาว", "ฉุย"], "dead": ["ธุ", "ระ", "กะ", "ทิ", "เกะ", "บท", "บาท", "ลาภ", "เมฆ", "เลข", "ธูป", "บ", "บ่", "ก็", "เพราะ", "เกาะ", "แคะ", "ประ"],
}
TONES = {
    "l": ["กด", "ต่อ", "ฉาก", "ใส่", "อยาก", "อยู่", "หนวก", "ใหม่", "หรอก", "หลอก", "หัก", "หาก", "ห่อ", "อด", "อดีต", "อธิ", "ออก", "อะ", "อีก", "อู่", "เหตุ", "เอก", "ใหญ่"], "m": ["ควาย", "ไป", "เอ", "อนา", "อัตรา", "อา", "อำ", "เอง", "เอา", "แอ", "โอ", "โอน", "ไอ"], "h": ["คะ", "วัด", "ไม้", "โต๊ะ", "ครับ"],
    "r": ["เขา", "ก๋ง", "หญิง"], "f": ["มาก", "ใช่", "ไหม้", "ต้น", "ผู้", "ค่ะ", "หญ้า", "อ้อม", "อ้าง", "เอื้อ", "ไอ้"],
}
OLD_SPELLING = {"ก": "ก", "กก": "กก", "จกก": "จัก", "ดง่ง": "ดั่ง", "นน้น": "นั้น", "ขดด": "ขัด", "ตรสส": "ตรัส", "ขบบ": "ขับ", "วนน": "วัน", "หลงง": "หลัง", "บงงคบบ": "บังคับ", "สรรเพชญ": "สรรเพชญ", "": "", "กา": "กา"}
PALI = {
    "ติสรเณนสห": "ติสะระเณนะสะหะ", "สีลานิ ยาจาม": "สีลานิ ยาจามะ", "ภควา": "ภะคะวา", "อรหโต": "อะระหะโต", "โลกวิทู": "โลกะวิทู", "นมามิ": "นะมามิ", "สมฺมา": "สัมมา", "สงฺโฆ": "สังโฆ", "พุทฺโธ": "พุทโธ", "พุทฺธสฺส": "พุทธัสสะ", "สนฺทิฏฺฐิโก": "สันทิฏฐิโก", "ปาหุเนยฺโย": "ปาหุเนยโย", "มยํ": "มะยัง", "วิสุ ํ": "วิสุง",
    "อรหํ": "อะระหัง", "สงฺฆํ": "สังฆัง",
}
SPELLED = {"เรียน": ["รอ", "เอีย", "นอ", "เรียน"], "เฝ้า": ["ฝอ", "เอา", "เฝา", "ไม้โท", "เฝ้า"], "คน": ["คอ", "นอ", "คน"], "กัน": ["กอ", "อะ", "นอ", "กัน"], "กั้น": ["กอ", "อะ", "นอ", "กัน", "ไม้โท", "กั้น"]}
RTGS = {"kluaj": "kluai", "waːw": "wao", "/naː˥˩/": "/na/"}
DOMAINS = {"คนละครึ่ง.com": "xn--42caj4e6bk1f5b1j.com", "ไทย.com": "xn--o3cw4h.com", "example.com": "example.com", "ภาษาไทย.th": "xn--o3crh0a8bb0k.th"}
VOWELS = {
    "อะ": ["ฉะ", "ค่ะ", "กระ", "อรรถ", "สัตว์", "พันธุ์", "อัน"], "อา": ["พาล", "พลา", "ฆาต", "ซ่า"], "อิ": ["นิ", "มิต", "บิน", "ยิ้ม", "พิมพ์"], "อี": ["ตรี", "ปี", "ปี่", "ฎี", "นีย์", "ปรีดิ์"], "อึ": ["ตรึก", "ผึ้ง", "อึ", "ขึ้น", "หนึ่ง"], "อือ": ["อือ", "มือ", "ซื้อ", "ปรือ"], "อุ": ["ธุ", "ญุ", "อุ๊ป", "สุทธิ์"],
    "อู": ["ถู", "หรู", "ธูป", "บูรณ์"], "เอะ": ["เซะ"], "เอ": ["เอ", "เพล", "เพช"], "แอะ": ["แอะ", "และ", "แประ"], "แอ": ["แปร", "แอร์"], "เอีย": ["เรียน", "เกียร์", "เกียว"], "เอือ": ["เงือก", "เอือ", "เสือ"], "อัว": ["กลัว", "พวก"], "โอ": ["โต", "โดรน"], "ไอ": ["ไป", "ไตร", "ใบ", "ใกล้"], "เอา": ["เต้า", "เป๋า", "เชาว์"],
}
FINALS = {
    "กง": ["ปลิง", "ยูง", "กล่อง", "สอง", "งง", "ผึ้ง", "หนึ่ง", "แข็ง", "เริง", "เรื่อง"], "กม": ["ลม", "เข็ม", "จาม", "ยิ้ม", "รมย์", "พิมพ์", "กรม", "ธรรม"], "เกย": ["สวย", "โปรย", "เนย", "คอย", "ง่าย", "เลื่อย", "เลย"], "เกอว": ["สาว", "นิ้ว", "แมว", "ดาว", "เกียว", "เหว"], "กก": ["บก", "โรค", "ลาก", "นัข", "ตรึก", "เงือก", "พวก"],
}
IPA = {"กา": "kaː˧", "แมว": "mɛːw˧", "คน": "kʰon˧", "กะ": "kaʔ˨˩"}
THREE_SYSTEMS = {"กา": ["gaa", "ka", "kaː˧"], "คน": ["kon", "khon", "kʰon˧"]}
CLOCK = {"บ่ายโมงครึ่ง": "13:30", "เที่ยงคืนหนึ่งนาที": "00:01", "ตีสามสิบห้า": "03:15", "หกโมงเช้า": "06:00"}
RHYMING = {"กา": ["นา", "ตา", "กา", "ปลา"], "ตี": ["ตี", "มี", "ดี"], "นก": ["นก", "รก", "บก"], "แมว": ["แมว", "แถว"]}
SUBSEQUENCES = {"ABCBDAB|BDCAB": "BDAB", "AGGTAB|GXTXAYB": "GTAB", "ABCDGH|AEDFHR": "ADH", "|": "", "ABC|": "", "A|B": "", "ABC|AC": "AC", "ภาษาไทย|ไทย": "ไทย"}


def _inverted(groups: dict[str, list[str]]) -> dict[str, str]:
    return {w: k for k, words in groups.items() for w in words}


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _value(v: str | list[str]) -> str:
    return _text(v) if isinstance(v, str) else f"CAST([{', '.join(map(_text, v))}] AS VARCHAR[])"


def _published(name: str, cases: dict, f: Callable[[Column], Column]) -> None:
    """Registers a query that applies f to the examples that the rows of part pick."""
    inputs, n = list(cases), len(cases)
    sql = f"SELECT p_partkey, [{', '.join(map(_text, inputs))}][p_partkey % {n} + 1] AS word, [{', '.join(map(_value, cases.values()))}][p_partkey % {n} + 1] AS found FROM part"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        word = F.get(F.array(*map(F.lit, inputs)), (F.col("p_partkey") % n).cast("int"))
        return _table(spark, sf_dir, "part").select("p_partkey", word.alias("word")).select("p_partkey", "word", f(F.col("word")).alias("found"))

    run.__name__, run.__doc__ = name, f"Published examples of {name.removesuffix('_examples')}."
    query(sql)(run)


_published("tcc_examples", CLUSTERS, lambda w: S.subword_tokenize(w))
_published("tcc_p_examples", FINE_CLUSTERS, lambda w: S.subword_tokenize(w, "tcc_p"))
_published("royin_examples", ROMANIZED, lambda w: X.romanize(F.split(w, r"\|")))
_published("braille_examples", BRAILLE, X.braille)
_published("complete_soundex_examples", COMPLETE_SOUNDEX, lambda w: L.soundex(w, "complete_soundex"))
_published("syllable_sound_examples", _inverted(SYLLABLES), lambda w: L.arrow(L.sound_syllable, "string")(w))
_published("tone_examples", _inverted(TONES), lambda w: L.arrow(L.tone, "string")(w))
_published("old_spelling_examples", OLD_SPELLING, lambda w: X.aksonhan_to_current(w, ["ถนน", "สรรเพชญ"]))
_published("pali_examples", PALI, X.pronounce_pali)
_published("spelling_examples", SPELLED, X.spell_out)
_published("rtgs_examples", RTGS, X.ipa_to_rtgs)
_published("domain_examples", DOMAINS, L.to_idna)
_published("vowel_examples", _inverted(VOWELS), lambda w: L.arrow(P.vowel, "string")(w))
_published("final_examples", _inverted(FINALS), lambda w: L.arrow(P.final, "string")(w))
_published("common_subsequence_examples", SUBSEQUENCES, lambda w: R.lcs(F.split_part(w, F.lit("|"), F.lit(1)), F.split_part(w, F.lit("|"), F.lit(2))))
_published("ipa_examples", IPA, X.transliterate_syllables)
_published("three_systems_examples", THREE_SYSTEMS, lambda w: F.array(*(X.all_systems(w)[k] for k in ("paiboon", "royin", "ipa"))))
_published("clock_examples", CLOCK, lambda w: L.arrow(L.thaiword_to_time, "string")(w))

_RHYMES = [(w, k) for k, words in RHYMING.items() for w in words]


@query(f"""
WITH l(word, k) AS (VALUES {', '.join(f"({_text(w)}, {_text(k)})" for w, k in _RHYMES)}),
p AS (SELECT DISTINCT [{', '.join(_text(w) for w, _ in _RHYMES)}][p_partkey % {len(_RHYMES)} + 1] AS word FROM part)
SELECT p.word, y.word AS rhyme FROM p JOIN l x ON x.word = p.word JOIN l y ON y.k = x.k AND y.word <> x.word""")
def rhyming_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that rhyme with those that the rows of part pick, of a list in groups that are known to rhyme."""
    lexicon = spark.createDataFrame([(w,) for w, _ in _RHYMES], "word string")
    word = F.get(F.array(*(F.lit(w) for w, _ in _RHYMES)), (F.col("p_partkey") % len(_RHYMES)).cast("int"))
    return P.rhymes(_table(spark, sf_dir, "part").select(word.alias("word")).distinct(), lexicon).select("word", "rhyme")
