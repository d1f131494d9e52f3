"""Queries of more functions, each held against SQL of its own: groups of native functions, segmenters on texts whose words are known, lookups, spans and tags.

Texts come from the driver's tables: numbers in Thai words, and a few given Thai samples that a row picks by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saithong import chars as C
from saithong.functions import dates as D
from saithong.functions import numbers as N
from saithong.functions import text as T
from saithong.operators import corpus as R
from saithong.operators import entities as E
from saithong.operators import lexical as L
from saithong.operators import scripts as X
from saithong.operators import segment as S
from saithong.plans.registry import _MONTHS, _NUMBER_WORDS, _sql_number, _table, query

#: Texts with everything that normalization mends, and some that it leaves.
SAMPLES = [
    "เเปลก", "นํา", "นๅคา", "ฤๅษี", "กา า  า", "พ ุ่มดอกไม้", "ก้้ำ", "ี่ดี", "น้ํา ้า", "เด็ก​ไทย‌", "ไปปป", "เริ่ดดดดด ดด", "บ้าน  นอก\n\n \nเมือง", "จ๊่ะ", "เเเ", "ที ี่นี่", "ปู ูู", "ไม้ ม ้วน", "ก์ิ", "ํา", "ครับบ\nผมม", "สระ ะ ะ", "โรค COVID-19", "ฉันรักภาษาไทย",
]
#: Words of one syllable or two, for functions of words.
WORDS = ["ก", "กา", "กะ", "คน", "น้ำ", "แมว", "หมา", "เกาะ", "ใหญ่", "ความ", "ศึก", "ณ", "ญาติ", "ประ", "กระ", "เมีย", "ฬ", "อาการ", "เธอ", "เด็ก", "x1", "", "ไทย", "สงฆ์"]


def _pick(values: list[str], key: str) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values)).cast("int"))


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _sql_pick(values: list[str], key: str) -> str:
    return f"[{', '.join(map(_quoted, values))}][{key} % {len(values)} + 1]"


def _re(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(to)}, 'g')"


def _chain(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        x = _re(x, pattern, to)
    return x


def _sql_map(pairs: dict[str, str], key: str, default: str) -> str:
    return f"coalesce(map([{', '.join(map(_quoted, pairs))}], [{', '.join(map(_quoted, pairs.values()))}])[{key}], {default})"


# Normalization

_ZW = "regexp_replace(x, '[​‌]', '', 'g')"
_SPACES = "regexp_replace(regexp_replace(regexp_replace({0}, ' {{2,}}', ' ', 'g'), '[ \\n]*\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
_MARKED = _chain("{0}", [("([^" + C.VOWELS + "]|^)([" + C.CONSONANTS + "]) ([" + C.NON_BASE + "])", "\\1\\2\\3")] * 2)
_ORDERED = _chain("{0}", [("เเ", "แ"), ("([่้๊๋์]+)([ัิีึืํ็ุู]+)", "\\2\\1"), ("ํ([่้๊๋]*)า", "\\1ำ"), ("([ะาำๅ]+)([่้๊๋]+)", "\\2\\1"), ("([^ฤฦ])ๅ", "\\1า")])
_ONCE = _chain("{0}", [*((f"({c} *)+{c}", c) for c in "ะาำๅเแโใไัิีึืํ็ฺุู์ํ๎"), ("[่้๊๋]*([่้๊๋])", "\\1")])
_DANGLING = _chain("{0}", [("^[" + C.NON_BASE + "]+", ""), (" +[" + C.NON_BASE + "]+", " ")])
_TRAILING = _chain("x", [(f"{c}{c}+( |\\n|$)", f"{c}\\1") for c in C.CONSONANTS])


@query(f"""
WITH s AS (SELECT p_partkey, {_sql_pick(SAMPLES, 'p_partkey')} AS x FROM part),
a AS (SELECT *, {_ZW} AS zw, {_SPACES.format('x')} AS dup_spaces, {_re('x', '[่้๊๋]')} AS tonemark, {_MARKED.format('x')} AS marks, {_ORDERED.format('x')} AS ordered, {_DANGLING.format('x')} AS dangling, {_TRAILING} AS trailing_once FROM s),
b AS (SELECT *, {_ONCE.format('ordered')} AS once, {_SPACES.format('zw')} AS n1 FROM a), c AS (SELECT *, {_MARKED.format('n1')} AS n2 FROM b), d AS (SELECT *, {_ORDERED.format('n2')} AS n3 FROM c), e AS (SELECT *, {_ONCE.format('n3')} AS n4 FROM d)
SELECT p_partkey, zw, dup_spaces, tonemark, marks, ordered, once, dangling, trailing_once, {_DANGLING.format('n4')} AS normalized FROM e""")
def normalization_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalize() and each of its steps."""
    s = _table(spark, sf_dir, "part").select("p_partkey", _pick(SAMPLES, "p_partkey").alias("x"))
    return s.select(
        "p_partkey", T.remove_zw("x").alias("zw"), T.remove_dup_spaces("x").alias("dup_spaces"), T.remove_tonemark("x").alias("tonemark"), T.remove_spaces_before_marks("x").alias("marks"), T.reorder_vowels("x").alias("ordered"),
        T.remove_repeat_vowels("x").alias("once"), T.remove_dangling("x").alias("dangling"), T.remove_trailing_repeat_consonants("x").alias("trailing_once"), T.normalize("x").alias("normalized"),
    )


# Characters and words

_IGNORED_SQL = "[ \\t\\n\\r\\x0b\\x0c0-9!-/:-@\\[-`{-~]"


@query(f"""
WITH s AS (SELECT p_partkey, {_sql_pick(SAMPLES, 'p_partkey')} AS x, {_sql_pick(WORDS, 'p_partkey')} AS w FROM part), c AS (SELECT *, substr(x, 1, 1) AS c, length(regexp_replace(x, '{_IGNORED_SQL}', '', 'g')) AS n FROM s)
SELECT p_partkey, regexp_full_match(c, '[\\x{{0E00}}-\\x{{0E7F}}]') AS is_char, NOT regexp_matches(x, '[^\\x{{0E00}}-\\x{{0E7F}}.]') AS is_thai, CASE WHEN n = 0 THEN 0.0 ELSE round(100.0 * length(regexp_replace(x, '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g')) / n, 9) END AS share,
  CASE WHEN regexp_full_match(c, '[{C.ABOVE_VOWELS}{C.TONE_MARKS}ำ์ํ๎]') THEN '_' || c ELSE c END AS shown, regexp_extract_all(replace(x, 'ำ', 'ํา'), '(?s)[^{C.ABOVE_VOWELS}{C.BELOW_VOWELS}{C.TONE_MARKS}ฺ์ํ๎][{C.ABOVE_VOWELS}{C.BELOW_VOWELS}{C.TONE_MARKS}ฺ์ํ๎]*|[{C.ABOVE_VOWELS}{C.BELOW_VOWELS}{C.TONE_MARKS}ฺ์ํ๎]+') AS cells,
  CASE WHEN w IN ('ฆ่า', 'เฆี่ยน', 'ศึก', 'ศอก', 'เศิก', 'เศร้า', 'ธ', 'ณ', 'ฯพณฯ', 'ใหญ่', 'หญ้า', 'ควาย', 'ความ', 'กริ่งเกรง', 'ผลิ') THEN true WHEN regexp_matches(w, '[ฆณฌฎฏฐฑฒธศษฬ์]') OR NOT regexp_matches(w, '[ก-ฬฮ]') THEN false ELSE regexp_full_match(w, '[^ก-ฬฮ]*[ก-ฬฮ][^ก-ฬฮ]*') OR regexp_matches(w, '[กดบนงมยว]$') OR w IN ('กะ', 'กระ', 'ปะ', 'ประ') END AS native FROM c""")
def thai_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is Thai in texts, their cells, and words that look native."""
    s = _table(spark, sf_dir, "part").select("p_partkey", _pick(SAMPLES, "p_partkey").alias("x"), _pick(WORDS, "p_partkey").alias("w"))
    c = F.substring("x", 1, 1)
    return s.select("p_partkey", T.is_thai_char(c).alias("is_char"), T.is_thai("x").alias("is_thai"), F.round(T.count_thai("x"), 9).alias("share"), T.display_thai_char(c).alias("shown"), T.display_cells("x").alias("cells"), T.is_native_thai("w").alias("native"))


@query("""
WITH s AS (SELECT p_partkey, ['ส', 'ก', 'ต', 'อ'][p_partkey % 4 + 1] || 'ํ' AS a, ['คีต', 'จร', 'ฐาน', 'ธรรม', 'พร', 'หาร', ''][p_partkey % 7 + 1] AS b FROM part)
SELECT p_partkey, CASE WHEN b = '' THEN a ELSE substr(a, 1, 1) || 'ั' || map(['ค', 'จ', 'ฐ', 'ธ', 'พ', 'ห'], ['ง', 'ญ', 'ณ', 'น', 'ม', 'ง'])[substr(b, 1, 1)] || b END AS joined FROM s""")
def nikhahit_sandhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "part").select("p_partkey", F.concat(_pick(["ส", "ก", "ต", "อ"], "p_partkey"), F.lit("ํ")).alias("a"), _pick(["คีต", "จร", "ฐาน", "ธรรม", "พร", "หาร", ""], "p_partkey").alias("b"))
    return s.select("p_partkey", T.nighit("a", "b").alias("joined"))


@query(f"""
WITH s AS (SELECT p_partkey, {_sql_pick(WORDS, 'p_partkey')} AS w FROM part), k AS (SELECT *, regexp_replace(w, '[^{C.CONSONANTS}]', '', 'g') AS c FROM s)
SELECT p_partkey, CASE WHEN length(c) < 2 OR length(c) = 2 AND substr(c, 2) = 'อ' THEN 'open' ELSE 'close' END AS ending, CASE WHEN length(c) <= 3 AND regexp_matches(w, '[ะัิึุ]') OR regexp_matches(w, '[เแโ].*ะ') THEN 'short' ELSE 'long' END AS size,
  CASE WHEN length(w) = 1 AND c = w THEN w || 'อ' ELSE w END AS named FROM k""")
def syllable_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "part").select("p_partkey", _pick(WORDS, "p_partkey").alias("w"))
    return s.select("p_partkey", L.syllable_open("w").alias("ending"), L.syllable_length("w").alias("size"), X.consonant_to_spelling("w").alias("named"))


_KEYS = {c: (r, k) for rows in (T.SHIFTED_ROWS, T.KEY_ROWS) for r, row in enumerate(rows) for k, c in enumerate(row) if c != "\0"}
_TYPED = "กดฟหาสงฤฏ๑"


@query(f"""
WITH k(c, r, p) AS (VALUES {', '.join(f"({_quoted(c)}, {r}, {p})" for c, (r, p) in _KEYS.items())}),
s AS (SELECT s_suppkey, {_sql_pick(list(_TYPED), 's_suppkey')} AS a, {_sql_pick(list(_TYPED), '(s_suppkey // 3)')} AS b FROM supplier)
SELECT s_suppkey, CASE WHEN x.r = y.r AND x.p = y.p AND a <> b THEN 0.5 ELSE round(sqrt((x.r - y.r) * (x.r - y.r) + (x.p - y.p) * (x.p - y.p)), 9) END AS distance FROM s JOIN k x ON x.c = a JOIN k y ON y.c = b""")
def key_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", _pick(list(_TYPED), "s_suppkey").alias("a"), F.get(F.array(*map(F.lit, _TYPED)), (F.floor(F.col("s_suppkey") / 3) % len(_TYPED)).cast("int")).alias("b"))
    return s.select("s_suppkey", F.round(T.key_distance("a", "b", 0.5), 9).alias("distance"))


_UNTYPED = dict(zip(T.THAI_KEYS, T.ENGLISH_KEYS, strict=True))


@query(f"SELECT p_partkey, translate({_sql_pick(SAMPLES, 'p_partkey')}, {_quoted(''.join(_UNTYPED))}, {_quoted(''.join(_UNTYPED.values()))}) AS keys FROM part")
def wrong_thai_keyboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", T.thai_keys_to_english(_pick(SAMPLES, "p_partkey")).alias("keys"))


def _digit_names(x: str) -> str:
    for i, w in enumerate(T.DIGIT_WORDS):
        x = f"replace({x}, '{i}', '{w}')"
    return x


@query(f"""
SELECT p_partkey, {_digit_names('CAST(p_partkey AS VARCHAR)')} AS spelled, CAST(p_size % 10 AS VARCHAR) AS arabic, translate(CAST(p_size % 10 AS VARCHAR), '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS thai, '' AS none FROM part""")
def digit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = N.num_to_thaiword(F.col("p_size") % 10)
    return _table(spark, sf_dir, "part").select("p_partkey", T.digits_to_words(T.arabic_to_thai_digits(F.col("p_partkey").cast("string"))).alias("spelled"), T.word_to_arabic_digit(name).alias("arabic"), T.word_to_thai_digit(name).alias("thai"), T.word_to_arabic_digit(F.lit("สิบ")).alias("none"))


@query(r"SELECT p_partkey, upper(regexp_replace(p_name, '[^a-z ]', '', 'g')) AS said FROM part")
def morse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.regexp_replace("p_name", "[^a-z ]", "")
    words = F.transform(F.split(x, " "), lambda w: T.morse_decode(T.morse_encode(w, "en"), "en"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("said"))


# Cleaning

_BRACKETS = [(r"\(\)", ""), (r"\{\}", ""), (r"\[\]", ""), (r"\([^a-zA-Z0-9ก-๙]+\)", ""), (r"\{[^a-zA-Z0-9ก-๙]+\}", ""), (r"\[[^a-zA-Z0-9ก-๙]+\]", ""), *((rf"({a})[^a-zA-Z0-9ก-๙]+([a-zA-Z0-9ก-๙])", r"\1\2") for a in (r"\(", r"\{", r"\[")), *((rf"([a-zA-Z0-9ก-๙])[^a-zA-Z0-9ก-๙]+({b})", r"\1\2") for b in (r"\)", r"\}", r"\]"))]
_DIRTY = "concat('see https://a.example/', p_size, '/x?y=(z) or www.b.example. ', p_name, ' () ( *x* ) [', p_size, '- ] {;}', chr(10), chr(10), chr(10), 'end')"


@query(f"""
WITH s AS (SELECT p_partkey, {_DIRTY} AS x FROM part)
SELECT p_partkey, {_chain('x', _BRACKETS)} AS brackets, regexp_replace(x, '\\n{{2,}}', ' ', 'g') AS newlines, replace(trim(x), chr(10), ' ') AS one_line, replace(x, ' ', '<_>') AS marked, regexp_replace(regexp_replace(x, 'https://a.example/[0-9]+/x.y=.z.', 'xxurl'), 'www.b.example[.]', 'xxurl.') AS urls,
  list_transform(string_split(x, ' '), lambda t: lower(t)) AS lowered, list_filter(list_transform(string_split(x, ' '), lambda t: trim(t, ' ')), lambda t: t <> '') AS trimmed FROM s""")
def cleaning_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("see https://a.example/"), F.col("p_size").cast("string"), F.lit("/x?y=(z) or www.b.example. "), "p_name", F.lit(" () ( *x* ) ["), F.col("p_size").cast("string"), F.lit("- ] {;}\n\n\nend"))
    s = _table(spark, sf_dir, "part").select("p_partkey", x.alias("x"))
    return s.select("p_partkey", T.rm_brackets("x").alias("brackets"), T.rm_useless_newlines("x").alias("newlines"), T.replace_newlines("x").alias("one_line"), T.replace_spaces("x").alias("marked"), T.replace_url("x").alias("urls"), T.lowercase_all(F.split("x", " ")).alias("lowered"), T.strip_whitespace(F.split("x", " ")).alias("trimmed"))


@query("""
WITH s AS (SELECT p_partkey, p_name || repeat('a', p_size % 9) || ' ' || repeat('!', p_size % 6) || 'z' AS x FROM part),
c AS (SELECT p_partkey, unnest(string_split(x, '')) AS c, generate_subscripts(string_split(x, ''), 1) AS i FROM s),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, c ORDER BY i) AS island FROM c),
r AS (SELECT p_partkey, c, min(i) AS i, count(*) AS n FROM g GROUP BY p_partkey, c, island)
SELECT p_partkey, string_agg(CASE WHEN n > 3 AND c <> ' ' THEN c || 'xxrep' || CAST(n AS VARCHAR) || ' ' ELSE repeat(c, n) END, '' ORDER BY i) AS counted, string_agg(CASE WHEN n > 3 AND c <> ' ' THEN c || ' xxrep ' ELSE repeat(c, n) END, '' ORDER BY i) AS bare FROM r GROUP BY p_partkey""")
def character_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat("p_name", F.repeat(F.lit("a"), F.col("p_size") % 9), F.lit(" "), F.repeat(F.lit("!"), F.col("p_size") % 6), F.lit("z"))
    s = _table(spark, sf_dir, "part").select("p_partkey", x.alias("x"))
    return s.select("p_partkey", T.replace_rep_after("x").alias("counted"), T.replace_rep_nonum("x").alias("bare"))


# Numbers, dates, times


def _small(n: str) -> str:
    return "(" + _sql_number(n, 6) + ")"


_POINT = "string_split(CAST(p_retailprice AS VARCHAR), '.')"


@query(f"""
WITH p AS (SELECT p_partkey, CAST({_POINT}[1] AS BIGINT) AS whole, rtrim(coalesce({_POINT}[2], ''), '0') AS part FROM part)
SELECT p_partkey, {_sql_number('whole')} || CASE WHEN part = '' THEN '' ELSE 'จุด' || {_digit_names('part')} END AS said FROM p""")
def decimal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", N.num_to_thaiword_float("p_retailprice").alias("said"))


_SIX_SQL = f"CASE WHEN h = 0 THEN 'เที่ยงคืน' WHEN h < 7 THEN 'ตี' || {_small('h')} WHEN h < 12 THEN {_small('(h - 6)')} || 'โมงเช้า' WHEN h = 12 THEN 'เที่ยง' WHEN h = 13 THEN 'บ่ายโมง' WHEN h < 18 THEN 'บ่าย' || {_small('(h - 12)')} || 'โมง' WHEN h = 18 THEN 'หกโมงเย็น' ELSE {_small('(h - 18)')} || 'ทุ่ม' END"
_OTHER_SQL = f"CASE WHEN h = 0 THEN 'เที่ยงคืน' WHEN h < 6 THEN 'ตี' || {_small('h')} WHEN h < 12 THEN {_small('h')} || 'โมง' WHEN h = 12 THEN 'เที่ยง' WHEN h < 19 THEN {_small('(h - 12)')} || 'โมง' ELSE {_small('(h - 18)')} || 'ทุ่ม' END"
_REST_SQL = f"CASE WHEN m = 0 THEN '' WHEN {{half}} AND m = 30 AND s = 0 THEN 'ครึ่ง' ELSE {_small('m')} || 'นาที' END || CASE WHEN s = 0 THEN '' ELSE {_small('s')} || 'วินาที' END"


@query(f"""
WITH t AS (SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS m, CAST(floor(second(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, {_small('h')} || 'นาฬิกา' || {_REST_SQL.format(half='false')} AS said_24h, {_SIX_SQL} || {_REST_SQL.format(half='true')} AS said_6h, {_OTHER_SQL} || {_REST_SQL.format(half='true')} AS said_m6h, lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') AS back FROM t""")
def time_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in words in three ways, and one of them read back."""
    said = _table(spark, sf_dir, "events").select("event_id", *(D.time_to_thaiword("ts", f).alias(f"said_{f}") for f in ("24h", "6h", "m6h")), D.time_to_thaiword(F.date_trunc("minute", "ts")).alias("minutes"))
    return said.select("event_id", "said_24h", "said_6h", "said_m6h", L.arrow(L.thaiword_to_time, "string")("minutes").alias("back"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST([0, 1, 2, -1, -2][o_orderkey % 5 + 1] AS INT) AS day FROM orders")
def day_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = _pick(["วันนี้", "พรุ่งนี้", "มะรืนนี้", "เมื่อวาน", "วานซืน"], "o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.thaiword_to_date(word, F.col("o_orderdate").cast("date")).cast("date").alias("day"))


@query("SELECT o_orderkey, (year(o_orderdate) - 78 - 0.45222) - 2.7118886 * floor((year(o_orderdate) - 78 - 0.45222) / 2.7118886) < 1 AS extra_month, CASE WHEN year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0 THEN 366 ELSE 365 END AS days FROM orders")
def lunar_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = _table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return years.select("o_orderkey", L.arrow(L.athikamas, "boolean")("y").alias("extra_month"), L.arrow(L.days_in_year, "int")("y").alias("days"))


# Segmenters on texts whose words are known: a number is cut into the names that it is made of


def _sql_parts(n: str) -> str:
    """The words of a number as a list."""
    return "list_filter(regexp_extract_all(" + _sql_number(n) + ", 'ศูนย์|หนึ่ง|เอ็ด|ยี่|สอง|สาม|สี่|ห้า|หก|เจ็ด|แปด|เก้า|สิบ|ร้อย|พัน|หมื่น|แสน|ล้าน'), lambda w: true)"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(N.num_to_thaiword("o_orderkey"), D.thai_strftime("o_orderdate", " %-d %B"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))


_SAID_SQL = f"WITH w AS (SELECT o_orderkey, {_sql_parts('o_orderkey')} AS words, CAST(day(o_orderdate) AS VARCHAR) AS d, {_MONTHS}[month(o_orderdate)] AS m FROM orders)"


def _engines(spark: SparkSession, sf_dir: str, **engines) -> DataFrame:
    """Numbers in words and dates, cut by engines (functions of a text and a dictionary) with a dictionary of their words: one Arrow function for all, so that texts reach Python once."""
    given = S.broadcast_words(spark, [*_NUMBER_WORDS, *D.MONTHS])
    cut = lambda t: {k: f(t, S.dictionary_of(given)) for k, f in engines.items()}
    return _spoken(spark, sf_dir).select("o_orderkey", L.arrow(cut, f"struct<{','.join(f'{n}:array<string>' for n in engines)}>")("said").alias("x")).select("o_orderkey", "x.*")


@query(f"{_SAID_SQL} SELECT o_orderkey, words || [d, m] AS newmm, words || [' ', d, ' ', m] AS longest FROM w")
def newmm_on_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engines(spark, sf_dir, newmm=lambda t, d: S.tokenize(t, d, keep_whitespace=False), longest=lambda t, d: S.tokenize(t, d, "longest"))


@query(f"{_SAID_SQL} SELECT o_orderkey, words || [' ', d, ' ', m] AS mm, words || [' ', d, ' ', m] AS safe, words || [' ', d, ' ', m] AS spans FROM w")
def engines_on_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engines(spark, sf_dir, mm=lambda t, d: S.tokenize(t, d, "mm"), safe=lambda t, d: S.tokenize(t, d, "newmm-safe"), spans=S.multi_cut)


@query(f"""
WITH w AS (SELECT o_orderkey, {_sql_parts('o_orderkey')} AS words FROM orders),
p AS (SELECT *, list_transform(words, lambda t, i: length(array_to_string(words[1 : i - 1], ''))) AS s, list_transform(words, lambda t, i: length(array_to_string(words[1 : i], ''))) AS e FROM w)
SELECT o_orderkey, s AS starts, e AS ends, list_transform(e, lambda x: x - 1) AS last, array_to_string(words, '') AS joined, list_transform(words, lambda t: t || t) AS doubled FROM p""")
def spans_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words in the joined text, words joined again, and each word said twice by a repetition mark."""
    given = S.broadcast_words(spark, _NUMBER_WORDS)
    w = _table(spark, sf_dir, "orders").select("o_orderkey", N.num_to_thaiword("o_orderkey").alias("said")).select("o_orderkey", S.word_tokenize("said", given, "longest").alias("words"))
    twice = L.arrow(lambda t: ["".join(S.expand_maiyamok([x, "ๆ"])) for x in t], "array<string>")
    spans, closed = S.spans("words"), S.inclusive_spans("words")
    return w.select("o_orderkey", F.transform(spans, lambda s: s["start"].cast("long")).alias("starts"), F.transform(spans, lambda s: s["end"].cast("long")).alias("ends"), F.transform(closed, lambda s: s["end"].cast("long")).alias("last"), S.detokenize("words").alias("joined"), twice("words").alias("doubled"))


@query(f"""
WITH w AS (SELECT o_orderkey, {_sql_parts('o_orderkey')} AS words FROM orders)
SELECT o_orderkey, [CASE WHEN o_orderkey = 0 THEN 'ศูนย์' ELSE CAST(o_orderkey AS VARCHAR) END, 'บาท'] AS read, list_filter(list_transform(words, lambda t, i: CASE WHEN list_position(words, t) = i THEN t ELSE '' END), lambda t: t <> '') AS once, round(CAST(o_orderkey AS DOUBLE) + 0.5, 6) AS with_half FROM w""")
def numbers_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals inside texts read, words without repeats, and decimals read."""
    given = S.broadcast_words(spark, _NUMBER_WORDS)
    s = _table(spark, sf_dir, "orders").select("o_orderkey", N.num_to_thaiword("o_orderkey").alias("said"))
    w = s.select("o_orderkey", F.concat("said", F.lit("บาท")).alias("text"), S.word_tokenize("said", given, "longest").alias("words"))
    return w.select(
        "o_orderkey", L.arrow(lambda t: L.text_to_num(t, ["บาท"]), "array<string>")("text").alias("read"), L.arrow(lambda t: L.remove_repeated_ngrams(t, 1), "array<string>")("words").alias("once"),
        F.round(L.arrow(lambda t: float(L.words_to_num([*t, "จุด", "ห้า"])), "double")("words"), 6).alias("with_half"),
    )


@query("""SELECT event_id, ['at', ' ', strftime(ts, '%H:%M:%S'), ' ', 'on', ' ', strftime(ts, '%d.%m.%Y')] AS joined, ['at', ' ', strftime(ts, '%H'), strftime(ts, ':%M:%S'), ' ', 'on', ' ', strftime(ts, '%d.%m.%Y')] AS apart, ['at', strftime(ts, '%H:%M:%S'), 'on', strftime(ts, '%d.%m.%Y')] AS pieces FROM events""")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and dates in texts, as one token each or as the tokens that they are made of; texts cut at blanks."""
    given = S.broadcast_words(spark, ["ก"])
    t = _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "'at' HH:mm:ss 'on' dd.MM.yyyy").alias("t"))
    cut = lambda t: {"joined": S.tokenize(t, S.dictionary_of(given)), "apart": S.tokenize(t, S.dictionary_of(given), join_numbers=False)}
    return t.select("event_id", L.arrow(cut, "struct<joined:array<string>,apart:array<string>>")("t").alias("x"), S.sentences("t", "whitespace").alias("pieces")).select("event_id", "x.joined", "x.apart", "pieces")


# Phonetic codes


def _sql_coded(x: str, classes: dict[str, str]) -> str:
    return f"translate({x}, '{''.join(classes.values())}', '{''.join(code * len(v) for code, v in classes.items())}')"


_LK_CODES = f"""list_filter(list_transform(r, lambda c, i: CASE
  WHEN c IN ('ะ', 'ั', 'ิ', 'ี') OR c = 'ุ' AND i > 1 AND r[i - 1] IN ('ต', 'ธ') THEN '-'
  WHEN c IN ('า', 'ึ', 'ื', 'ู', 'ๅ', 'ุ') OR c NOT IN ('ห', 'อ', 'ย', 'ร', 'ฤ', 'ฦ', 'ว') THEN {_sql_coded('c', L._LK_REST)}
  WHEN i < len(r) AND r[i + 1] IN ('ึ', 'ื', 'ุ', 'ู') OR c NOT IN ('ห', 'อ') AND i > 1 AND r[i - 1] IN ('ะ', 'ั', 'ิ', 'ี', 'า', 'ึ', 'ื', 'ู', 'ๅ', 'ุ') THEN {_sql_coded('c', L._LK_REST)}
  ELSE '' END), lambda c: c <> '')"""
_META = {"1": "กขฃคฆฅ", "2": "จฉชฌซฐฏทฑฒถธดฎตสศษ", "3": "ฟฝพผภบป", "4": "ง", "5": "ลฬรนณญ", "6": "ม", "7": "ย", "8": "ว", "0": "หฮอ"}
_ANY_PRAYUT = {k: v for k, v in L._PRAYUT.items() if k != "-"}


@query(f"""
WITH s AS (SELECT o_orderkey, {_sql_number('o_orderkey')} AS said FROM orders),
w AS (SELECT o_orderkey, said, regexp_replace(regexp_replace(said, '[่้๊๋]', '', 'g'), 'จน์|มณ์|ณฑ์|ทร์|ตร์|[ก-ฮ]์|[ก-ฮ][ะ-ู]์|[ฯฺๆ็ํ]', '', 'g') AS w FROM s),
h AS (SELECT *, substr(w, 1, 1) BETWEEN 'ก' AND 'ฮ' AS plain FROM w),
r AS (SELECT *, CASE WHEN plain THEN [{_sql_coded('substr(w, 1, 1)', L._LK_FIRST)}] ELSE [{_sql_coded('substr(w, 2, 1)', L._LK_FIRST)}, {_sql_coded('substr(w, 1, 1)', L._LK_REST)}] END AS head, string_split(substr(w, CASE WHEN plain THEN 2 ELSE 3 END), '') AS r FROM h),
c AS (SELECT *, head || {_LK_CODES} AS codes FROM r),
m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(said, '[^{C.CONSONANTS}์]', '', 'g'), '[{C.CONSONANTS}]์', '', 'g'), '์', '', 'g')[1:4] AS spoken FROM c)
SELECT o_orderkey, rpad(replace(array_to_string(list_filter(list_transform(codes, lambda x, i: CASE WHEN i > 1 AND codes[i - 1] = x THEN '' ELSE x END), lambda x: x <> ''), ''), '-', ''), 5, '0') AS lk82, rpad(substr(spoken, 1, 1) || {_sql_coded('substr(spoken, 2)', _META)}, 4, '0') AS metasound,
  right(regexp_replace(CASE WHEN substr(said, 1, 1) = 'อ' THEN '0' ELSE {_sql_coded('substr(said, 1, 1)', _ANY_PRAYUT)} END || replace({_sql_coded(_sql_coded("replace(substr(said, 2), 'ว', '1')", _ANY_PRAYUT), L._PRAYUT_LATER)}, 'ง', '52'), '[^0-9]', '', 'g'), 4) AS prayut FROM m""")
def phonetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "orders").select("o_orderkey", N.num_to_thaiword("o_orderkey").alias("said"))
    return s.select("o_orderkey", L.lk82("said").alias("lk82"), L.metasound("said").alias("metasound"), L.prayut_and_somchaip("said").alias("prayut"))


@query("""
WITH w AS (SELECT p_partkey, substr(p_name, 1, 6) AS a, substr(p_name, 2, 5) AS b FROM part)
SELECT p_partkey, round(len(list_filter(range(1, 7), lambda i: substr(a, i, 1) <> '' AND substr(a, i, 1) = substr(b, i, 1))) / greatest(length(a), length(b)), 9) AS alike FROM w""")
def code_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(L.code_similarity(F.substring("p_name", 1, 6), F.substring("p_name", 2, 5)), 9).alias("alike"))


# Scripts

_SOUNDS = ["k", "kh", "ng^", "aa", "ii", "xx", "2", "zz", "uua", "@"]


@query(f"""
WITH s AS (SELECT o_orderkey, {_sql_number('o_orderkey')} AS said, list_transform([1, 2, 3], lambda i: ['k', 'kh', 'ng^', 'aa', 'ii', 'xx', '2', 'zz', 'uua', '@'][(o_orderkey // i) % 10 + 1]) AS codes FROM orders),
t AS (SELECT *, array_to_string(list_transform(codes, lambda c: {_sql_map(X._NECTEC, 'c', 'c')}), ' ') AS ipa FROM s)
SELECT o_orderkey, array_to_string(list_transform(string_split(said, ''), lambda c: {_sql_map(X.ISO_11940, 'c', 'c')}), '') AS iso, ipa, regexp_replace(ipa, '˩˩˦|˥˩|˨˩|˦˥|˧', '', 'g') AS toneless, ['ไม้เอก', 'ไม้โท', 'ไม้ตรี', 'ไม้จัตวา', 'ก'][o_orderkey % 5 + 1] AS mark FROM t""")
def scripts_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transliteration by letter, sounds of one notation in another, names of marks."""
    code = lambda i: F.get(F.array(*map(F.lit, _SOUNDS)), (F.floor(F.col("o_orderkey") / i) % len(_SOUNDS)).cast("int"))
    s = _table(spark, sf_dir, "orders").select("o_orderkey", N.num_to_thaiword("o_orderkey").alias("said"), F.concat_ws("-", code(1), code(2), code(3)).alias("codes"))
    s = s.withColumn("ipa", X.nectec_to_ipa("codes"))
    return s.select("o_orderkey", X.iso_11940("said").alias("iso"), "ipa", X.remove_tone_ipa("ipa").alias("toneless"), X.tone_to_spelling(_pick([*C.TONE_MARKS, "ก"], "o_orderkey")).alias("mark"))


# Lookups, spans, evaluation


@query("""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)
SELECT p_partkey, CAST(pos AS INT) AS pos, token FROM t WHERE token IN (SELECT DISTINCT string_split(p_name, ' ')[1] FROM part WHERE p_partkey % 50 = 0)""")
def find_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names that a list has."""
    p = _table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    return R.find_listed(p, "tokens", p.filter("p_partkey % 50 = 0").select(F.get("tokens", F.lit(0)).alias("word")), "p_partkey")


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), b AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS word FROM part WHERE p_partkey % 50 = 0)
SELECT word FROM w EXCEPT SELECT word FROM b""")
def revise_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    words = p.select(F.explode("tokens").alias("word")).distinct()
    return R.revise_words(words, p.filter("p_partkey % 50 = 0").select(F.get("tokens", F.lit(0)).alias("word")).distinct())


@query("""
WITH g AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part),
f AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [t[1] || t[2]] || t[3 :] ELSE t END AS t FROM g),
gs AS (SELECT p_partkey, unnest(list_transform(t, lambda x, i: length(array_to_string(t[1 : i - 1], '')))) AS s, unnest(list_transform(t, lambda x, i: length(array_to_string(t[1 : i], '')))) AS e FROM g),
fs AS (SELECT p_partkey, unnest(t) AS word, unnest(list_transform(t, lambda x, i: length(array_to_string(t[1 : i - 1], '')))) AS s, unnest(list_transform(t, lambda x, i: length(array_to_string(t[1 : i], '')))) AS e FROM f)
SELECT word, sum(CASE WHEN gs.s IS NULL THEN 1 ELSE 0 END)::BIGINT AS wrong, sum(CASE WHEN gs.s IS NULL THEN 0 ELSE 1 END)::BIGINT AS "right" FROM fs LEFT JOIN gs USING (p_partkey, s, e) GROUP BY word HAVING wrong > "right" """)
def bad_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that one segmentation of names finds wrongly more often than rightly, by another."""
    gold = _table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    glued = F.concat(F.array(F.concat(F.col("tokens")[0], F.col("tokens")[1])), F.slice("tokens", 3, F.size("tokens")))
    found = gold.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, glued).otherwise(F.col("tokens")).alias("tokens"))
    return R.bad_words(gold, found, "p_partkey")


@query("""
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS w1 FROM part), c AS (SELECT w1, count(*) AS n FROM w GROUP BY w1)
SELECT w1, n, round(n / sum(n) OVER (), 9) AS prob FROM c""")
def unigram_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w1")).groupBy("w1").agg(F.count("*").alias("n"))
    return R.ngram_probabilities(counts).withColumn("prob", F.round("prob", 9))


@query("""
WITH t AS (SELECT n_regionkey AS head, n_name AS syn FROM nation), m AS (SELECT r_name AS word, n_name AS syn FROM region JOIN nation ON r_regionkey = n_regionkey),
b AS (SELECT word, syn FROM m UNION SELECT syn, word FROM m UNION SELECT x.syn, y.syn FROM m x JOIN m y USING (word))
SELECT word, syn AS synonym FROM b WHERE word <> syn AND (word IN (SELECT n_name FROM nation) OR word IN (SELECT r_name FROM region))""")
def find_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that share a region, both ways."""
    from saithong.sources import lexicons

    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    table = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("word"), F.col("n_name").alias("synonym"))
    words = n.select(F.col("n_name").alias("word")).union(r.select("r_name"))
    return lexicons.find_synonyms(table, words)


@query("""
WITH s AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM conversations),
p AS (SELECT conv_id, CAST(k * 40 AS BIGINT) AS s, CAST(k * 40 + 6 AS BIGINT) AS e FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 12) AS r(k))
SELECT conv_id, turn, p.s AS start, p.e AS "end", substr(text, CAST(p.s - f + 1 AS BIGINT), 7) AS word FROM s JOIN p USING (conv_id) WHERE p.s >= f AND p.e < f + length(text)""")
def spans_to_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over whole conversations cut out of the turns that hold them."""
    c = _table(spark, sf_dir, "conversations")
    spans = c.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select("conv_id", (F.col("k") * 40).cast("long").alias("start"), (F.col("k") * 40 + 6).cast("long").alias("end"))
    found = E.spans_to_sentences(c.select("conv_id", F.col("turn").alias("pos"), "text"), spans, "conv_id")
    return found.select("conv_id", F.col("pos").alias("turn"), "start", "end", "word")


_TAGS = "CASE WHEN turn % 3 = 0 THEN 'B-X' WHEN turn % 3 = 1 THEN 'I-X' ELSE 'O' END"


@query(f"""
WITH t AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role AS token, {_TAGS} AS tag FROM conversations),
b AS (SELECT *, tag = 'O' OR tag = 'B-X' OR coalesce(lag(tag) OVER (PARTITION BY k ORDER BY pos), 'O') = 'O' AS begins FROM t),
i AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS island FROM b),
r AS (SELECT k, island, min(tag) AS tag, string_agg(token, '' ORDER BY pos) AS text FROM i GROUP BY k, island)
SELECT k, string_agg(CASE WHEN tag = 'O' THEN text ELSE '<X>' || text || '</X>' END, '' ORDER BY island) AS text, list(text ORDER BY island) AS tokens FROM r GROUP BY k""")
def inline_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities between tags in the text, and tokens with each entity as one."""
    from pyspark.sql import Window

    c = _table(spark, sf_dir, "conversations")
    tag = F.when(F.col("turn") % 3 == 0, "B-X").when(F.col("turn") % 3 == 1, "I-X").otherwise("O")
    t = c.select(F.col("conv_id").alias("k"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("pos"), F.col("role").alias("token"), tag.alias("tag"))
    merged = E.merge_entities(t, "k").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    return E.inline_tags(t, "k").join(merged, "k")


@query("""
SELECT p_partkey, regexp_full_match(p_brand, '[0-9]+') AS digits, regexp_full_match(p_brand, '[\\x{0E00}-\\x{0E7F}]+') AS thai, left(p_brand, 3) AS prefix, right(p_brand, 3) AS suffix, CAST(length(p_brand) AS INT) AS length,
  list_transform(range(0, 8), lambda i: [string_split(p_name, ' ')[i // 4 % 2 + 1], [p_type, p_brand][i // 2 % 2 + 1], string_split(p_brand, '#')[i % 2 + 1]]) AS ways FROM part""")
def shapes_and_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What taggers ask of a token, and all ways to pick one word of each of three."""
    shape = E.token_shape("p_brand")
    two = lambda c, sep: F.slice(F.split(c, sep), 1, 2)
    ways = E.combinations(F.array(two("p_name", " "), F.array("p_type", "p_brand"), two("p_brand", "#")))
    return _table(spark, sf_dir, "part").select("p_partkey", *(shape[k].alias(k) for k in ("digits", "thai", "prefix", "suffix", "length")), ways.alias("ways"))


@query("""
WITH w AS (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word, generate_subscripts(string_split(n_name, ' '), 1) - 1 AS pos FROM nation)
SELECT n_nationkey, CAST(pos AS INT) AS pos, word, r_comment AS romanized FROM w LEFT JOIN (SELECT DISTINCT n_name, r_name AS r_comment FROM nation JOIN region ON n_regionkey = r_regionkey) ON word = n_name""")
def romanize_by_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    readings = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("word"), F.col("r_name").alias("reading"))
    return E.romanize_by_lookup(n, "n_name", readings, "n_nationkey")


@query("""
WITH s AS (SELECT p_partkey, replace(p_name, ' ', '|') AS e, regexp_replace(p_name, '^(\\S+) ', '\\1') AS a FROM part),
w AS (SELECT p_partkey, string_split(e, '|') AS e, string_split(a, ' ') AS a FROM s),
x AS (SELECT p_partkey, unnest(list_transform(e, lambda t, i: length(array_to_string(e[1 : i - 1], '')))) AS s, unnest(list_transform(e, lambda t, i: length(array_to_string(e[1 : i], '')))) AS f FROM w),
y AS (SELECT p_partkey, unnest(list_transform(a, lambda t, i: length(array_to_string(a[1 : i - 1], '')))) AS s, unnest(list_transform(a, lambda t, i: length(array_to_string(a[1 : i], '')))) AS f FROM w),
j AS (SELECT count(x.s) FILTER (y.s IS NOT NULL) AS tp, count(y.s) FILTER (x.s IS NULL) AS fp, count(x.s) FILTER (y.s IS NULL) AS fn, count(y.f) FILTER (y.f = x.f) AS correct, count(y.s) AS words, count(x.s) AS expected FROM x FULL JOIN y USING (p_partkey, s))
SELECT round(tp / (tp + fp), 9) AS char_precision, round(tp / (tp + fn), 9) AS char_recall, round(correct / words, 9) AS word_precision, round(correct / expected, 9) AS word_recall FROM j""")
def segmentation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a segmentation in which first words are glued, with its cleaning."""
    tagged = F.concat(F.regexp_replace("p_name", " ", "||"), F.lit("|"))
    s = _table(spark, sf_dir, "part").select("p_partkey", R.clean_segmentation(tagged).alias("e"), F.regexp_replace(F.regexp_replace("p_name", r"^(\S+) ", "$1"), " ", "|").alias("a"))
    scores = R.segmentation_scores(R.segmentation_stats(s, "e", "a", "p_partkey"))
    return scores.select(*(F.round(c, 9).alias(c) for c in scores.columns))


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part), v AS (SELECT DISTINCT token, length(token) AS x, ascii(token) AS y FROM w),
n AS (SELECT p_partkey, count(*) AS n FROM w GROUP BY p_partkey)
SELECT p_partkey, i, round(sum(CASE WHEN i = 0 THEN x ELSE y END) / any_value(n), 9) AS value FROM w JOIN v USING (token) JOIN n USING (p_partkey), (SELECT CAST(unnest([0, 1]) AS INT) AS i) GROUP BY p_partkey, i""")
def sentence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of names, of words whose vectors are their length and first letter."""
    p = _table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    vectors = p.select(F.explode("tokens").alias("word")).distinct().select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double")).alias("vector"))
    return R.sentence_vectors(p, "tokens", vectors, "p_partkey").withColumn("value", F.round("value", 9))


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ') || [p_type]) AS word FROM part),
u AS (SELECT p_partkey, word, length(word) / sqrt(length(word) * length(word) + ascii(word) * ascii(word)) AS x, ascii(word) / sqrt(length(word) * length(word) + ascii(word) * ascii(word)) AS y FROM w),
m AS (SELECT p_partkey, avg(x) AS mx, avg(y) AS my FROM u GROUP BY p_partkey)
SELECT p_partkey, arg_min(word, (round(x * mx + y * my, 12), word)) AS word FROM u JOIN m USING (p_partkey) GROUP BY p_partkey""")
def odd_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a part's words the one whose vector (its length and first letter) is farthest from the others'."""
    words = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("word"))
    vectors = words.select("word").distinct().select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double")).alias("vector"))
    return E.odd_one_out(words, vectors, "p_partkey")


# Calendars, sentences, tags, spelling, word nets

_LUNAR = """
WITH RECURSIVE a AS (SELECT y, ((y - 78 - 0.45222) - 2.7118886 * floor((y - 78 - 0.45222) / 2.7118886)) < 1 AS long FROM range(1901, 2030) AS r(y)),
n AS (SELECT a.y, a.long, b.long AS next_long FROM a JOIN a b ON b.y = a.y + 1),
d(y, dev, days, last) AS (
  SELECT CAST(1901 AS BIGINT), CAST(0.122733000004352 AS DOUBLE), 0, DATE '1902-11-30'
  UNION ALL
  SELECT n.y, v, k, CASE WHEN n.y > 1902 THEN last + CAST(k AS INT) ELSE last END FROM (
    SELECT n.y, last, v, CASE WHEN n.long THEN 384 WHEN v > CASE WHEN n.next_long THEN 0.0169501433191599 ELSE -0.0142223099315486 END THEN 355 ELSE 354 END AS k
    FROM (SELECT d.y + 1 AS y, last, dev + CASE WHEN p.long THEN -0.102356 WHEN dev > CASE WHEN p.next_long THEN 0.0169501433191599 ELSE -0.0142223099315486 END THEN -0.632944 ELSE 0.367056 END AS v FROM d JOIN n p ON p.y = d.y WHERE d.y < 2028) x JOIN n ON n.y = x.y) n),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
m AS (SELECT o_orderkey, date_diff('day', e.last, day) AS n, t.days FROM o JOIN d e ON e.y = year(day) - 1 JOIN d t ON t.y = year(day)),
l AS (SELECT o_orderkey, n, days, CASE days WHEN 384 THEN [29, 30, 29, 30, 29, 30, 29, 30, 30, 29, 30, 29, 30, 29, 30] WHEN 355 THEN [29, 30, 29, 30, 29, 30, 30, 30, 29, 30, 29, 30, 29, 30] ELSE [29, 30, 29, 30, 29, 30, 29, 30, 29, 30, 29, 30, 29, 30] END AS l FROM m),
k AS (SELECT o_orderkey, n, days, l, list_filter(range(1, len(l) + 1), lambda i: n <= list_sum(l[1 : i]))[1] AS k FROM l),
f AS (SELECT o_orderkey, days, k, n - coalesce(list_sum(l[1 : k - 1]), 0) AS n FROM k)
SELECT o_orderkey, CASE WHEN n > 15 THEN 'แรม ' || CAST(CAST(n - 15 AS INT) AS VARCHAR) ELSE 'ขึ้น ' || CAST(CAST(n AS INT) AS VARCHAR) END || ' ค่ำ เดือน ' || CAST(CASE WHEN days < 384 THEN (k - 1) % 12 + 1 WHEN k > 13 THEN k - 13 WHEN k >= 9 THEN k - 1 ELSE k END AS VARCHAR) AS lunar FROM f"""


@query(_LUNAR)
def lunar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lunar dates by a dimension of the days that orders have."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    days = o.select(F.col("d").alias("day")).distinct().select("day", L.lunar_date("day").alias("lunar"))
    return o.join(days, F.col("d") == F.col("day")).select("o_orderkey", "lunar")


@query(f"""
WITH s AS (SELECT o_orderkey, {_sql_number('o_orderkey')} AS x FROM orders)
SELECT o_orderkey, [x, 'เมื่อ' || x || 'ค่ะ', x || '!', 'เพราะ' || x || 'ทำเพื่อเพื่อน', '12.นาย' || x] AS sentences FROM s""")
def sentences_by_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with cue words, signs, numbered items, and cues that are part of other words, cut into sentences."""
    from saithong.operators import sentences as Z

    given = S.broadcast_words(spark, _NUMBER_WORDS)
    x = N.num_to_thaiword("o_orderkey")
    s = _table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"))
    text = F.concat("x", F.lit(" เมื่อ"), "x", F.lit("ค่ะ"), "x", F.lit("!เพราะ"), "x", F.lit("ทำเพื่อเพื่อน 12.นาย"), "x")
    return s.select("o_orderkey", Z.thai_sentences(text, given).alias("sentences"))


_TAG_SAMPLES = ["NCMN", "VACT", "JSBR", "", "NLBL", "RPRE", "ZZZ"]
_SQL_UD = "map(['NCMN', 'VACT', 'JSBR', '', 'NLBL', 'RPRE'], ['NOUN', 'VERB', 'SCONJ', '', 'NUM', 'ADP'])"
_TAGGED_WORDS = ["คน", "การ", "<space>", "+", "<comma>"]


@query(f"""
WITH s AS (SELECT p_partkey, {_sql_pick(_TAGGED_WORDS, 'p_partkey')} AS w, {_sql_pick(_TAG_SAMPLES, '(p_partkey // 2)')} AS t FROM part)
SELECT p_partkey, CASE w WHEN '+' THEN '<plus>' ELSE w END AS named, CASE w WHEN '<space>' THEN ' ' WHEN '<comma>' THEN ',' ELSE w END AS word, CASE WHEN w = 'การ' THEN 'NOUN' ELSE {_SQL_UD}[t] END AS tag, map(['NCMN', 'VACT', 'JSBR', '', 'NLBL', 'RPRE'], ['n', 'v', '', '', '', ''])[t] AS net FROM s""")
def corpus_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of signs in a corpus and back, its tags as universal ones and a word net's."""
    from saithong.operators import tagging as G

    tag = F.get(F.array(*map(F.lit, _TAG_SAMPLES)), (F.floor(F.col("p_partkey") / 2) % len(_TAG_SAMPLES)).cast("int"))
    s = _table(spark, sf_dir, "part").select("p_partkey", _pick(_TAGGED_WORDS, "p_partkey").alias("w"), tag.alias("t"))
    back = G.restore_signs(F.array(F.struct(F.col("w").alias("word"), F.col("t").alias("tag"))), universal=True)[0]
    return s.select("p_partkey", G.name_signs(F.array("w"))[0].alias("named"), back["word"].alias("word"), back["tag"].alias("tag"), G.wordnet_pos("t").alias("net"))


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part),
l AS (SELECT token AS word, len(token) % 3 AS kind FROM (SELECT DISTINCT token FROM w))
SELECT p_partkey, list(CASE WHEN length(token) % 3 = 0 THEN '' ELSE 'T' || CAST(length(token) % 3 AS VARCHAR) END ORDER BY pos) AS tags FROM w GROUP BY p_partkey""")
def tags_by_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of names' words by a table of words and tags, which lacks some."""
    from saithong.operators import tagging as G

    p = _table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    lexicon = p.select(F.explode("tokens").alias("word")).distinct().select("word", F.concat(F.lit("T"), (F.length("word") % 3).cast("string")).alias("tag")).filter("tag <> 'T0'")
    return G.pos_tag(p, "tokens", "p_partkey", lexicon=lexicon).select("p_partkey", F.transform("tagged", lambda x: x["tag"]).alias("tags"))


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part),
t AS (SELECT p_partkey, pos, left(word, length(word) - 1) AS token FROM w), l AS (SELECT word, count(*) AS n FROM w GROUP BY word),
c AS (SELECT token, word, n, levenshtein(token, word) AS d FROM (SELECT DISTINCT token FROM t), l WHERE levenshtein(token, word) <= 2),
b AS (SELECT token, list(word ORDER BY n DESC, word) AS candidates FROM (SELECT *, min(d) OVER (PARTITION BY token) AS m FROM c) WHERE d = m GROUP BY token)
SELECT p_partkey, CAST(pos AS INT) AS pos, t.token, coalesce(candidates, [t.token]) AS candidates FROM t LEFT JOIN b ON t.token = b.token""")
def spell_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names without their last letter, and the words that are nearest to them."""
    p = _table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    lexicon = p.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    typed = p.select("p_partkey", F.transform("tokens", lambda t: F.left(t, F.length(t) - 1)).alias("typed"))
    return L.spell_words(typed, "typed", lexicon, "p_partkey")


@query("""
WITH RECURSIVE n AS (SELECT max(p_partkey) AS n FROM part), p AS (SELECT p_partkey AS a, (p_partkey * 7) % n + 1 AS b FROM part, n),
up(node, anc, steps) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT node, anc // 2, steps + 1 FROM up WHERE anc > 1),
m AS (SELECT a, b, x.anc, x.steps + y.steps AS steps, 1 + (SELECT max(steps) FROM up u WHERE u.node = x.anc) AS depth FROM p JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.anc = x.anc),
s AS (SELECT a, b, min(steps) AS steps, max(depth) AS depth FROM m GROUP BY a, b), h AS (SELECT max(steps) + 1 AS h FROM up)
SELECT a, b, CAST(steps AS INT) AS steps, round(1 / (steps + 1), 9) AS path, round(ln(2.0 * h / (steps + 1)), 9) AS lch, round(2.0 * depth / (2 * depth + steps), 9) AS wup FROM (SELECT p.a, p.b, s.steps, s.depth FROM p LEFT JOIN s USING (a, b)), h""")
def taxonomy_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of nodes of a tree: each part's parent is the one with half its key."""
    from saithong.operators import wordnet as W

    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    up = p.filter("k > 1").select(F.col("k").alias("child"), F.floor(F.col("k") / 2).alias("parent"))
    n = p.agg(F.max("k").alias("n"))
    pairs = p.crossJoin(F.broadcast(n)).select(F.col("k").alias("a"), ((F.col("k") * 7) % F.col("n") + 1).alias("b"))
    return W.similarities(pairs, up, depth=24, height=W.height_of(up, 24)).select("a", "b", "steps", *(F.round(c, 9).alias(c) for c in ("path", "lch", "wup")))


@query("""
WITH s AS (SELECT n_regionkey AS synset, 'en' AS lang, n_name AS lemma FROM nation UNION ALL SELECT r_regionkey, 'xx', r_name FROM region),
w AS (SELECT synset, lemma AS word FROM s WHERE lang = 'en')
SELECT word, s.lemma AS found, 'translation' AS kind FROM w JOIN s USING (synset) WHERE lang = 'xx' UNION ALL SELECT word, s.lemma, 'synonym' FROM w JOIN s USING (synset) WHERE lang = 'en' AND s.lemma <> word
UNION ALL SELECT lower(n_name) || 's', lower(n_name), 'base' FROM nation""")
def wordnet_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms and translations by common synsets, and words without an ending."""
    from saithong.operators import wordnet as W

    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    senses = n.select(F.col("n_regionkey").alias("synset"), F.lit("n").alias("pos"), F.lit("en").alias("lang"), F.col("n_name").alias("lemma")).unionByName(r.select(F.col("r_regionkey").alias("synset"), F.lit("n").alias("pos"), F.lit("xx").alias("lang"), F.col("r_name").alias("lemma")))
    words = n.select(F.col("n_name").alias("word"))
    own = W.synsets(words, senses, "en")
    there = own.join(W.lemmas(own, senses, "xx"), "synset").select("word", F.col("lemma").alias("found"), F.lit("translation").alias("kind"))
    alike = W.synonyms(words, senses, "en").select("word", F.col("synonym").alias("found"), F.lit("synonym").alias("kind"))
    low = senses.filter("lang = 'en'").withColumn("lemma", F.lower("lemma"))
    base = W.morphy(words.select(F.concat(F.lower("word"), F.lit("s")).alias("word")), low, [("s", ""), ("es", "")], "en").select("word", F.col("base").alias("found"), F.lit("base").alias("kind"))
    return there.unionByName(alike).unionByName(base)


# Streams


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Events as a stream, and a new folder that driver and executors share."""
    import tempfile
    import uuid

    schema = _table(spark, sf_dir, "events").schema
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{shared.rstrip('/')}/saithong/stream-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='saithong-')}"
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event*.parquet"), folder


@query("""
WITH t AS (SELECT date_trunc('day', ts) AS start, unnest(regexp_extract_all(event_type || ' ' || props, '[a-z]+')) AS token FROM events)
SELECT CAST(start AS VARCHAR) AS start, token, count(*) AS n FROM t GROUP BY ALL""")
def stream_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of events' types and properties, counted day by day as a stream."""
    from saithong.streaming import tokens as K

    events, folder = _stream(spark, sf_dir)
    words = events.select("ts", F.regexp_extract_all(F.concat_ws(" ", "event_type", "props"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    return K.run_to_end(K.windowed_counts(words, "tokens", "ts", window="1 day"), folder).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "token", "n")


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users in the stream of events."""
    from saithong.streaming import tokens as K

    events, folder = _stream(spark, sf_dir)
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return K.run_to_end(K.sessions(events, "user_id", "ts"), folder).select("user_id", clock("start"), clock("end"), "n")
