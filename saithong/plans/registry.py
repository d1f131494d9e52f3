"""Queries of the text operators over the driver's tables, with their SQL.

The SQL is written on its own: it shares no expression with the Spark plan. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saithong.functions import dates as D
from saithong.functions import numbers as N
from saithong.functions import text as T
from saithong.operators import corpus as R
from saithong.operators import lexical as L
from saithong.operators import segment as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: A few frequent words of the generated prose.
STOP_WORDS = ["the", "and", "of", "to", "in", "a", "it", "de", "la", "der", "die", "und"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


_STOP_SQL = "(VALUES " + ", ".join(f"('{w}')" for w in STOP_WORDS) + ") AS s(word)"
_TOKENS_SQL = "regexp_extract_all(text, '(?:[-a-zA-Z]+|\\p{Nd}+(?:[,.]\\p{Nd}+)*|[ \\t]+|\\r?\\n|[^\\x{0E00}-\\x{0E7F} \\t\\r\\n]+|\\r)')"
_WORDS_SQL = f"list_filter(list_transform({_TOKENS_SQL}, lambda x: trim(x, ' ')), lambda x: x <> '')"


def _with_words(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return _table(spark, sf_dir, table).withColumn("tokens", S.foreign_tokenize("text", keep_whitespace=False))


def _sql_number(n: str, digits: int = 12) -> str:
    """SQL for a whole number from 0 on in Thai words, of up to 12 digits."""
    names = "['', 'หนึ่ง', 'สอง', 'สาม', 'สี่', 'ห้า', 'หก', 'เจ็ด', 'แปด', 'เก้า']"
    digit = lambda place: f"CAST(substr(lpad(CAST({n} AS VARCHAR), {digits}, '0'), {digits - place}, 1) AS INT)"
    pieces = []
    for block in range(digits // 6 - 1, -1, -1):
        low = 6 * block
        for place, unit in ((5, "แสน"), (4, "หมื่น"), (3, "พัน"), (2, "ร้อย")):
            pieces.append(f"CASE WHEN {digit(low + place)} > 0 THEN {names}[{digit(low + place)} + 1] || '{unit}' ELSE '' END")
        tens, ones = digit(low + 1), digit(low)
        pieces.append(f"CASE {tens} WHEN 0 THEN '' WHEN 1 THEN 'สิบ' WHEN 2 THEN 'ยี่สิบ' ELSE {names}[{tens} + 1] || 'สิบ' END")
        alone = f"{n} = 1" if block == 0 else f"({n} // {10**low}) % 1000000 = 1"
        pieces.append(f"CASE WHEN {ones} = 1 AND NOT ({alone}) THEN 'เอ็ด' ELSE {names}[{ones} + 1] END")
        if block:
            pieces.append(f"CASE WHEN {n} >= {10**low} THEN 'ล้าน' ELSE '' END")
    return f"CASE WHEN {n} = 0 THEN 'ศูนย์' ELSE " + " || ".join(pieces) + " END"


# Tokens, counts, keywords


@query(f"""
WITH t AS (SELECT lang, unnest({_WORDS_SQL}) AS token FROM documents),
c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS place FROM c
QUALIFY place <= 10""")
def token_freq_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of newmm's native form, counted; the ten most frequent of each language."""
    from pyspark.sql import Window

    counts = R.rank(_with_words(spark, sf_dir), "tokens", "lang")
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token")))
    return placed.filter("place <= 10").select("lang", "token", "n", "place")


@query(f"SELECT doc_id, len({_TOKENS_SQL}) AS n_tokens, CAST(list_sum(list_transform({_TOKENS_SQL}, lambda x: length(x))) AS BIGINT) AS n_chars_kept, md5(array_to_string({_TOKENS_SQL}, '|')) AS tokens_md5 FROM documents")
def word_tokenize_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native tokenizer for texts without Thai: all tokens of all texts."""
    t = _table(spark, sf_dir, "documents").select("doc_id", S.foreign_tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars_kept"), F.md5(F.array_join("t", "|").cast("binary")).alias("tokens_md5"))


@query(f"""
WITH t AS (SELECT unnest({_WORDS_SQL}) AS token FROM documents)
SELECT token, count(*) AS n FROM t WHERE token NOT IN (SELECT word FROM {_STOP_SQL}) GROUP BY token""")
def rank_without_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank(_with_words(spark, sf_dir), "tokens", stop_words=_stop_words(spark))


@query(f"""
WITH t AS (SELECT source, unnest({_WORDS_SQL}) AS token FROM documents)
SELECT source, token, count(*) AS n FROM t WHERE token NOT IN (SELECT word FROM {_STOP_SQL}) GROUP BY ALL HAVING count(*) >= 20""")
def find_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.find_keyword(_with_words(spark, sf_dir), "tokens", "source", stop_words=_stop_words(spark), least=20)


@query(f"""
WITH d AS (SELECT lang, {_WORDS_SQL} AS t FROM documents),
g AS (SELECT lang, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i : i + n - 1], ' '))) AS ngram FROM d, (VALUES (2), (3)) AS k(n))
SELECT lang, CAST(n AS INT) AS n, ngram, count(*) AS count FROM g GROUP BY ALL""")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ngram_counts(_with_words(spark, sf_dir), "tokens", "lang", least=2, most=3)


@query(f"""
WITH t AS (SELECT doc_id, unnest({_WORDS_SQL}) AS token, generate_subscripts({_WORDS_SQL}, 1) AS pos FROM documents),
c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM t WHERE token NOT IN (SELECT word FROM {_STOP_SQL}) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS place FROM c)
SELECT doc_id, CAST(place AS INT) AS place, token, n FROM p WHERE place <= 5 AND n >= 2""")
def extract_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extract_keywords(_with_words(spark, sf_dir), "tokens", "doc_id", most=5, least=2, stop_words=_stop_words(spark))


@query(f"""
WITH s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)),
w AS (SELECT doc_id, line, unnest(string_split(sentence, ' ')) AS word FROM s),
c AS (SELECT doc_id, word, count(*) AS c FROM w WHERE word NOT IN (SELECT word FROM {_STOP_SQL}) GROUP BY ALL),
f AS (SELECT doc_id, word, c / max(c) OVER (PARTITION BY doc_id) AS f FROM c),
x AS (SELECT w.doc_id, w.line, sum(f.f) AS score FROM w JOIN f ON w.doc_id = f.doc_id AND w.word = f.word WHERE f.f > 0.1 AND f.f < 0.9 GROUP BY ALL),
r AS (SELECT s.doc_id, s.sentence, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(coalesce(x.score, 0), 9) DESC, s.line) AS place FROM s LEFT JOIN x ON s.doc_id = x.doc_id AND s.line = x.line)
SELECT doc_id, CAST(place AS INT) AS place, sentence FROM r WHERE place <= 2""")
def summarize_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x != ""))
    return R.summarize_by_frequency(docs, "lines", "doc_id", n=2, stop_words=_stop_words(spark))


# Metrics


_PAIRS_SQL = "(SELECT a.conv_id, a.turn, string_split(a.text, ' ') AS r, string_split(b.text, ' ') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation and the one after, whole."""
    t = _table(spark, sf_dir, "conversations")
    a = t.select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("a"))
    b = t.select(F.struct(F.col("conv_id").alias("k"), (F.col("turn") - 1).alias("turn")).alias("of"), F.col("text").alias("b"))
    return a.join(b, (F.col("key.conv_id") == F.col("of.k")) & (F.col("key.turn") == F.col("of.turn"))).select("key", "a", "b", F.split("a", " ").alias("r"), F.split("b", " ").alias("h"))


def _rouge_sql(n: int) -> str:
    gram = f"list_transform(range(1, len({{}}) - {n} + 2), lambda i: array_to_string({{}}[i : i + {n - 1}], chr(31)))"
    return f"""
WITH p AS {_PAIRS_SQL},
a AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest({gram.format('r', 'r')}) AS g FROM p) GROUP BY ALL),
b AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest({gram.format('h', 'h')}) AS g FROM p) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(a.c, b.c)) AS o FROM a JOIN b USING (conv_id, turn, g) GROUP BY ALL),
s AS (SELECT conv_id, turn, coalesce(o.o, 0) AS o, greatest(len(r) - {n - 1}, 0) AS nr, greatest(len(h) - {n - 1}, 0) AS nh FROM p LEFT JOIN o USING (conv_id, turn)),
{_F1_SQL}"""


_F1_SQL = """q AS (SELECT conv_id, turn, CASE WHEN nh > 0 THEN o / nh ELSE 0.0 END AS p, CASE WHEN nr > 0 THEN o / nr ELSE 0.0 END AS r FROM s)
SELECT conv_id, turn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS fmeasure FROM q"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _scores(df: DataFrame) -> DataFrame:
    return _rounded(df.select("key.*", "precision", "recall", "fmeasure"), "precision", "recall", "fmeasure")


@query(_rouge_sql(1))
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(R.rouge_n(_turn_pairs(spark, sf_dir), "r", "h", "key", 1))


@query(_rouge_sql(2))
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(R.rouge_n(_turn_pairs(spark, sf_dir), "r", "h", "key", 2))


def _rows_sql(first: str, column: str, running: str, last: str) -> str:
    """A recursive query over the rows of a dynamic program: `first` row, a row's columns from the row above (lists from 1 to n + 1), the same with what comes from the left, and the value at the end."""
    return f"""
WITH RECURSIVE p AS {_PAIRS_SQL},
d(conv_id, turn, i, r, h, c) AS (
  SELECT conv_id, turn, 0, r, h, {first} FROM p
  UNION ALL
  SELECT conv_id, turn, i, r, h, {running} FROM (SELECT conv_id, turn, i + 1 AS i, r, h, list_transform(range(1, len(h) + 2), lambda j: {column}) AS c FROM d WHERE i < len(r))),
e AS (SELECT conv_id, turn, len(r) AS nr, len(h) AS nh, c[len(h) + 1] AS o FROM d WHERE i = len(r)),
{last}"""


@query(_rows_sql("list_transform(range(0, len(h) + 1), lambda j: 0)", "CASE WHEN j > 1 AND r[i + 1] = h[j - 1] THEN greatest(c[j], c[j - 1] + 1) ELSE c[j] END", "list_transform(range(1, len(h) + 2), lambda j: list_max(c[1 : j]))", f"s AS (SELECT * FROM e), {_F1_SQL}"))
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(R.rouge_l(_turn_pairs(spark, sf_dir), "r", "h", "key"))


@query(_rows_sql("range(0, len(h) + 1)", "CASE WHEN j > 1 THEN least(c[j] + 1, c[j - 1] + CASE WHEN r[i + 1] = h[j - 1] THEN 0 ELSE 1 END) ELSE c[j] + 1 END", "list_transform(range(1, len(h) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: c[k] + j - k)))", "q AS (SELECT * FROM e) SELECT conv_id, turn, round(o / nr, 9) AS wer FROM q"))
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_pairs(spark, sf_dir).select("key.*", F.round(R.word_error_rate("r", "h"), 9).alias("wer"))


@query()
def longest_common_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_pairs(spark, sf_dir).select("key.*", R.lcs("a", "b").alias("lcs"))


@query("SELECT s_suppkey, p_partkey, round(levenshtein(p_name, s_name) / length(p_name), 9) AS cer FROM part JOIN supplier ON s_suppkey = (p_partkey - 1) % (SELECT max(s_suppkey) FROM supplier) + 1")
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = s.agg(F.max("s_suppkey").alias("n"))  # one row
    j = _table(spark, sf_dir, "part").crossJoin(F.broadcast(n)).join(s, F.col("s_suppkey") == (F.col("p_partkey") - 1) % F.col("n") + 1)
    return j.select("s_suppkey", "p_partkey", F.round(R.character_error_rate("p_name", "s_name"), 9).alias("cer"))


_GRAMS = "list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string({0}[i : i + n - 1], chr(31)))"


@query(f"""
WITH p AS {_PAIRS_SQL}, k4 AS (SELECT unnest([1, 2, 3, 4]) AS n),
a AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, unnest({_GRAMS.format('r')}) AS g FROM p, k4) GROUP BY ALL),
b AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, unnest({_GRAMS.format('h')}) AS g FROM p, k4) GROUP BY ALL),
c AS (SELECT b.n, sum(least(b.c, coalesce(a.c, 0))) AS clip, sum(b.c) AS total FROM b LEFT JOIN a USING (conv_id, turn, n, g) GROUP BY b.n),
q AS (SELECT exp(sum(ln(CASE WHEN clip = 0 THEN 1 / (2 * total) ELSE clip / total END)) / 4) AS m, count(*) AS orders FROM c),
l AS (SELECT sum(len(h)) AS h, sum(len(r)) AS r FROM p)
SELECT round(CASE WHEN orders = 4 THEN 100 * m * CASE WHEN h < r THEN exp(1 - r / h) ELSE 1 END ELSE 0 END, 6) AS bleu, CAST(h AS BIGINT) AS hyp_length, CAST(r AS BIGINT) AS ref_length FROM q, l""")
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _turn_pairs(spark, sf_dir).withColumn("refs", F.array("r"))
    return R.bleu(pairs, "refs", "h", "key").select(F.round("bleu", 6).alias("bleu"), "hyp_length", "ref_length")


@query("""
WITH d AS (SELECT doc_id, string_split(translate(text, '|' || chr(10), '  '), ' ') AS w FROM documents),
v AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS e FROM d),
e AS (SELECT doc_id, unnest(list_transform(range(1, len(e) + 1), lambda i: length(array_to_string(e[1 : i - 1], '')))) AS s, unnest(list_transform(range(1, len(e) + 1), lambda i: length(array_to_string(e[1 : i], '')))) AS f FROM v),
g AS (SELECT doc_id, list_transform(range(0, (len(e) + 1) // 2), lambda i: array_to_string(e[2 * i + 1 : 2 * i + 2], '')) AS a FROM v),
a AS (SELECT doc_id, unnest(list_transform(range(1, len(a) + 1), lambda i: length(array_to_string(a[1 : i - 1], '')))) AS s, unnest(list_transform(range(1, len(a) + 1), lambda i: length(array_to_string(a[1 : i], '')))) AS f FROM g),
j AS (SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, count(e.s) FILTER (a.s IS NOT NULL) AS tp, count(a.s) FILTER (e.s IS NULL) AS fp, count(e.s) FILTER (a.s IS NULL) AS fn, count(a.f) FILTER (a.f = e.f) AS correct, count(a.s) AS words, count(e.s) AS expected_words FROM e FULL JOIN a ON e.doc_id = a.doc_id AND e.s = a.s GROUP BY 1)
SELECT doc_id, CAST(tp AS INT) AS tp, CAST(fp AS INT) AS fp, CAST(length(array_to_string(e, '')) - tp - fp - fn AS INT) AS tn, CAST(fn AS INT) AS fn, CAST(correct AS INT) AS correct, CAST(words AS INT) AS words, CAST(expected_words AS INT) AS expected_words FROM j JOIN v USING (doc_id)""")
def segmentation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut into words, and into pairs of words."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.translate("text", "|\n", "  "), " "), lambda w: w != "").alias("e"))
    pairs = F.when(F.size("e") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("e") + 1) / 2).cast("int") - 1), lambda i: F.array_join(F.slice("e", 2 * i + 1, F.lit(2)), ""))).otherwise(F.array().cast("array<string>"))
    d = d.filter(F.size("e") > 0).select("doc_id", F.array_join("e", "|").alias("x"), F.array_join(pairs, "|").alias("y"))
    return R.segmentation_stats(d, "x", "y", "doc_id").drop("indicators")


# Texts


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, ' {2,}', ' ', 'g'), '[ \\n]*\\n[ \\n]*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM pages")
def squeeze_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.remove_dup_spaces("html").alias("text"))


@query("""
SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '#39;', ''''), 'amp;', '&'), '#146;', ''''), 'nbsp;', ' '), '#36;', '$'), '\\n', chr(10)), 'quot;', ''''), '<br />', chr(10)), '\\"', '"'), '<unk>', 'xxunk'), ' @.@ ', '.'), ' @-@ ', '-'), ' @,@ ', ','), '\\', ' \\ '), '&lt;', '<'), '&gt;', '>'), ' {2,}', ' ', 'g')) AS fixed FROM pages""")
def fix_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(T.fix_html("html").cast("binary")).alias("fixed"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([/#\\n])', ' \\1 ', 'g'), ' {2,}', ' ', 'g')) AS spaced FROM documents")
def spec_add_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.rm_useless_spaces(T.spec_add_spaces("text")).cast("binary")).alias("spaced"))


_WREP_SQL = """
WITH w AS (SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM conversations)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY i) AS island FROM w),
r AS (SELECT conv_id, turn, w, min(i) AS i, count(*) AS n FROM g GROUP BY conv_id, turn, w, island)
SELECT conv_id, turn, string_agg(CASE WHEN n > 1 THEN 'xxwrep ' || CAST(n - 1 AS VARCHAR) || ' ' ELSE '' END || w, ' ' ORDER BY i) AS said FROM r GROUP BY ALL"""


@query(_WREP_SQL)
def word_repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.replace_wrep(F.split("text", " ")), " ").alias("said"))
    return c.filter("said <> ''")


@query("SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS thai, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '0123456789') AS back FROM orders")
def digits_thai(spark: SparkSession, sf_dir: str) -> DataFrame:
    thai = T.arabic_to_thai_digits(F.col("o_orderkey").cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", thai.alias("thai"), T.thai_to_arabic_digits(thai).alias("back"))


@query(f"SELECT o_orderkey, {_sql_number('o_orderkey')} AS words, {_sql_number('(o_orderkey * 1000003)')} AS more FROM orders")
def thai_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.num_to_thaiword(k).alias("words"), N.num_to_thaiword(k * 1_000_003).alias("more"))


_SATANG = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(f"SELECT o_orderkey, {_sql_number(f'({_SATANG} // 100)')} || 'บาท' || CASE WHEN {_SATANG} % 100 = 0 THEN 'ถ้วน' ELSE {_sql_number(f'({_SATANG} % 100)', 6)} || 'สตางค์' END AS said FROM orders WHERE o_totalprice > 0")
def baht_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").filter("o_totalprice > 0").select("o_orderkey", N.bahttext("o_totalprice").alias("said"))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in D.MONTHS) + "]"
_DAYS = "[" + ", ".join(f"'{m}'" for m in D.WEEKDAYS) + "]"


@query(f"SELECT o_orderkey, {_DAYS}[isodow(o_orderdate)] || 'ที่ ' || CAST(day(o_orderdate) AS VARCHAR) || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) + 543 AS VARCHAR) AS said, translate(strftime(o_orderdate, '%d/%m/') || CAST(year(o_orderdate) + 543 AS VARCHAR), '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS short FROM orders")
def thai_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.thai_strftime("o_orderdate", "%Aที่ %-d %B %Y").alias("said"), D.thai_strftime("o_orderdate", "%x", thai_digits=True).alias("short"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def thai_date_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = D.thai_strftime("o_orderdate", "%d %B %Y")
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.thai_strptime(said, "%d %B %Y", zone=None).cast("date").cast("string").alias("d"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) + 543 AS VARCHAR) AS be, CAST(year(o_orderdate) + 543 - 2324 AS VARCHAR) AS re, CAST(year(o_orderdate) + 543 - 1122 AS VARCHAR) AS ah, ['ชวด','ฉลู','ขาล','เถาะ','มะโรง','มะเส็ง','มะเมีย','มะแม','วอก','ระกา','จอ','กุน'][(year(o_orderdate) + 8) % 12 + 1] AS animal FROM orders")
def eras_and_zodiac(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return _table(spark, sf_dir, "orders").select("o_orderkey", *(N.convert_years(y, "ad", e).alias(e) for e in ("be", "re", "ah")), N.th_zodiac(y).alias("animal"))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thai texts made of numbers and dates."""
    said = F.concat(N.num_to_thaiword("o_orderkey"), D.thai_strftime("o_orderdate", " %-d %B"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"), "o_orderdate")


@query(f"""
WITH s AS (SELECT o_orderkey, ({_sql_number('o_orderkey')}) || ' ' || CAST(day(o_orderdate) AS VARCHAR) || ' ' || {_MONTHS}[month(o_orderdate)] AS said FROM orders)
SELECT o_orderkey, length(regexp_replace(said, '[^กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ]', '', 'g')) AS consonants, length(regexp_replace(said, '[^่้๊๋]', '', 'g')) AS tonemarks, round(100.0 * length(regexp_replace(said, '[^ก-๛]', '', 'g')) / length(regexp_replace(said, '[ 0-9]', '', 'g')), 9) AS thai FROM s""")
def thai_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.count_thai_chars("said")
    return _spoken(spark, sf_dir).select("o_orderkey", counts["consonants"].alias("consonants"), counts["tonemarks"].alias("tonemarks"), F.round(T.count_thai("said"), 9).alias("thai"))


@query(f"""
WITH s AS (SELECT o_orderkey, {_sql_number('o_orderkey')} AS said FROM orders),
k AS (SELECT o_orderkey, said, regexp_replace(regexp_replace(said, '[็-์]', '', 'g'), '([เ-ไ])([ก-ฮ])', '\\2\\1', 'g') || regexp_extract(said, '[็-์]') AS key FROM s)
SELECT o_orderkey, key FROM k""")
def collation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that put numbers in the order of a Thai dictionary."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.collation_key(N.num_to_thaiword("o_orderkey")).alias("key"))


_NUMBER_WORDS = [*T.DIGIT_WORDS, "เอ็ด", "ยี่", *N.PLACES[1:], "ล้าน"]


@query("SELECT o_orderkey, o_orderkey AS n FROM orders")
def thaiword_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = N.num_to_thaiword("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", L.arrow(L.thaiword_to_num, "bigint")(said).alias("n"))


@query()
def tcc_on_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoken(spark, sf_dir).select("o_orderkey", S.subword_tokenize("said").alias("clusters"), T.display_cells("said").alias("cells"))


@query()
def soundex_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "orders").select("o_orderkey", N.num_to_thaiword("o_orderkey").alias("said"))
    return said.select("o_orderkey", *(L.soundex("said", e).alias(e) for e in ("udom83", "lk82", "metasound", "prayut_and_somchaip")))


# Lookups, classes, vectors

_PLACES_SQL = "(VALUES ('in', 'B-LOCATION'), ('of', 'B-LOCATION')) AS p(word, tag)"


@query(f"""
WITH t AS (SELECT doc_id, unnest({_WORDS_SQL}) AS token, generate_subscripts({_WORDS_SQL}, 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos AS INT) AS pos, token, coalesce(tag, 'O') AS tag FROM t LEFT JOIN {_PLACES_SQL} ON token = word""")
def tag_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.createDataFrame([("in",), ("of",)], "word string")
    return R.tag_locations(_with_words(spark, sf_dir), "tokens", places, "doc_id")


@query(f"""
WITH t AS (SELECT doc_id, {_WORDS_SQL} AS t FROM documents)
SELECT doc_id, list_has_any(t, ['worthless', 'hate']) AS found, md5(array_to_string(list_transform(t, lambda x: CASE WHEN x IN ('worthless', 'hate') THEN repeat('*', length(x)) ELSE x END), '')) AS censored FROM t""")
def censor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = ["worthless", "hate"]
    d = _with_words(spark, sf_dir)
    return d.select("doc_id", R.contains_listed("tokens", listed).alias("found"), F.md5(R.censor_listed("tokens", listed).cast("binary")).alias("censored"))


@query(f"""
WITH t AS (SELECT {_WORDS_SQL} AS t FROM documents),
b AS (SELECT w1, w2, count(*) AS n FROM (SELECT unnest(t[1 : len(t) - 1]) AS w1, unnest(t[2 :]) AS w2 FROM t) GROUP BY ALL),
u AS (SELECT w1, count(*) AS m FROM (SELECT unnest(t) AS w1 FROM t) GROUP BY ALL)
SELECT w1, w2, n, round(n / m, 9) AS prob FROM b JOIN u USING (w1)""")
def bigram_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.bigram_probabilities(_with_words(spark, sf_dir), "tokens"), "prob")


@query("""
SELECT a.vec_id, b.vec_id AS near, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select(F.col("vec_id").alias("near"), F.col("embedding").alias("other"))
    return e.join(b, F.col("near") == F.col("vec_id") + 1).select("vec_id", "near", F.round(R.cosine("embedding", "other"), 6).alias("cosine"))


@query()
def gzip_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of benchmark items by compression, from four given texts."""
    known = [("the and of to in that was for with his they this have from one had by word", "en"), ("der die und das nicht von mit auf für ist im dem zu ein eine den", "de"), ("le la les des et dans pour que qui une sur avec est pas au du", "fr"), ("el la los de que y en un por con para una su al lo como más", "es")]
    return R.gzip_knn(_table(spark, sf_dir, "benchmark"), "text", "item_id", known)


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT a.word, b.word AS candidate, CAST(levenshtein(a.word, b.word) AS INT) AS distance FROM w a, w b WHERE levenshtein(a.word, b.word) <= 2""")
def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return L.similar_words(words, words.withColumn("n", F.lit(1))).select("word", "candidate", "distance")


# Spans, neighbours, more scripts


@query("""
WITH w AS (SELECT conv_id, turn, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations))
SELECT conv_id, turn, CAST(pos AS INT) AS pos, token, lag(token) OVER x AS token_m1, lead(token) OVER x AS token_p1 FROM w WINDOW x AS (PARTITION BY conv_id, turn ORDER BY pos)""")
def neighbour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.operators import entities as E

    t = _table(spark, sf_dir, "conversations").withColumn("tokens", F.split("text", " "))
    rows = R.tokens_of(t, "tokens", "conv_id", "turn").withColumn("key", F.struct("conv_id", "turn"))
    return E.neighbour_features(rows, "key", ["token"]).select("conv_id", "turn", "pos", "token", "token_m1", "token_p1")


_TAGGED_SQL = "(SELECT conv_id AS k, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS pos, role AS token, CASE WHEN turn % 3 = 0 THEN 'B-X' WHEN turn % 3 = 1 THEN 'I-X' ELSE 'O' END AS tag FROM conversations)"


@query(f"""
WITH t AS {_TAGGED_SQL},
b AS (SELECT *, tag = 'O' OR tag = 'B-X' OR coalesce(lag(tag) OVER (PARTITION BY k ORDER BY pos), 'O') = 'O' AS begins FROM t),
i AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS island FROM b)
SELECT k, min(pos) AS first, max(pos) AS last, CASE WHEN min(tag) = 'O' THEN '' ELSE 'X' END AS kind, string_agg(token, '' ORDER BY pos) AS text FROM i GROUP BY k, island""")
def iob_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of tags: turns of conversations as tokens."""
    from pyspark.sql import Window

    from saithong.operators import entities as E

    c = _table(spark, sf_dir, "conversations")
    tag = F.when(F.col("turn") % 3 == 0, "B-X").when(F.col("turn") % 3 == 1, "I-X").otherwise("O")
    t = c.select(F.col("conv_id").alias("k"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("pos"), F.col("role").alias("token"), tag.alias("tag"))
    return E.iob_entities(t, "k")


@query("""
WITH e AS (SELECT l_orderkey AS k, l_partkey % 50 AS s, l_partkey % 50 + l_quantity AS f FROM lineitem)
SELECT k, CAST(s AS BIGINT) AS start, f AS end FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.k = e.k AND e.s >= o.s AND e.f <= o.f AND (e.s > o.s OR e.f < o.f))""")
def top_level_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.operators import entities as E

    s = F.col("l_partkey") % 50
    return E.top_level_entities(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), s.alias("start"), (s + F.col("l_quantity")).alias("end")), "k")


@query()
def prosody_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vowel, final, rhyme key, weight and mark of the words of numbers; each different word once."""
    from saithong.operators import prosody as P

    words = S.broadcast_words(spark, _NUMBER_WORDS)
    each = _table(spark, sf_dir, "orders").select(F.explode(S.word_tokenize(N.num_to_thaiword("o_orderkey"), words)).alias("word")).distinct()
    return each.select("word", P.prosody("word").alias("p")).select("word", "p.*")


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(upper(n_name), ''), lambda c: coalesce(map([' '] || string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ012345678', ''), [' '] || string_split('.- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---..', ' '))[c], ' ')), ' ') AS morse FROM nation")
def morse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", T.morse_encode("n_name", "en").alias("morse"))


# More native functions, held against SQL

_C = T.C.CONSONANTS


def _sql_chain(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_UDOM_SQL = _sql_chain("said", [
    ("รร([เ-ไ])", "ัน\\1"), (f"รร([{_C}][{_C}เ-ไ])", "ั\\1"), (f"รร([{_C}][ะ-ู่-์])", "ัน\\1"), ("รร", "ัน"), (f"ไ([{_C}]ย)", "\\1"), (f"[ไใ]([{_C}])", "\\1ย"), ("ำ(ม[ะ-ู])", "ม\\1"), ("ำม", "ม"), ("ำ", "ม"), (f"จน์|มณ์|ณฑ์|ทร์|ตร์|[{_C}]์|[{_C}][ะ-ู]์", ""), ("[ะ-์]", ""),
])


@query(f"""
WITH s AS (SELECT o_orderkey, {_sql_number('o_orderkey')} AS said FROM orders), x AS (SELECT o_orderkey, {_UDOM_SQL} AS x FROM s)
SELECT o_orderkey, rpad(translate(substr(x, 1, 1), 'กขฃคฅฆงจฉชฌซศษสฎดฏตฐฑฒถทธณนบปผพภฝฟมญยรลฬฤฦวอหฮ', 'กขขขขขงจชชชสสสสดดตตททททททนนบปพพพฟฟมยยรรรรรวอฮฮ') || translate(substr(x, 2), 'มวำกขฃคฅฆงยญณนฎฏดตศษสบปพภผฝฟหอฮจฉชซฌฐฑฒถทธรฤลฦ', '0001111112233344444445555666666777778888889999'), 7, '0') AS code FROM x""")
def udom83_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", L.udom83(N.num_to_thaiword("o_orderkey")).alias("code"))


@query(f"SELECT p_partkey, translate(p_name, '{T.ENGLISH_KEYS.replace(chr(39), chr(39) * 2)}', '{T.THAI_KEYS}') AS typed FROM part")
def wrong_keyboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", T.english_keys_to_thai("p_name").alias("typed"))


@query("SELECT p_partkey, round(p_retailprice * 4, 6) AS salueng, round(p_retailprice / 80, 6) AS chang, CASE p_size % 4 WHEN 0 THEN p_size + 2015 WHEN 1 THEN p_size + 1945 WHEN 2 THEN p_size + 1928 ELSE p_size + 1924 END AS year FROM part")
def old_money_and_reigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = N.convert_currency("p_retailprice", "บาท")
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(money["สลึง"], 6).alias("salueng"), F.round(money["ชั่ง"], 6).alias("chang"), N.reign_year_to_ad("p_size", 10 - F.col("p_size") % 4).alias("year"))


@query(f"""
WITH s AS (SELECT o_orderkey, {_sql_number('o_orderkey')} AS said FROM orders)
SELECT o_orderkey, c AS name, count(*) AS n FROM (SELECT o_orderkey, unnest(string_split(said, '')) AS c FROM s) WHERE c SIMILAR TO '[ก-ฮ]' GROUP BY ALL""")
def consonants_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by name, of which consonants are their own."""
    said = _table(spark, sf_dir, "orders").select("o_orderkey", N.num_to_thaiword("o_orderkey").alias("said"))
    return R.char_analysis(said, "said", "o_orderkey").filter(F.col("name").rlike("^[ก-ฮ]$"))


@query()
def spelling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number words with a letter dropped, corrected."""
    checker = L.SpellChecker(dict.fromkeys(_NUMBER_WORDS, 5))
    words = S.broadcast_words(spark, _NUMBER_WORDS)
    each = _table(spark, sf_dir, "orders").select(F.explode(S.word_tokenize(N.num_to_thaiword("o_orderkey"), words)).alias("word")).distinct()
    dropped = F.left("word", F.length("word") - 1)
    return each.select("word", dropped.alias("typed"), L.arrow(checker.spell, "array<string>")(dropped).alias("suggestions"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_freq_top10(spark, sf_dir)


def queries() -> dict[str, Query]:
    from saithong.plans import more, published  # noqa: F401  they add their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
