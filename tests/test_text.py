"""Published values and properties of the text, number, date and segmentation operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from saithong.functions import dates as D
from saithong.functions import numbers as N
from saithong.functions import text as T
from saithong.operators import corpus as R
from saithong.operators import lexical as L
from saithong.operators import scripts as X
from saithong.operators import segment as S


@pytest.fixture(scope="module")
def value(spark):
    return lambda *c: (lambda r: r[0] if len(c) == 1 else tuple(r))(spark.range(1).select(*c).first())


def check(value, f, cases):
    got = value(*(f(*[F.lit(a) for a in (x if isinstance(x, tuple) else (x,))]).alias(f"c{i}") for i, (x, _) in enumerate(cases)))
    assert list(got if len(cases) > 1 else [got]) == [y for _, y in cases]


def test_numbers(value):
    check(value, N.num_to_thaiword, [(0, "ศูนย์"), (112, "หนึ่งร้อยสิบสอง"), (-273, "ลบสองร้อยเจ็ดสิบสาม"), (101, "หนึ่งร้อยเอ็ด"), (1000001, "หนึ่งล้านเอ็ด"), (111111, "หนึ่งแสนหนึ่งหมื่นหนึ่งพันหนึ่งร้อยสิบเอ็ด"), (10**12, "หนึ่งล้านล้าน")])
    check(value, N.bahttext, [(116.0, "หนึ่งร้อยสิบหกบาทถ้วน"), (0.0, "ศูนย์บาทถ้วน"), (-50.5, "ลบห้าสิบบาทห้าสิบสตางค์"), (0.01, "ศูนย์บาทหนึ่งสตางค์")])
    check(value, N.num_to_thaiword_float, [(123.45, "หนึ่งร้อยยี่สิบสามจุดสี่ห้า"), (0.5, "ศูนย์จุดห้า"), (1e9, "หนึ่งพันล้าน")])
    assert value(N.num_to_thaiword(F.lit(None).cast("int"))) == ""
    check(value, lambda y: N.convert_years(y, "be", "re"), [("2566", "242"), (2566, "242")])
    with pytest.raises(NotImplementedError):
        N.convert_years("x", "be", "be")
    assert value(N.th_zodiac(F.lit(2024)), N.th_zodiac(F.lit(2024), 2), N.th_zodiac(F.lit(2024), 3)) == ("มะโรง", "DRAGON", 5)
    assert value(N.reign_year_to_ad(F.lit(1), F.lit(9)), N.convert_currency(F.lit(2), "บาท")["สลึง"]) == (1946, 8.0)


def test_numerals_come_back(spark):
    n = spark.range(0, 3_000_000, 7919).select("id", L.arrow(L.thaiword_to_num, "bigint")(N.num_to_thaiword("id")).alias("back"))
    assert n.filter("id <> back").count() == 0
    assert L.thaiword_to_num("ลบสองร้อยเจ็ดสิบสาม") == -273 and L.words_to_num(["ห้า", "สิบ", "จุด", "เก้า", "ห้า"]) == pytest.approx(50.95)
    assert L.text_to_num("เก้าร้อยแปดสิบจุดเก้าห้าบาทนี่คือจำนวนทั้งหมด", ["บาท", "นี่", "คือ", "จำนวน", "ทั้งหมด"]) == ["980.95", "บาท", "นี่", "คือ", "จำนวน", "ทั้งหมด"]
    for bad in ("", "นอก", "สิบก"):
        with pytest.raises(ValueError):
            L.thaiword_to_num(bad)


def test_dates(value):
    d = F.expr("timestamp_ntz'1976-10-06 01:40:00'")
    cases = {"%d": "06", "%-d": "6", "%_d": " 6", "%Od": "๐๖", "%c": "พ   6 ต.ค. 01:40:00 2519", "%A %B %Y": "วันพุธ ตุลาคม 2519", "%Q%%": "Q%", "%-": "-", "%": "%"}
    assert value(*(D.thai_strftime(d, f).alias(f"f{i}") for i, f in enumerate(cases))) == tuple(cases.values())
    assert value(D.thai_strptime(F.lit("15 ก.ค. 2565 09:00:01"), "%d %B %Y %H:%M:%S", zone=None)) == dt.datetime(2022, 7, 15, 9, 0, 1)
    assert value(D.thai_strptime(F.lit("5/7/65"), "%d/%B/%Y", zone=None)) == dt.datetime(2022, 7, 5)
    assert value(D.thaiword_to_date(F.lit("เมื่อวาน"), F.expr("timestamp_ntz'2020-01-02'"))) == dt.datetime(2020, 1, 1)
    check(value, D.time_to_thaiword, [("18:30", "สิบแปดนาฬิกาสามสิบนาที")])
    check(value, lambda t: D.time_to_thaiword(t, "6h", "m"), [("12:30:01", "เที่ยงครึ่ง")])
    assert [L.thaiword_to_time(t) for t in ("บ่ายโมงครึ่ง", "เที่ยงคืนหนึ่งนาที", "ตีสามสิบห้า", "หกโมงเช้า")] == ["13:30", "00:01", "03:15", "06:00"]
    with pytest.raises(ValueError):
        L.thaiword_to_time("ไม่มีเวลา")


def test_normalization(value):
    check(value, T.normalize, [("เเปลก", "แปลก"), ("นํา", "นำ"), ("นๅคา", "นาคา"), ("ฤๅษี", "ฤๅษี"), ("กา า  า  า", "กา"), ("พ ุ่มดอกไม้", "พุ่มดอกไม้"), ("", "")])
    check(value, T.count_thai, [("", 0.0), ("ประเทศไทย", 100.0), ("โรค COVID-19", 37.5)])
    check(value, T.is_thai, [("ไทย.", True), ("ไทยa", False), ("", True)])
    check(value, T.morse_encode, [("แมว", ".-.- -- .--")])
    assert value(T.morse_decode(F.lit("-.-. .- -"), "en")) == "CAT"
    check(value, T.display_cells, [("แม่น้ำอยู่ที่ไหน", ["แ", "ม่", "น้ํ", "า", "อ", "ยู่", "ที่", "ไ", "ห", "น"])])
    check(value, T.rm_brackets, [("hey() whats[;] up{*&} man(hey)", "hey whats up man(hey)")])
    check(value, T.replace_rep_nonum, [("กาาาาาาา", "กา xxrep ")])
    check(value, T.remove_trailing_repeat_consonants, [("เริ่ดดดดด", "เริ่ด")])
    counts = value(T.count_thai_chars(F.lit("ทดสอบภาษาไทย")))
    assert (counts.vowels, counts.lead_vowels, counts.follow_vowels, counts.consonants) == (3, 1, 2, 9)
    with pytest.raises(NotImplementedError):
        T.morse_encode("x", "de")


def test_addresses_take_linear_time(spark):
    import time

    long = ["http://" + "!" * 100_000, "http://" + "a!" * 50_000, "http://" + "(" * 100_000, "a." * 50_000]
    start = time.perf_counter()
    got = spark.createDataFrame([(t,) for t in long], "t string").select(T.replace_url("t").alias("t")).collect()
    assert [r.t for r in got] == [long[0], "xxurl!", long[2], long[3]] and time.perf_counter() - start < 30
    cases = {"see http://a.b/c(d)e. x": "see xxurl. x", "(www.a.com/x)": "(xxurl)", "a.com/- ": "a.com/- ", "no address.": "no address.", "HTTPS://x.y!": "xxurl!"}
    assert [r.t for r in spark.createDataFrame([(t,) for t in cases], "t string").select(T.replace_url("t").alias("t")).collect()] == list(cases.values())


def test_collation(spark):
    words = ["ไก่", "เป็ด", "หมู", "วัว", "ก้วย", "ก๋วย", "ก่วย", "กวย", "ก้วย", "ก่วย", "ก๊วย"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.w for r in df.orderBy(T.collation_key("w"), "w").collect()] == ["กวย", "ก่วย", "ก่วย", "ก้วย", "ก้วย", "ก๊วย", "ก๋วย", "ไก่", "เป็ด", "วัว", "หมู"]


def test_keyboard_round_trip(value):
    assert value(T.english_keys_to_thai(F.lit("Tok8kicsj'xitgmLwmp"))) == "ธนาคารแห่งประเทศไทย"
    assert value(T.thai_keys_to_english(F.lit("ธนาคารแห่งประเทศไทย"))) == "Tok8kicsj'xitgmLwmp"
    assert value(T.key_distance(F.lit("ฟ"), F.lit("ฤ"), 0.5), T.key_distance(F.lit("ก"), F.lit("ด"))) == (0.5, 1.0)


def test_clusters():
    assert S.tcc("ประเทศไทย") == ["ป", "ระ", "เท", "ศ", "ไท", "ย"]
    assert S.tcc("พิสูจน์ได้ค่ะ") == ["พิ", "สูจน์", "ได้", "ค่ะ"]
    assert S.tcc(None) == [] and S.tcc_p("") == []


THAI = ["ฉัน", "รัก", "ภาษา", "ไทย", "ภาษาไทย", "เพราะ", "เป็น", "คน", "คนไทย", "ด้าน", "หน้า", "ด้านหน้า"]


def test_segmenters():
    d = S.Dictionary(THAI)
    assert S.newmm("ฉันรักภาษาไทยเพราะฉันเป็นคนไทย", d) == ["ฉัน", "รัก", "ภาษาไทย", "เพราะ", "ฉัน", "เป็น", "คนไทย"]
    assert S.newmm("ด้านหน้า" * 1000, d) == ["ด้านหน้า"] * 1000
    assert S.mm("คนไทย", d) == ["คนไทย"] and S.all_segmentations("คนไทย", d) == ["คน|ไทย|", "คนไทย|"]
    for t, e in [("19.84", ["19.84"]), ("19...", ["19", "..."]), ("127.0.0.1", ["127.0.0.1"]), ("USD1,984.42", ["USD", "1,984.42"])]:
        assert S.tokenize(t, d) == e
    assert S.longest("ทดสอบทดสอบ", S.Dictionary(["ทดสอบท"])) == ["ทดสอบท", "ดสอบ"]
    assert S.rejoin_numbers(["ขณะนี้", "12", ":", "00น"]) == ["ขณะนี้", "12:00น"]
    assert S.expand_maiyamok(["คน", "ๆ", "นก"]) == ["คน", "คน", "นก"]
    for f in (S.newmm, S.newmm_safe, S.longest, S.mm):
        assert f(None, d) == [] and f("", d) == []


def test_segmenters_lose_nothing():
    rng, d = random.Random(3), S.Dictionary(THAI)
    alphabet = "กขคนไทยะาิีุูเแ่้์ๆฯ๑ab1 .,\n\r"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) if rng.random() < 0.7 else rng.choice(THAI) for _ in range(rng.randint(0, 60)))
        for f in (S.newmm, S.newmm_safe, S.mm, S.multi_cut):
            assert "".join(f(t, d)) == t
        assert "".join(S.longest(t, d)) == t.lower()
        assert "".join(S.tcc(t)) == t == "".join(S.tcc_p(t))
        assert "".join(S.rejoin_numbers(S.newmm(t, d))) == t


def test_dictionary_removes():
    d = S.Dictionary(["กา", "กาแฟ"])
    d.remove("กา")
    assert d.prefixes("กาแฟ") == ["กาแฟ"] and len(d) == 1 and "กา" not in d
    d.remove("กาแฟ")
    assert d.root == {}


def test_columns_agree_with_functions(spark):
    d = S.broadcast_words(spark, THAI)
    texts = ["ฉันรักภาษาไทย 12:30 น.", "", None, "hello world  19.84\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", S.word_tokenize("t", d).alias("a"), S.word_tokenize("t", d, keep_whitespace=False).alias("b"), S.foreign_tokenize("t").alias("c"), S.subword_tokenize("t").alias("s")).collect()
    for r in rows:
        assert r.a == S.tokenize(r.t, S.Dictionary(THAI)) and " " not in r.b and r.s == S.tcc(r.t)
    assert rows[3].c == ["hello", " ", "world", "  ", "19.84", "\n"] == rows[3].a
    from saithong.models import ModelUnavailable

    with pytest.raises(ModelUnavailable):
        S.word_tokenize("t", d, engine="cnn")
    with pytest.raises(ValueError):
        S.word_tokenize("t", d, engine="none")
    from saithong import models

    models.register("word_tokenize", "blanks", lambda c: F.split(c, " "))
    assert df.select(S.word_tokenize("t", d, engine="blanks").alias("x")).collect()[3].x[:2] == ["hello", "world"]


def test_spans_and_detokenize(value):
    t = F.array(F.lit("สวัสดี"), F.lit("ครับ"))
    assert [tuple(s) for s in value(S.inclusive_spans(t))] == [(0, 5), (6, 9)]
    assert value(S.detokenize(F.split(F.lit("เรา|เล่น|game|10|ๆ|ครับ"), r"\|"))) == "เราเล่น game 10 ๆ ครับ"
    assert value(S.sentences(F.lit(" a  b "), "whitespace")) == ["", "a", "b", ""] and value(S.sentences(F.lit(" a \n b "))) == ["a", "b"]


def test_phonetic_codes(value):
    check(value, L.udom83, [("รถ", "ร800000"), ("", "")])
    check(value, L.metasound, [("บูรณะ", "บ550"), ("คน", "ค500"), ("ดา", "ด000"), ("", "")])
    check(value, L.lk82, [("รถ", "ร3000"), (None, ""), ("เรือ", "รBA00")])
    check(value, L.prayut_and_somchaip, [("vp", "11"), ("วีพี", "11"), (None, "")])
    assert value(L.code_similarity(F.lit("ร800"), F.lit("ร810")), L.code_similarity(F.lit(""), F.lit("")), L.code_similarity(F.lit("a"), F.lit(""))) == (0.75, 1.0, 0.0)
    assert [L.complete_soundex(w) for w in ("ก้าน", "นา", "ญา", "", None)] == ["กก1Bน2-", "นน1B0--", "ยย1B0--*", "", ""]
    assert [L.complete_soundex(w) for w in ("เรือ", "ใคร", "กรรม", "บาตร", "ทราย")] == ["รรBV-0-", "คค1Aย0ร", "กก1Aม0-", "บบ1Bด0-", "ซซ1Bย0-"]


def test_spelling(spark):
    c = L.SpellChecker({"แมว": 5, "แม่": 9, "หมา": 3, "ก": 9})
    assert c.spell("แมว") == ["แมว"] and c.correct("แมม") == "แม่" and c.correct("1.01") == "1.01" and c.spell("") == [""] and c.correct("") == ""
    lex = spark.createDataFrame([("แมว", 5), ("แม่", 9), ("หมา", 3)], "word string, n int")
    got = L.similar_words(spark.createDataFrame([("แมม",)], "word string"), lex, 1)
    assert sorted(r.candidate for r in got.collect()) == sorted(["แมว", "แม่"])
    assert L.misspell("ภาษาไทย" * 5, 1, 0.2) == L.misspell("ภาษาไทย" * 5, 1, 0.2) != "ภาษาไทย" * 5


def test_syllables(value):
    assert [L.tone(s) for s in ("มา", "ไม้", "ข้า", "ก๋ง", "หมา", "รัก")] == ["m", "h", "f", "r", "r", "h"]
    assert [L.sound_syllable(s) for s in ("มา", "มาก", "นก", "งาน")] == ["live", "dead", "dead", "live"]
    check(value, L.syllable_open, [("มา", "open"), ("มาก", "close")])
    check(value, L.syllable_length, [("มาก", "long"), ("รัก", "short")])


def test_scripts(value):
    check(value, X.iso_11940, [("ภาษา", "p̣hās̛̄ā")])
    check(value, X.tone_to_spelling, [("่", "ไม้เอก"), ("ก", "ก")])
    check(value, X.nectec_to_ipa, [("kl-uua-j^-2", "kl uua j ˥˩")])
    check(value, X.remove_tone_ipa, [("laː˦˥.sa˨˩", "laː.sa")])
    check(value, X.ipa_to_rtgs, [("kluaj", "kluai")])
    check(value, X.braille, [("แมว", "⠣⠍⠺"), ("", "")])
    check(value, X.aksonhan_to_current, [("จกก", "จัก"), ("กก", "กก")])
    assert X.cell("12345678") == "⣿" and X.mirrored(["12", "3"]) == "⠠⠘"


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["a", "b", "c", "d"]), (2, ["a", "a", "b"], ["a", "b", "b", "x"]), (3, [], [])], "k int, r array<string>, h array<string>")
    one = {r.k: r for r in R.rouge_n(df, "r", "h", "k").collect()}
    assert (one[1].fmeasure, one[2].precision, one[3].fmeasure) == (1.0, 0.5, 0.0)
    assert {r.k: r.recall for r in R.rouge_l(df, "r", "h", "k").collect()}[2] == pytest.approx(2 / 3)
    same = R.bleu(df.filter("k = 1").withColumn("refs", F.array("r")), "refs", "h", "k").first()
    assert same.bleu == pytest.approx(100) and same.hyp_length == 4
    assert {r.k: r.w for r in df.select("k", R.word_error_rate("r", "h").alias("w")).collect()} == {1: 0.0, 2: pytest.approx(2 / 3), 3: 0.0}


def test_segmentation_stats(spark):
    df = spark.createDataFrame([(1, "ผม|ไม่|ชอบ|กิน|ผัก", "ผม|ไม่|ชอบ|กินผัก|")], "i int, e string, a string")
    s = R.segmentation_stats(df.select("i", R.clean_segmentation("e").alias("e"), R.clean_segmentation("a").alias("a")), "e", "a", "i").first()
    assert (s.tp, s.fp, s.fn, s.tn, s.correct, s.words, s.expected_words, s.indicators) == (4, 0, 1, 9, 3, 4, 5, "1110")


def test_lookups(spark):
    t = spark.createDataFrame([(1, ["ฉัน", "อยู่", "เชียงใหม่"])], "d int, tokens array<string>")
    tags = [r.tag for r in R.tag_locations(t, "tokens", spark.createDataFrame([("เชียงใหม่",)], "word string"), "d").orderBy("pos").collect()]
    assert tags == ["O", "O", "B-LOCATION"]
    gold = spark.createDataFrame([(1, ["ab", "c"]), (2, ["a", "bc"])], "d int, tokens array<string>")
    found = spark.createDataFrame([(1, ["a", "bc"]), (2, ["a", "bc"])], "d int, tokens array<string>")
    assert R.bad_words(gold, found, "d").count() == 0
    assert [r.word for r in R.bad_words(gold.filter("d = 1"), found.filter("d = 1"), "d").orderBy("word").collect()] == ["a", "bc"]


def test_perceptron_learns(spark):
    sentences = [[("the", "D"), (f"dog{i % 3}", "N"), ("runs", "V")] for i in range(30)] + [[("a", "D"), ("cat", "N"), ("sleeps", "V")]] * 10
    tagger = L.PerceptronTagger()
    tagger.train(sentences)
    assert [t for _, t in tagger.tag(["the", "cat", "runs"])] == ["D", "N", "V"] and tagger.tag([]) == []
    df = spark.createDataFrame([(["a", "dog1"],)], "t array<string>")
    assert [x.tag for x in df.select(L.perceptron_tags("t", tagger, df).alias("x")).first().x] == ["D", "N"]


def test_generation_is_seeded():
    steps = {"a": [("b", 0.5), ("c", 0.5)], "b": [("a", 1.0)], "c": [("d", 0.0001)]}
    assert L.generate_words("a", steps, 4, 7) == L.generate_words("a", steps, 4, 7)
    assert L.generate_words("c", steps, 4, 7) == ["c"]


def test_sources(spark, tmp_path):
    from saithong.sources import lexicons as X2

    (tmp_path / "w.txt").write_text("﻿ก\n# note\nข # more\n\nก\n", encoding="utf-8")
    (tmp_path / "f.tsv").write_text("ก\tข\t3\nbad\n", encoding="utf-8")
    assert sorted(r.word for r in X2.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["ก", "ข"]
    assert [tuple(r) for r in X2.frequencies(spark, str(tmp_path / "f.tsv"), 2).collect()] == [("ก", "ข", 3)]


def test_sql_functions(spark):
    from saithong.sql import register_all

    register_all(spark, THAI)
    assert spark.sql("select thai_tokens('คนไทย') a, thai_numeral('ยี่สิบเอ็ด') b").first() == (["คนไทย"], 21)
    assert spark.sql("select * from thai_segmentations('คนไทย')").count() == 2


def test_stream_counts_in_windows(spark, tmp_path):
    from saithong.streaming.tokens import windowed_counts

    rows = [(dt.datetime(2024, 1, 1, h, m), t) for h, m, t in [(0, 5, "a b"), (0, 50, "a"), (2, 0, "c"), (0, 10, "late")]]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "ts timestamp_ntz, text string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
    stream = spark.readStream.schema("ts timestamp_ntz, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withColumn("tokens", S.foreign_tokenize("text", keep_whitespace=False))
    q = windowed_counts(stream, "tokens", "ts").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.token, r.n) for r in spark.table("counts").collect()} >= {("a", 2), ("b", 1)}


def test_every_query_runs_and_matches_its_sql(spark):
    import duckdb

    from saithong.plans import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    show = lambda rows, cols: sorted(tuple("-" if r[c] is None else f"{r[c]:.6f}" if isinstance(r[c], float) else str(r[c]) for c in sorted(cols)) for r in rows)
    for name, f in registry.queries().items():
        df = f(spark, sf)
        rows = [r.asDict() for r in df.collect()]
        assert rows, name
        if sql := registry.oracle_sql().get(name):
            cur = con.execute(sql)
            cols = [d[0] for d in cur.description]
            assert sorted(cols) == sorted(df.columns), name
            assert show(rows, cols) == show([dict(zip(cols, r, strict=True)) for r in cur.fetchall()], cols), name


def test_entities(spark):
    from saithong.operators import entities as E

    t = spark.createDataFrame([(1, i, w, g) for i, (w, g) in enumerate([("คุณ", "O"), ("สม", "B-PERSON"), ("ชาย", "I-PERSON"), ("ไป", "O"), ("ไทย", "I-LOC"), ("แดน", "B-LOC")])], "k int, pos int, token string, tag string")
    assert [r.token for r in E.merge_entities(t, "k").orderBy("pos").collect()] == ["คุณ", "สมชาย", "ไป", "ไทย", "แดน"]
    assert [r.token for r in E.merge_entities(t, "k", ["LOC"]).orderBy("pos").collect()] == ["คุณ", "สม", "ชาย", "ไป", "ไทย", "แดน"]
    assert E.inline_tags(t, "k").first().text == "คุณ<PERSON>สมชาย</PERSON>ไป<LOC>ไทย</LOC><LOC>แดน</LOC>"
    f = E.neighbour_features(t, "k", ["token"]).orderBy("pos").collect()
    assert (f[0].token_m1, f[0].token_p1, f[5].token_m1, f[5].token_p1) == (None, "สม", "ไทย", None)
    spans = spark.createDataFrame([(1, 0, 5), (1, 1, 3), (1, 4, 8), (1, 0, 5)], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in E.top_level_entities(spans, "k").collect()) == [(0, 5), (0, 5), (4, 8)]
    s = spark.createDataFrame([(1, 0, "abc"), (1, 1, "defg")], "k int, pos int, text string")
    assert [(r.pos, r.word) for r in E.spans_to_sentences(s, spark.createDataFrame([(1, 1, 2), (1, 3, 4)], "k int, start int, end int"), "k").orderBy("start").collect()] == [(0, "bc"), (1, "de")]


def test_products_and_vectors(spark, value):
    from saithong.operators import entities as E

    assert value(E.combinations(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("d"))))) == [["a", "c"], ["a", "d"], ["b", "c"], ["b", "d"]]
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.9, 0.1]), ("z", [0.0, 1.0])], "word string, vector array<double>")
    assert E.odd_one_out(spark.createDataFrame([(1, w) for w in "xyz"], "k int, word string"), v, "k").first().word == "z"
    assert [r.word for r in E.most_similar(["x"], [], v, 1).collect()] == ["y"]
    with pytest.raises(KeyError):
        E.most_similar(["none"], [], v)


def test_prosody(spark):
    from saithong.operators import prosody as P

    assert [P.vowel(w) for w in ("เริง", "กา", "เกีย", "คน", "รัก", "ไม", "เรือ", "ฤา", "กรรม")] == ["เออ", "อา", "เอีย", "โอะ", "อะ", "ไอ", "เอือ", "อือ", "อำ"]
    assert [P.final(w) for w in ("สาว", "ปลิง", "กา", "นก", "บาตร", "จันทร์", "ไทย", "")] == ["เกอว", "กง", "กา", "กก", "กด", "กน", "กา", ""]
    assert P.rhyme_key("สรร") == P.rhyme_key("อัน") and P.rhyme_key("แมว") != P.rhyme_key("กา")
    assert [P.weight(w) for w in ("กา", "ณ", "กะ", "คน", "")] == ["karu", "lahu", "lahu", "karu", None]
    assert [P.mark(w) for w in ("ไม่", "ห้อง", "หมา")] == ["aek", "too", None]
    lex = spark.createDataFrame([(w,) for w in ("นา", "ตา", "ตี", "กา")], "word string")
    assert sorted(r.rhyme for r in P.rhymes(spark.createDataFrame([("กา",)], "word string"), lex).collect()) == ["ตา", "นา"]
    poem = spark.createDataFrame([(1, 1, [["กา"], ["ตา", "มี"], ["สี"], ["ดี"]]), (1, 2, [["กา"], ["ตา", "นก"], ["รก"], ["ดี"]])], "k int, stanza int, lines array<array<string>>")
    assert [(r.stanza, "before" in r.problem) for r in P.check_poem(poem, "k", 4).orderBy("stanza").collect()] == [(2, True), (2, False)] or P.check_poem(poem, "k", 4).filter("stanza = 1").count() == 0


def test_ml_stages(spark):
    from pyspark.ml import Pipeline

    from saithong.transformers import SPARSE_BEHIND, ColumnSteps, TextTokenizer

    df = spark.createDataFrame([("คนไทย  คนไทย",)], "text string")
    out = Pipeline(stages=[ColumnSteps([T.rm_useless_spaces], "text", "clean"), TextTokenizer(THAI, "clean"), ColumnSteps(SPARSE_BEHIND, "tokens", "out")]).fit(df).transform(df).first()
    assert out.tokens == ["คนไทย", " ", "คนไทย"] and out.out == ["คนไทย", "คนไทย"]


def test_romanization_and_spelling(spark):
    assert [X.royin_word(w) for w in ("แมว", "ภาพ", "กก", "นก", "คน", "สวัสดี", "ห")] == ["maeo", "phap", "kok", "nok", "khon", "swatdi", ""]
    df = spark.createDataFrame([(["แมว", "กิน"], "เสือ")], "t array<string>, w string")
    r = df.select(X.romanize("t").alias("r"), X.spell_out("w").alias("s"), X.royin_vowels(F.lit("แมว")).alias("v")).first()
    assert r.r == "maeokin" and r.s == ["สอ", "เอือ", "เสือ"] and r.v == "มaeo"
    assert X.spelling("เสื้อ") == ["สอ", "เอือ", "เสือ", "ไม้โท", "เสื้อ"] and X.spelling("") == []


def test_command_line(tmp_path, capsys, spark):
    from saithong.__main__ import main

    (tmp_path / "d.txt").write_text("คน\nไทย\n", encoding="utf-8")
    assert main(["tokenize", "word", "คนไทย", "--dictionary", str(tmp_path / "d.txt")]) == 0 and capsys.readouterr().out.strip() == "คน|ไทย"
    assert main(["soundex", "รถ"]) == 0 and capsys.readouterr().out.strip() == "ร3000"
    (tmp_path / "a").write_text("ผม|ไม่|ชอบ\n", encoding="utf-8")
    (tmp_path / "b").write_text("ผม|ไม่ชอบ\n", encoding="utf-8")
    assert main(["evaluate", str(tmp_path / "a"), str(tmp_path / "b")]) == 0 and '"word_recall":0.333' in capsys.readouterr().out


def test_lunar_calendar(value):
    cal = L.LunarCalendar()
    assert [cal.lunar_date(dt.date(*d)) for d in ((2024, 11, 15), (2024, 1, 1), (2024, 12, 31))] == ["ขึ้น 15 ค่ำ เดือน 12", "แรม 5 ค่ำ เดือน 1", "ขึ้น 2 ค่ำ เดือน 2"]
    assert cal.lunar_date(None) is None and cal.lunar_date(dt.date(1885, 1, 1)) is None and cal.lunar_date(dt.date(2461, 1, 1)) is None
    assert [L.days_in_year(y) for y in (1900, 2000, 2023, 2024)] == [365, 366, 365, 366]
    assert cal.deviation(2021) == pytest.approx(-0.484674999991406) and cal.ends[2012] == dt.date(2012, 11, 13) and cal.ends[2452] == dt.date(2452, 12, 11)
    assert value(L.lunar_date(F.lit("2024-11-15"))) == "ขึ้น 15 ค่ำ เดือน 12"


def test_sentences_by_rules(spark):
    from saithong.operators import sentences as Z

    d = S.Dictionary("ฉัน รัก ไป โรงเรียน และ หรือ จึง บ้าน เธอ กิน ข้าว เขา ไม่ มา เพราะ ฝน ตก".split())
    cases = {
        "ฉันไปโรงเรียน เมื่อเธอกินข้าว": ["ฉันไปโรงเรียน", "เมื่อเธอกินข้าว"], "ฉันไม่มาเพราะฝนตก": ["ฉันไม่มา", "เพราะฝนตก"], "ฉันกินข้าวค่ะเขาไปบ้าน": ["ฉันกินข้าวค่ะ", "เขาไปบ้าน"], "เธอมา!ฉันไป?เขาไม่มา": ["เธอมา!", "ฉันไป?", "เขาไม่มา"],
        "ฉันรักเพื่อน": ["ฉันรักเพื่อน"], "ฉันรักเธอและเขา ฉันไปบ้าน": ["ฉันรักเธอและเขา", "ฉันไปบ้าน"], "ฉันไปบ้านและเธอกินข้าวเขาไปโรงเรียน ฝนตก": ["ฉันไปบ้าน", "และเธอกินข้าวเขาไปโรงเรียน ฝนตก"], "": [],
    }
    assert {t: Z.split_sentences(t, d) for t in cases} == cases
    long = Z.split_sentences(" ".join(["ฉันรักเธอ"] * 12), d, cut_long=True)
    assert len(long) == 2 and " ".join(long) == " ".join(["ฉันรักเธอ"] * 12)
    given = S.broadcast_words(spark, list(d))
    assert spark.createDataFrame([(None,), ("ฝนตก\nเพราะฉันมา",)], "t string").select(Z.thai_sentences("t", given).alias("s")).collect() == [([],), (["ฝนตก", "เพราะฉันมา"],)]


def test_catalog(tmp_path, spark, capsys):
    from saithong.__main__ import main
    from saithong.sources.catalog import Catalog, safe_join, safe_name

    (tmp_path / "w.txt").write_text("\ufeffก # one\n\nข\n", encoding="utf-8")
    c = Catalog(tmp_path / "data")
    assert list(c) == [] and "w" not in c and c.path("w") is None and c.detail("w") == {}
    c.add("w", tmp_path / "w.txt", "1.0")
    c.add("w", tmp_path / "w.txt", "1.10")
    assert c.detail("w")["version"] == "1.10" and c.detail("w", "1.0")["file"] == "w-1.0.txt" and c.detail("w", "9") == {}
    assert c.lines("w") == ["ก", "ข"] and sorted(r.word for r in c.words(spark, "w").collect()) == ["ก", "ข"]
    assert main(["data", "get", "w", "--folder", str(c.folder)]) == 0 and capsys.readouterr().out.split() == ["ก", "ข"]
    assert main(["data", "path", "x", "--folder", str(c.folder)]) == 1
    assert c.remove("w") and not c.remove("w") and c.path("w") is None
    assert safe_name("../a b") == "_a_b"
    with pytest.raises(ValueError):
        safe_join(tmp_path, "..", "x")
    with pytest.raises(KeyError):
        c.lines("w")


def test_tags_and_emoji(spark):
    from saithong.operators import tagging as G

    tagger = L.PerceptronTagger()
    tagger.train([[("คน", "NCMN"), ("<space>", "PUNC"), ("กิน", "VACT")]] * 30)
    df = spark.createDataFrame([(1, ["คน", " ", "กิน"]), (2, []), (3, None)], "id int, t array<string>")
    got = {r.id: r.tagged for r in G.pos_tag(df, "t", "id", tagger=tagger, corpus="orchid", universal=True).collect()}
    assert [tuple(x) for x in got[1]] == [("คน", "NOUN"), (" ", "PUNCT"), ("กิน", "VERB")] and got[2] == []
    lexicon = spark.createDataFrame([("คน", "NN"), ("คน", "NN")], "word string, tag string")
    got = {r.id: r.tagged for r in G.pos_tag(df, "t", "id", lexicon=lexicon).collect()}
    assert [tuple(x) for x in got[1]] == [("คน", "NN"), (" ", ""), ("กิน", "")] and got[2] == [] and got[3] == []
    with pytest.raises(ValueError):
        G.pos_tag(df, "t", "id")
    assert L.ungroup_emoji(["👏🏽😀", "ab", "1", "👨‍👩‍👧", "🇹🇭😀", "ก"]) == ["👏🏽", "😀", "ab", "1", "👨‍👩‍👧", "🇹🇭", "😀", "ก"]
    lex = spark.createDataFrame([("คน", 5), ("ฝน", 9), ("กิน", 2)], "word string, n int")
    said = spark.createDataFrame([(1, ["คม", "กิน", "xyz"])], "id int, t array<string>")
    assert L.correct_sentences(said, "t", lex, "id").first().corrected == ["คน", "กิน", "xyz"]


def test_syllables_in_three_systems(spark):
    assert [X.syllables_to("กา", s) for s in ("paiboon", "royin", "ipa", "other")] == ["gaa", "ka", "kaː˧", "กา"]
    assert X.syllables_to("แมว", "royin") == "maeo" and X.syllables_to("แมว") == "mɛːw˧" and X.syllables_to("น้ำ", "paiboon") == "nám"
    assert X.syllables_to("อา-อา", "royin") == "a-a" or X.syllables_to("อา-อา", "royin") == "a-" + "a"
    assert X.syllables_to("กะ") == "kaʔ˨˩" and X.syllables_to("๑ x", "royin") == "1 x" and X.syllables_to(None) is None and X.syllables_to("ก่้า") == "ก่้า"
    r = spark.createDataFrame([("คน",)], "t string").select(X.all_systems("t").alias("s"), X.transliterate_syllables("t", "royin").alias("r")).first()
    assert tuple(r.s) == ("kon", "khon", "kʰon˧") and r.r == "khon"
