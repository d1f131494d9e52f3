"""Thai prosody: the vowel and final of a syllable, rhyme, weight, tone marks. Rhyme keys make the search for rhymes an equi-join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saithong import chars as C
from saithong.functions.text import as_column
from saithong.operators.lexical import arrow, sound_syllable

# Spellings with exceptions.
_SILENT = {"กษมณ์": 4, "กษณ์": 3, "ตริย์": 4, "ญจน์": 3, "ตร์": 3, "ทร์": 3, "ดร์": 3, "ฎร์": 3}
_MUTE_ENDING = tuple("เกียรติ ชาติ ญาติ มัติ วัติ บัติ ญัติ ยัติ ภูมิ พฤติ พรรดิ วรรดิ พยาธิ โพธิ เกตุ เมรุ เหตุ ธาตุ วุฒิ สมมุติ วิมุติ".split())
_ALONE = set("บ ณ ธ พณ ฤ ฦ".split())
_LIGHT = set("บ บ่ ณ ธ ก็ ฤ ฦ".split())
_CLUSTERS = {"ล": set("กล ขล คล ปล ผล พล หล ถล ฉล สล ศล ตล".split()), "ร": set("กร ขร คร ตร ปร พร ฟร บร ศร สร หร".split()), "ว": set("กว ขว คว สว หว ทว ชว ศว ถว".split())}
_OPEN_WA = set("เขว เหว่ แคว แหว โคว โหว โหว่".split())
_FINALS = {c: name for name, chars in {"กง": "ง", "กม": "ม", "เกย": "ย", "เกอว": "ว", "กก": "กขคฆ", "กด": "จชซฎฏฐฑฒดตถทธศษส", "กน": "ญณนรลฬ", "กบ": "บปพฟภ"}.items() for c in chars}
_HEAVY_VOWELS = set("อา อี อือ อู เอ แอ เออ โอ ออ เอีย เอือ อัว อำ ไอ เอา".split())
_SPOKEN_VOWELS = set("เออะ เออ เอ เอะ เอา เอาะ".split())
_RUE_AS_I = "กฤช กฤต กฤษ ตฤต ตฤณ ทฤษ ปฤษ ศฤง สฤต ฤทธ".split()
_SIGN = {"ะ": "อะ", "ั": "อะ", "ิ": "อิ", "ุ": "อุ", "ึ": "อึ", "ี": "อี", "ู": "อู", "ื": "อือ", "เ": "เอ", "แ": "แอ", "า": "อา", "โ": "โอ", "ำ": "อำ", "อ": "ออ", "ไ": "ไอ", "ใ": "ไอ", "็": "็"}
_LETTERS = set(C.CONSONANTS + "ฤฦ")


def spoken(word: str) -> str:
    """A word without what a karan at its end silences."""
    if not word.endswith("์"):
        return word
    for ending, n in _SILENT.items():
        if word.endswith(ending):
            return word[:-n]
    return word[: -3 if len(word) >= 3 and word[-2] in "ิีึืุูั" else -2]


def _bare(word: str) -> str:
    return re.sub(f"[{C.TONE_MARKS}]", "", word)


def _some(w: str, chars: str) -> bool:
    return any(c in w for c in chars)


def closes(word: str) -> bool:
    """Whether a word's last letter is a final and not the second of a cluster or a part of its vowel."""
    said = spoken(word)
    w = _bare(said)
    letters = [c for c in w if c in _LETTERS]
    if len(w) < 2 or len(letters) < 2:
        return False
    last, pair = w[-1], letters[0] + letters[1]
    if last == "ย" and (_some(w, "ไใ") or ("เ" in w and "ี" in w)):
        return False
    if last not in "ลรว" or len(letters) != 2 or not _some(w, "เแโไใ"):
        return True
    if pair not in _CLUSTERS[last]:
        return not (last == "ว" and not _some(w, "ไใ") and said in _OPEN_WA)
    if last == "ว":
        return not (_some(w, "ไใ") or said in _OPEN_WA)
    return last == "ล" and w == "เพล"


def final(word: str | None) -> str | None:
    """The class of a syllable's final (แม่), กา for none."""
    if word is None:
        return None
    said = spoken(word)
    w = _bare(said)
    if not w:
        return ""
    if w.endswith(_MUTE_ENDING):
        w = w[:-1]
    if re.search(".[ตชป]ร$|[ัิีุู][กขคฆท]ร$", w):
        w = w[:-1]
    if w in _ALONE or w.endswith(("ำ", "ํา")):
        return "กา"
    if w.endswith("ํ"):
        return "กง"
    glide = w[-1] in "ยลรว"
    open_end = sum(c in _LETTERS for c in w) == 1 or (_some(w, "ไใ") and not glide) or (glide and _some(w, "เแโไใ") and not closes(said))
    if open_end or w[-1] in "าๅะิีึุูอ" or ("ี" in w and w[-1] == "ย") or ("ั" in w and w[-1] == "ว"):
        return "กา"
    return _FINALS.get(w[-1], "กา")


class _Vowels(list):
    """Signs of vowels found so far; fuse() replaces several by what they make together."""

    def fuse(self, parts: tuple[str, ...], whole: str) -> bool:
        if any(self.count(p) < parts.count(p) for p in parts):
            return False
        for p in parts:
            self.remove(p)
        self.append(whole)
        return True


def vowel(word: str | None) -> str | None:
    """The vowel (สระ) of a syllable."""
    if word is None:
        return None
    said = spoken(word)
    bare = _bare(said)
    if not bare:
        return ""
    if bare.endswith(_MUTE_ENDING):
        said, bare = said[:-1], bare[:-1]
    whole = _fixed_vowel(word, said, bare)
    if whole:
        return whole
    v = _Vowels("อัว" if c == "ั" and bare.endswith("ว") else _SIGN[c] for c in said if c in _SIGN)
    if "รร" in said:
        v.append("อำ" if final(said) == "กม" else "อะ")
    once = said.count("อ") == 1
    if once and "ออ" in v and (said.startswith("อ") if len(v) == 1 else said[-1] == "อ" and "เ" not in said):
        v.remove("ออ")
    v.fuse(("เอ", "เอ"), "แอ")
    _ = v.fuse(("เอ", "อะ"), "เอะ") or v.fuse(("แอ", "อะ"), "แอะ")
    if "็" in v:
        _ = v.fuse(("็", "เอ"), "เอะ") or v.fuse(("็", "แอ"), "แอะ") or v.fuse(("็", "ออ"), "เอาะ") or v.fuse(("็",), "เอาะ")
    fused = v.fuse(("เอะ", "ออ"), "เออะ") or v.fuse(("เอ", "อิ"), "เออ") or (said[-1] == "อ" and v.fuse(("เอ", "ออ"), "เออ")) or v.fuse(("โอ", "อะ"), "โอะ") or v.fuse(("เอ", "อี"), "เอีย") or v.fuse(("เอ", "อา"), "เอา")
    if not fused and all(c in said for c in "เาะ"):
        v = _Vowels(["เอาะ"])
    if not v.fuse(("อือ", "เออ"), "เอือ"):
        if "ออ" in v and len(v) > 1:
            v.remove("ออ")
        elif "ว" in said and not v:
            v.append("ออ" if bare in ("บวร", "วร") else "อัว")
    if "ั" in said and final(said) == "กา" and "อัว" not in v:
        v = _Vowels(["ไอ"])
    if said in _SPOKEN_VOWELS:
        return said
    if all(c in said for c in "เือ"):
        return "เอือ"
    if "เอ" in v and bare.endswith("ย") and closes(spoken(word)) and not set(v) - {"เอ", "ออ"}:
        return "เออ"
    if v:
        return v[0]
    return "อะ" if len(said) < 2 else "ออ" if said[-1] == "ร" else "โอะ"


def _fixed_vowel(word: str, said: str, bare: str) -> str:
    """The vowels of ฤ and ฦ, of nikhahit, and of words of a letter or two."""
    if bare == "บ":
        return "ออ"
    if bare in ("ณ", "ธ", "อ", "พณ"):
        return "อะ"
    if "ํ" in said:
        return "อำ" if "ํา" in said else "อะ"
    whole = spoken(word)
    if any(x in whole for x in ("ฤา", "ฤๅ", "ฦา", "ฦๅ")):
        return "อือ"
    if _some(whole, "ฤฦ"):
        return "เออ" if said == "ฤก" or whole.startswith("ฤกษ") else "อิ" if any(x in whole for x in _RUE_AS_I) else "อึ"
    return ""


def rhyme_key(word: str | None) -> str | None:
    """Vowel and final of a syllable, joined by a slash, with equal sounds spelled alike: syllables rhyme if their keys are equal. Null for none."""
    if not word:
        return None
    v, m = vowel(word), final(word)
    if (v, m) == ("อะ", "เกย"):
        v, m = "ไอ", "กา"
    elif v in ("อะ", "อำ") and m == "กม":
        v, m = "อำ", "กา"
    return f"{v}/{m}"


def weight(word: str | None) -> str | None:
    """karu (heavy) or lahu (light); null for none."""
    if not word:
        return None
    return "lahu" if word in _LIGHT else "karu" if final(word) != "กา" or vowel(word) in _HEAVY_VOWELS else "lahu"


def mark(word: str | None, dead_is_aek: bool = False) -> str | None:
    """aek or too by the only tone mark of the two that a word has; null for neither or both."""
    if word is None:
        return None
    if ("่" in word) != ("้" in word):
        return "aek" if "่" in word else "too"
    return "aek" if dead_is_aek and sound_syllable(word) == "dead" else None


def prosody(x: Column | str) -> Column:
    """A struct of a syllable's vowel, final, key, weight and mark."""
    each = arrow(lambda w: {"vowel": vowel(w), "final": final(w), "key": rhyme_key(w), "weight": weight(w), "mark": mark(w)}, "struct<vowel:string,final:string,key:string,weight:string,mark:string>")
    return each(x)


def rhymes(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, rhyme): for words (word) the others of lexicon (word) with the same key: an equi-join on keys."""
    key = arrow(rhyme_key, "string")
    a = words.select("word", key("word").alias("key"))
    b = lexicon.select(F.col("word").alias("rhyme"), key("word").alias("k"))
    return a.join(b, F.col("key") == F.col("k")).filter("word <> rhyme").select("word", "rhyme").distinct()


def check_poem(stanzas: DataFrame, key: str, kind: int = 8) -> DataFrame:
    """(key, stanza, problem): what breaks the rules of a poem of klon 8 or 4, for stanzas (key, stanza from 1, lines: four arrays of syllables). Syllables are given: no segmenter for them comes with this package."""
    if kind not in (4, 8):
        raise ValueError("kind must be 4 or 8")
    most = 10 if kind == 8 else 5

    def one(lines: list) -> list[str]:
        lines = [list(x) for x in lines] if lines is not None else []
        if len(lines) != 4 or not all(lines):
            return ["a stanza needs four lines"]
        ends = [x[-1] for x in lines]
        head = lambda x: x[:5] if kind == 8 else x[: 3 if len(x) == 5 else 2]
        rhyme = lambda a, b: rhyme_key(a) is not None and rhyme_key(a) == rhyme_key(b)
        out = [f"line {i} is longer than {most}" for i, x in enumerate(lines, 1) if len(x) > most]
        for a, b in ((0, 1), (2, 3)):
            if not any(rhyme(ends[a], t) for t in head(lines[b])):
                out.append(f"the end of line {a + 1} doesn't rhyme with line {b + 1}")
        if not rhyme(ends[1], ends[2]):
            out.append("the ends of lines 2 and 3 don't rhyme")
        return out

    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("stanza")
    end = lambda i: F.element_at(F.get("lines", F.lit(i)), -1)
    same = arrow(lambda a, b: a is None or rhyme_key(a) == rhyme_key(b), "boolean")
    rows = stanzas.withColumn("before", F.lag(end(3)).over(w)).withColumn("second", end(1))
    own = arrow(one, "array<string>")("lines")
    linked = F.when(same("before", "second"), F.array().cast("array<string>")).otherwise(F.array(F.lit("line 2 doesn't rhyme with the stanza before")))
    return rows.select(key, "stanza", F.explode(F.concat(own, linked)).alias("problem"))
