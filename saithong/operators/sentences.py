"""Thai sentences by rules: cue words and signs at which sentences begin or end, and long sentences cut at spaces.

A text's phrases in which a cue is part of another word are hidden first (moved to a private part of Unicode), so that the rules see none of them, and shown again at the end.
"""

from __future__ import annotations

import re

from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from saithong.functions.text import as_column
from saithong.operators.lexical import arrow
from saithong.operators.segment import Dictionary, dictionary_of, tokenize

# Words that begin a sentence, end one, begin or end one next to a space, and titles behind a numbered item.
BEGINS = "ทำให้ โดย เพราะ นอกจากนี้ แต่ กรณีที่ หลังจากนี้ ต่อมา ภายหลัง นับตั้งแต่ หลังจาก ซึ่งเหตุการณ์ ผู้สื่อข่าวรายงานอีก ส่วนที่ ส่วนสาเหตุ ฉะนั้น เพราะฉะนั้น เพื่อ เนื่องจาก จากการสอบสวนทราบว่า จากกรณี จากนี้ อย่างไรก็ดี".split()
ENDS = ["กล่าวว่า", "เปิดเผยว่า", "รายงานว่า", "ให้การว่า", "เผยว่า", "บนทวิตเตอร์ว่า", "แจ้งว่า", "พลเมืองดีว่า", "อ้างว่า"]
POLITE = ["ครับ", "ค่ะ"]
ENDS_BEFORE_SPACE = ["หรือไม่", "โดยเร็ว", "แล้ว", "อีกด้วย"]
BEGINS_BEHIND_SPACE = "ล่าสุด เบื้องต้น ซึ่ง ทั้งนี้ แม้ว่า เมื่อ แถมยัง ตอนนั้น จนเป็นเหตุให้ จากนั้น อย่างไรก็ตาม และก็ อย่างใดก็ตาม เวลานี้ เช่น กระทั่ง".split()
TITLES = "นาย|นาง|นางสาว|เด็กชาย|เด็กหญิง|น.ส.|ด.ช.|ด.ญ."
#: Phrases that aren't cues, in the order in which they are looked for; of those with brackets only what is inside is hidden.
HIDDEN = [
    "โดยเร็ว", "เพื่อน", "แต่ง", "โดยสาร", "แล้วแต่", "หรือเปล่า", "หรือไม่", "จึงรุ่งเรืองกิจ", "ตั้งแต่", "แต่ละ", "วิตแล้ว", "โดยประ", "แต่หลังจากนั้น", "พรรคเพื่อ", "แต่เนื่อง", "เพื่อ[ทำให้]", "ทำ[เพื่อ]", "จึง[ทำให้]", "มาโดยตลอด", "แต่อย่างใด", "แต่[หลังจาก]", "คงทำให้", "แต่[ทั้งนี้]",
    "มี[แต่]", "เหตุที่ทำให้", "โดย[หลังจาก]", "ซึ่ง[หลังจาก]", "ตั้งโดย", "โดยตรง", "นั้นหรือ", "ซึ่งต้อง[ทำให้]", "ชื่อ[ต่อมา]", "[โดย]เร่งด่วน", "ไม่ได้[ทำให้]", "จะ[ทำให้]", "จน[ทำให้]", "เว้น[แต่]", "ก็[ทำให้]", " ณ [ตอนนั้น]", "บาง[ส่วน]", "หรือ[แม้แต่]", "โดย[ทำให้]", "หรือ[เพราะ]", "มา[แต่]",
    "แต่[ไม่ทำให้]", "ฉะนั้น[เมื่อ]", "เพราะ[ฉะนั้น]", "เพราะ[หลังจาก]", "สามารถ[ทำให้]", "อาจ[ทำ]", "จะ[ทำ]", "และนอกจากนี้", "อีกทั้ง[เพื่อ]", "ทั้งนี้[เพื่อ]", "เวลา[ต่อมา]", "อย่างไรก็ตาม[หลังจาก]", "ซึ่ง[ทำให้]", "[โดย]ประมาท", "[โดย]ธรรม", "[โดย]สัจจริง",
]
#: Connectives: tokens within which the next space ends the sentence (else it ended before the connective), and tokens before the text's end where one says nothing.
CONNECTIVES = {"และ": (5, 3), "หรือ": (4, 3), "จึง": (3, 2)}
LONG = 20  # words from which on a sentence is cut

STOP = "\ue0ff"
_SHIFT = 0xE000 - 0x0E00
_HIDE = {c: c + _SHIFT for c in range(0x0E00, 0x0E80)}
_SHOW = {v: k for k, v in _HIDE.items()}


def _hiding(phrase: str) -> tuple[str, str]:
    """(a phrase, what it becomes). Two of them change the text too: one loses its conjunction, one begins a sentence."""
    if phrase == "และนอกจากนี้":
        return phrase, "นอกจากนี้"
    before, bracket, rest = phrase.partition("[")
    inside, _, behind = rest.partition("]")
    plain = before + inside + behind
    said = before + inside.translate(_HIDE) + behind if bracket else phrase.translate(_HIDE)
    return plain, (STOP if plain == "อย่างไรก็ตามหลังจาก" else "") + said


_HIDINGS = [_hiding(p) for p in HIDDEN]
_any = "|".join
_CUES = [
    (f" ({_any(BEGINS_BEHIND_SPACE)})", f"{STOP}\\1"), (f"({_any(POLITE)})", f"\\1{STOP}"), (f"({_any(BEGINS)})", f"{STOP}\\1"), (f"({_any(ENDS)})", f"\\1{STOP}"), (f" ([0-9])[.]({TITLES})", f"{STOP}\\1.\\2"), (f" ([0-9][0-9])[.]({TITLES})", f"{STOP}\\1.\\2"),
    (f"([ก-๙])({_any(ENDS_BEFORE_SPACE)}) ", f"\\1\\2{STOP}"), (r"\.”", "”."), (r'\."', '".'), ('!"', '"!'), (r'\?"', '"?'), (r"([?!])", f"\\1{STOP}"),
]


def _at_connective(tokens: list[str], word: str, near: int, last: int) -> list[str]:
    """Tokens with stops for a connective: in place of the next space, if it is near, else before the connective. A space right behind it doesn't count."""
    places = [i for i, t in enumerate(tokens) if t == word]
    ends, begins = [], []
    free = 0  # what is before is done
    for k, at in enumerate(places):
        if at < free:
            continue
        if len(tokens) - at == last:
            begins.append(len(tokens))
            continue
        space = next((i for i in range(at + 2, len(tokens)) if tokens[i] == " "), None)
        if space is None or k + 1 < len(places) and places[k + 1] < space:
            continue
        (ends if space - at < near else begins).append(space if space - at < near else at)
        free = space
    out = list(tokens)
    for i in ends:
        out[i] = STOP
    for i in begins:  # places are those before any stop was put in: later ones come out as many tokens earlier
        out.insert(i, STOP)
    return out


def _squeezed(tokens: list[str]) -> str:
    return " ".join("".join(tokens).split())


def _tight_digits(s: str) -> str:
    """A sentence without single spaces beside digits inside it."""
    at = 1
    while at + 1 < len(s):
        if s[at].isdigit() and s[at - 1] == " ":
            s = s[: at - 1] + s[at:]
        if s[at : at + 2].endswith(" ") and s[at].isdigit() and at + 2 <= len(s):
            s = s[: at + 1] + s[at + 2 :]
        at += 1
    return s


def _halved(sentence: str, words: Dictionary) -> list[str]:
    """A long sentence cut at the spaces nearest to the ends of equal parts."""
    size = len(tokenize(sentence, words, keep_whitespace=False))
    sentence = _tight_digits(sentence)
    parts = size // LONG if size > LONG else 0
    if not parts:
        return [sentence]
    tokens = tokenize(sentence, words)
    spaces = [i for i, t in enumerate(tokens) if t == " "]
    for k in range(1, parts + 1):
        if not spaces:
            break
        nearest = min(spaces, key=lambda i: abs(i - size / (parts + 1) * k))
        spaces.remove(nearest)
        tokens[nearest] = STOP
    return _squeezed(tokens).split(STOP)


def split_sentences(text: str | None, words: Dictionary, cut_long: bool = False) -> list[str]:
    """The sentences of a Thai text; cut_long: those of more than LONG words in parts."""
    text = f" {text or ''} ".replace("\n", " ")
    for phrase, hidden in _HIDINGS:
        text = text.replace(phrase, hidden)
    for word, (near, last) in CONNECTIVES.items():
        if word in text:
            text = _squeezed(_at_connective(tokenize(text.strip(), words), word, near, last))
    for pattern, to in _CUES:
        text = re.sub(pattern, to, text)
    found = [s for s in (x.strip() for x in text.translate(_SHOW).split(STOP)) if s and s != "nan"]
    return [s for x in found for y in _halved(x, words) if (s := y.strip())] if cut_long else found


def thai_sentences(text: Column | str, words: Broadcast, cut_long: bool = False) -> Column:
    """split_sentences() of a column, with a dictionary for its connectives; null and empty texts have none."""
    return arrow(lambda t: split_sentences(t, dictionary_of(words), cut_long), "array<string>")(as_column(F.coalesce(as_column(text), F.lit(""))))
