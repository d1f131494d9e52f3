"""Classes of Thai characters.

Fixed values: Unicode's Thai block by role. ฤ and ฦ are vowels without a position; ํ is a vowel, an above vowel and a sign.
"""

CONSONANTS = "กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ"
LEAD_VOWELS = "เแโใไ"
FOLLOW_VOWELS = "ะาำๅ"
ABOVE_VOWELS = "ัิีึืํ็"
BELOW_VOWELS = "ุู"
VOWELS = "ฤฦ" + FOLLOW_VOWELS[:1] + "ั" + "าำ" + "ิีึื" + BELOW_VOWELS + LEAD_VOWELS + "ๅํ็"
TONE_MARKS = "่้๊๋"
SIGNS = "ฯฺๆ์ํ๎"
PUNCTUATION = "๏๚๛"
DIGITS = "๐๑๒๓๔๕๖๗๘๙"
BAHT = "฿"

#: Marks that stand above or below a base character and can't begin a word.
NON_BASE = ABOVE_VOWELS + BELOW_VOWELS + TONE_MARKS + "ฺ์ํ๎"
