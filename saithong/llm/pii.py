"""Personal data: regular expressions propose spans, checksums confirm them, and words nearby adjust their scores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saithong.llm.common import tidied

# The patterns of the base kinds.
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # from the first digit of a run: what begins later in it would have begun there
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Patterns of the kinds that this operator adds: personal numbers, and secrets.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
_NATIONAL = re.compile(r"(?<![0-9.,/-])(?:0[0-9]{1,3}[\x20-])[0-9]{3}[\x20-][0-9]{3,4}(?![0-9-])")
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----(?:[^-]{0,8000}-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----)?")
#: Keys with a known beginning, web tokens of three parts, and passwords inside addresses.
_KNOWN_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255}|glpat-[A-Za-z0-9_-]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,255}|AIza[A-Za-z0-9_-]{35}|[sr]k[-_](?:live|test|proj)[-_][A-Za-z0-9_-]{16,255}|sk-[A-Za-z0-9_-]{20,255}|hf_[A-Za-z0-9]{20,64}|npm_[A-Za-z0-9]{20,64}|eyJ[A-Za-z0-9_-]{8,4000}\.eyJ[A-Za-z0-9_-]{4,4000}\.[A-Za-z0-9_-]{4,4000})(?![A-Za-z0-9_])")
_URL_PASSWORD = re.compile(r"(?<![A-Za-z])[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,100}:[^\s:/@]{3,200}@[A-Za-z0-9.-]{1,200}")
#: A value given to a name that says secret: the value is what counts.
_NAMED_SECRET = re.compile(r"""(?i)(?<![a-z])(?:api[_-]?key|secret(?:[_-]?(?:access[_-]?)?key)?|access[_-]?(?:key|token)|auth[_-]?token|token|passw(?:or)?d|pwd|private[_-]?key|client[_-]?secret)["']?\x20?[:=]\x20?["']?(?=([^\s"',;]{8,300}))""")

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "mac", "local_phone", "private_key", "secret")
#: Score of a span of each kind before its context is seen, and the least score at which an added kind is reported.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.5, "mac": 0.7, "local_phone": 0.35, "private_key": 1.0, "secret": 0.8}
LEAST = 0.6
#: Words that raise a kind's score when they stand in the text nearby (lower case).
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("call", "phone", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "mac": ("mac", "device", "hardware"),
    "local_phone": ("call", "phone", "tel", "mobile", "fax"),
    "private_key": ("key", "secret"),
    "secret": ("key", "secret", "token", "password", "credential"),
}
_NEAR = 40
_RAISE = 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN without blanks."""
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them from the left; only the surroundings of each @ are looked at."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _EMAIL_DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _varied(s: str) -> bool:
    """Whether a value looks made by a machine: letters and digits, and few repeats."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(set(s)) >= 6


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    found = [m.span() for p in (_KNOWN_SECRET, _URL_PASSWORD) for m in p.finditer(text)]
    found += [m.span(1) for m in _NAMED_SECRET.finditer(text) if _varied(m[1])]
    end = -1
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):  # overlapping ones are one
        if s >= end:
            yield s, e
            end = e


def _matches(pattern: re.Pattern[str], confirm: Callable[[str], bool] = lambda s: True) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if confirm(m[0]))


def _octets(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))


#: kind: (a character that a text must have, proposals that are confirmed)
_PROPOSE = {
    "email": ("@", _emails),
    "ip": (".", _matches(_IP, _octets)),
    "card": ("", _matches(_CARD, _card)),
    "phone": ("+", _matches(_PHONE, lambda s: 9 <= len(_digits(s)) <= 15)),
    "iban": ("", _matches(_IBAN, lambda s: mod97(s.replace(" ", "")))),
    "ssn": ("-", _matches(_SSN)),
    "mac": (":", _matches(_MAC)),
    "local_phone": ("", _matches(_NATIONAL)),
    "private_key": ("-----BEGIN ", _matches(_PRIVATE_KEY)),
    "secret": ("", _secrets),
}
_NO_DIGIT = ("email", "private_key", "secret")
_ANY_DIGIT = re.compile(r"[0-9]")


def find(text: str) -> list[tuple[int, int, int, float]]:
    """(start, end, place of the kind in KINDS, score) of each span, sorted. Base kinds (the first four) stay whatever their score; an added one needs LEAST and no overlap with a base span, but for private keys and secrets, which may hold one."""
    base: list[tuple[int, int, int]] = []
    added: list[tuple[int, int, int]] = []
    digits = bool(_ANY_DIGIT.search(text))
    for k, kind in enumerate(KINDS):
        needs, propose = _PROPOSE[kind]
        if (digits or kind in _NO_DIGIT) and needs in text:
            (base if k < 4 else added).extend((s, e, k) for s, e in propose(text))
    added = [x for x in added if KINDS[x[2]] in _NO_DIGIT or not any(x[0] < e and s < x[1] for s, e, _ in base)] if base else added
    out = []
    for s, e, k in base + added:
        around = f"{text[max(0, s - _NEAR) : s]} {text[e : e + _NEAR]}".lower()
        score = min(1.0, BASE_SCORE[KINDS[k]] + _RAISE * any(re.search(rf"(?<![a-z]){w}", around) for w in CONTEXT[KINDS[k]]))
        if k < 4 or score >= LEAST:
            out.append((s, e, k, score))
    return sorted(out, key=lambda x: (x[0], x[2]))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as kind:start:end, comma-joined), spans (all of them, joined likewise) and found, an array of (kind, start, end, score). Places are code points, ends exclusive.

    A null text is the empty text: no spans. Repeated rows and null ids give a row each; an empty table gives no rows; other columns of docs are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), found_type]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in pc.fill_null(b.column(1), ""):
                spans = find(t.as_py())
                said = [f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in spans]
                base = ",".join(x for x, (_, _, k, _) in zip(said, spans, strict=True) if k < 4)
                counts = [sum(x[2] == k for x in spans) for k in range(4)]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), [{"kind": KINDS[k], "start": s, "end": e, "score": v} for s, e, k, v in spans]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [id_col, *names])

    out = f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, found array<struct<kind: string, start: bigint, end: bigint, score: double>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), out)
