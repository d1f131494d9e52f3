"""Token counts: batched encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saithong.llm.common import by_bytes, held, tidied

#: Places before which byte-level pre-tokenizers begin a new piece, whatever surrounds them: a lone blank or line end between two other characters (Python's white space contains all that Unicode calls so, hence no place is unsafe).
_SAFE = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: Further such places, for long pieces without white space: where letters, digits and other characters meet, but for an apostrophe before letters.
_TURN = regex.compile(r"(?V1)(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
_BARE = "\ud800"  # marks pieces without a blank before them; no text has it
_BATCH_BYTES = 1 << 20
_MEMO = 300_000
_LONG = 64
_VERY_LONG = 2048


class Library(NamedTuple):
    """A tokenizer file: how many tokens each of many strings has; kind: byte (texts may be cut at _SAFE and _TURN, but not inside special strings), word (at lone blanks, which pieces lose) or whole."""

    count: Callable[[list[str]], list[int]]
    kind: str
    special: list[str]


def _byte_level(config: dict) -> bool:
    """Whether a file of the tokenizers library pre-tokenizes bytes by the usual pattern, and nothing looks beyond its pieces: no normalizer, and no added token with or around white space."""
    pre = config.get("pre_tokenizer") or {}
    added = config.get("added_tokens") or []
    return config.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and pre.get("add_prefix_space") is False and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)


def _by_words(model) -> bool:
    """Whether a sentencepiece model's pieces never reach over a blank, so that words can be encoded apart."""
    inner = any("\u2581" in model.id_to_piece(k).lstrip("\u2581") for k in range(model.get_piece_size()))
    probes = [("a b", ["a", "b"]), ("The end. of", ["The", "end.", "of"]), ("\u00e9t\u00e9 \u65e5\u672c", ["\u00e9t\u00e9", "\u65e5\u672c"])]
    return not inner and all(model.encode(t) == [i for p in parts for i in model.encode(p)] for t, parts in probes)


def load(path: str) -> Library:
    """A tokenizer file (.json of the tokenizers library, .model of sentencepiece); once per Python worker."""
    if (__name__, path) not in held:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            held[__name__, path] = Library(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], "word" if _by_words(model) else "whole", [])
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            config = json.loads(model.to_str())
            held[__name__, path] = Library(lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], "byte" if _byte_level(config) else "whole", [t["content"] for t in config.get("added_tokens") or []])
    return held[__name__, path]


def _batched(count: Callable[[list[str]], list[int]], texts: list[str]) -> list[int]:
    """Counts of strings, which go to the library in batches of about as many bytes."""
    out: list[int] = []
    batch: list[str] = []
    size = 0
    for t in texts:
        n = len(t.encode())
        if size and size + n > _BATCH_BYTES:
            out += count(batch)
            batch, size = [], 0
        batch.append(t)
        size += n
    return out + count(batch) if batch else out


class Counter:
    """Counts tokens of texts. Texts are split at safe boundaries; each distinct piece of a batch is encoded once, and short pieces are remembered up to a bound."""

    def __init__(self, path: str):
        self.library = load(path)
        self.memo: dict[str, int] = {}
        special = "|".join(map(re.escape, sorted(self.library.special, key=len, reverse=True)))
        self.special = re.compile(f"({special})") if special else None

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text, as the library is to see them but for a blank before each; those that have none begin with _BARE or a line end."""
        if self.library.kind == "word":
            return _SAFE_BLANK.split(text)
        out = _SAFE.split(text)
        out[0] = _BARE + out[0]
        if max(map(len, out)) <= _VERY_LONG:
            return out
        short: list[str] = []
        for p in out:
            if len(p) <= _VERY_LONG:
                short.append(p)
                continue
            whole = self._said(p)
            for i, part in enumerate(self.special.split(whole) if self.special else [whole]):
                short += [_BARE + x for x in ([part] if i % 2 else _TURN.split(part)) if x]
        return short

    def _said(self, piece: str) -> str:
        if self.library.kind == "word" or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == _BARE else f" {piece}"

    def __call__(self, texts: list[str]) -> list[int]:
        if self.library.kind == "whole":
            return _batched(self.library.count, texts)
        parts = [self._pieces(t) for t in texts]
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo = self.memo
        new = [x for x in dict.fromkeys(x for p in parts for x in p if x not in memo)]
        memo.update(zip(new, _batched(self.library.count, [self._said(x) for x in new]), strict=True))
        out = [sum(map(memo.__getitem__, p)) for p in parts]
        for x in new:
            if len(x) > _LONG:
                del memo[x]
        return out


_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    path: a file of the tokenizers library (.json) or of sentencepiece (.model). No special tokens are added; special strings inside texts are handled as the library does by default.
    A null text counts as the empty text (0 bytes). Repeated rows and null ids give a row each; an empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n: list[int] = []
            for start, end in by_bytes(texts, 4 * _BATCH_BYTES):
                n += counter(texts[start:end].to_pylist())
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts).cast(pa.int64()), tokens, pc.greater(tokens, limit)], [id_col, *schema.names])

    out = f"`{id_col}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), out)
