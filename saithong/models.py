"""Operators that need models from elsewhere keep their names here; none of the models is part of this package."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class ModelUnavailable(NotImplementedError):
    """The operator needs a model that isn't available here."""

    def __init__(self, name: str):
        super().__init__(f"{name} needs a model that isn't part of this package; register() one")


#: By task: kinds of engines that need a model. An engine of any other name can be registered too.
KNOWN = {
    "word_tokenize": "cnn rnn ensemble icu", "sent_tokenize": "crf transformer", "paragraph_tokenize": "transformer", "subword_tokenize": "crf transformer", "syllable_tokenize": "crf", "pos_tag": "transformer", "ner": "crf transformer", "nested_ner": "transformer",
    "chunk": "crf", "parse": "transformer", "coref": "transformer", "entity_linking": "transformer", "wsd": "embedding", "romanize": "seq2seq", "transliterate": "seq2seq icu", "pronunciate": "seq2seq", "spell": "hunspell transformer embedding", "summarize": "seq2seq",
    "keywords": "embedding", "generate": "lm", "chat": "lm", "translate": "seq2seq lexicon", "augment": "embedding transformer wordnet", "word_vector": "embedding", "document_vector": "lm", "soundex": "ipa", "abbreviation": "embedding", "wordnet": "database",
}
_registered: dict[tuple[str, str], Callable[..., Any]] = {}


def register(task: str, engine: str, function: Callable[..., Any]) -> None:
    """Makes a function (of a column, say) known as an engine of a task."""
    _registered[task, engine] = function


def engine(task: str, name: str) -> Callable[..., Any]:
    """The registered function; ModelUnavailable for a known name without one, ValueError for others."""
    if (task, name) in _registered:
        return _registered[task, name]
    if name in KNOWN.get(task, "").split():
        raise ModelUnavailable(f"{task}({name})")
    raise ValueError(f"no engine {name} for {task}")
