"""The operators as SQL functions: register_all() makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saithong.operators import lexical as L
from saithong.operators import scripts as X
from saithong.operators import segment as S


def _udf(f, returns: str, *, several: bool = False):
    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*r) for r in zip(*columns, strict=True)], dtype=object)

    return run


def register_all(spark: SparkSession, words: Iterable[str] = ()) -> list[str]:
    """Registers functions of one text (and two for code similarity), and the table function thai_segmentations(text[, most]), whose rows are the first `most` (1000) ways to cut a text; returns their names. words: the dictionary of the tokenizers."""
    given = S.broadcast_words(spark, words)
    text = {
        "thai_tokens": (lambda t: S.tokenize(t, S.dictionary_of(given)), "array<string>"),
        "thai_tokens_longest": (lambda t: S.tokenize(t, S.dictionary_of(given), "longest"), "array<string>"),
        "thai_clusters": (S.tcc, "array<string>"), "thai_numeral": (lambda t: None if t is None else L.thaiword_to_num(t), "bigint"),
        "thai_syllable_sound": (L.sound_syllable, "string"), "thai_tone": (L.tone, "string"), "thai_rtgs": (X.rtgs, "string"), "thai_braille": (lambda w: "".join(" " if c == "-1" else X.cell(c) for c in X.braille_cells(w)), "string"),
    }
    for name, (f, returns) in text.items():
        spark.udf.register(name, _udf(f, returns))
    listed = list(given.value)

    @F.udtf(returnType=T.StructType([T.StructField("segmentation", T.StringType())]))
    class Segmentations:
        def __init__(self):
            self.words = S.Dictionary(listed)

        def eval(self, text: str, most: int = 1000):
            for s in S.all_segmentations(text, self.words, most):
                yield (s,)

    spark.udtf.register("thai_segmentations", Segmentations)
    return [*text, "thai_segmentations"]
