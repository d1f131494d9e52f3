"""Text operators as stages of pyspark.ml pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame

from saithong.functions import text as T
from saithong.operators import segment as S


class TextTokenizer(Transformer, HasInputCol, HasOutputCol):
    """Words of a text column by a dictionary: engine newmm, newmm-safe, longest or mm."""

    engine = Param(Params._dummy(), "engine", "the segmenter", TypeConverters.toString)
    keepWhitespace = Param(Params._dummy(), "keepWhitespace", "whether white space is kept", TypeConverters.toBoolean)
    joinNumbers = Param(Params._dummy(), "joinNumbers", "whether parts of a number are joined", TypeConverters.toBoolean)

    def __init__(self, words: Iterable[str], inputCol: str = "text", outputCol: str = "tokens", engine: str = "newmm", keepWhitespace: bool = True, joinNumbers: bool = True):
        super().__init__()
        if engine not in S.ENGINES:
            raise ValueError(f"no engine {engine}")
        self.words = sorted(set(words))
        self._set(inputCol=inputCol, outputCol=outputCol, engine=engine, keepWhitespace=keepWhitespace, joinNumbers=joinNumbers)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        given = S.broadcast_words(df.sparkSession, self.words)
        return df.withColumn(get("outputCol"), S.word_tokenize(get("inputCol"), given, get("engine"), get("keepWhitespace"), get("joinNumbers")))


class ColumnSteps(Transformer, HasInputCol, HasOutputCol):
    """Functions of a column, one after another: cleaning rules, say, before a tokenizer or behind it."""

    def __init__(self, steps: Iterable[Callable[[Column], Column]], inputCol: str, outputCol: str):
        super().__init__()
        self.steps = list(steps)
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = T.as_column(self.getOrDefault("inputCol"))
        for f in self.steps:
            x = f(x)
        return df.withColumn(self.getOrDefault("outputCol"), x)


#: Rules before a tokenizer and behind it that language models were trained with.
SPARSE_BEFORE = [T.fix_html, T.rm_useless_spaces, T.rm_useless_newlines, T.rm_brackets, T.replace_url, T.replace_rep_nonum]
SPARSE_BEHIND = [lambda t: T.replace_wrep(t, number=False), T.lowercase_all, T.remove_space]
COUNTED_BEFORE = [T.fix_html, T.spec_add_spaces, T.replace_rep_after, T.rm_useless_spaces]
COUNTED_BEHIND = [T.replace_wrep, T.remove_space]
