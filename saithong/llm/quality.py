"""Quality rules in a short-circuit cascade: cost and selectivity are measured on a sample, then rules run in order of rejection per cost.

Native: a rule is a Column, and the cascade is a CASE expression, of which Spark evaluates no branch behind the first that holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saithong.llm.common import SPACE, cut, drop, let, words_of

_SYMBOLS = "[^#*$%&|<>]+"
_REPEAT = 5  # words in a window
SAMPLE = 1000  # rows on which costs and selectivities are estimated, about


@dataclass(frozen=True)
class Rule:
    """reject: true for a bad row; null counts as false. cost: seconds for a row, if known; else it is measured."""

    name: str
    reject: Column
    cost: float | None = None


def repeated_words(words: Column, n: int = _REPEAT) -> Column:
    """Number of words inside n-word windows that occur at least twice in an array of words.

    Windows are compared by 64-bit hashes. Only arrays with equal hashes are sorted.
    """

    def covered(hashes: Column) -> Column:
        places = lambda s: F.filter(  # noqa: E731  of windows whose neighbour in the order of hashes is equal
            F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda p: p.isNotNull()
        )
        width = lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(at, i + 1) - p, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x
        )
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, lambda s: let(F.sort_array(places(s)), width)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) <= n, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) and n_chars of each row, in one pass without a shuffle; and the columns named in keep."""
    text = docs.select(F.col(id_col), F.col(text_col).alias("_t"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)))
    t = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    by_words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = text.select(
        id_col, by_words.alias("_w"), by_lines.alias("_l"), F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"), F.length(F.regexp_replace(t, _SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(t).cast("long").alias("n_chars"), *(F.col(f"_k{i}") for i in range(len(keep))),
    )
    return out.select(id_col, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_chars", *(F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)))


def few_letters(text: Column, word_chars: Column) -> Column:
    """Whether less than half of a text's characters other than white space are letters."""
    return 2 * F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", "")) < word_chars


def shouting(text: Column) -> Column:
    """Whether more than half of a text's letters A-Z and a-z are capitals."""
    t = F.coalesce(text, F.lit(""))
    return 2 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > F.length(F.regexp_replace(t, "[^A-Za-z]+", ""))


def default_rules(text: Column) -> list[Rule]:
    """Rules on the columns of features() and on the text. The first two make base_failed; the others are the method's own, wide enough to leave prose alone."""
    c, n = F.col, F.col("n_words")
    return [
        Rule("few_words", n < 10),
        Rule("repeated_words", 100 * c("n_repeat_words") > 20 * n),
        Rule("symbols", 10 * c("n_symbols") > n),
        Rule("repeated_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        Rule("word_length", (c("word_chars") < 2 * n) | (c("word_chars") > 20 * n)),
        Rule("few_letters", few_letters(text, c("word_chars"))),
        Rule("shouting", shouting(text)),
    ]


def text_rules(text: Column) -> list[Rule]:
    """The same rules on texts, for filtering without features: each looks at the text itself, so that short-circuiting saves work."""
    t = F.coalesce(text, F.lit(""))
    n = F.size(words_of(t))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    length = F.length(F.regexp_replace(t, SPACE, ""))
    return [
        Rule("few_words", n < 10),
        Rule("repeated_words", let(words_of(t), lambda w: 100 * repeated_words(w) > 20 * F.size(w))),
        Rule("symbols", 10 * F.length(F.regexp_replace(t, _SYMBOLS, "")) > n),
        Rule("repeated_lines", let(lines, lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 3 * F.size(x))),
        Rule("word_length", (length < 2 * n) | (length > 20 * n)),
        Rule("few_letters", few_letters(text, length)),
        Rule("shouting", shouting(text)),
    ]


def hashed_sample(docs: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About `rows` rows of docs, by a hash of these columns: from the whole table, and the same in each run. Equal rows are in it together or not at all."""
    parts = max(1, docs.count() // rows)
    return docs.filter(F.pmod(F.xxhash64(*columns), F.lit(parts)) == 0)


def _seconds(df: DataFrame, *columns: Column, runs: int = 3) -> float:
    """The least time in which columns of all rows are computed."""
    took = []
    for _ in range(runs):
        start = time.perf_counter()
        df.select(*columns).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    return min(took)


def ordered_rules(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, cost, share of rows that it rejects) in order of rejection per cost, on a sample that is small enough to be gone through several times: a rule's cost is the time that the sample's rows take with it, less that without. Ties by name. The order changes what a cascade costs, never what it keeps."""
    rows, *shares = sample.agg(F.count("*"), *(F.coalesce(F.avg(F.coalesce(r.reject, F.lit(False)).cast("double")), F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(rules))).first()
    bare = _seconds(sample, F.lit(True)) if rows and any(r.cost is None for r in rules) else 0.0
    cost = lambda r: r.cost if r.cost is not None else (_seconds(sample, r.reject.alias("x")) - bare) / rows if rows else 1.0
    found = [(r, max(cost(r), 1e-9), share) for r, share in zip(rules, shares, strict=True)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a row, or null. Later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.reject, F.lit(r.name)).otherwise(out)
    return out


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Callable[[Column], list[Rule]] = default_rules, sample: int = SAMPLE) -> DataFrame:
    """features() of each row with base_failed, kept (no rule rejects it) and rejected_by.

    All features are wanted, so they come first; of the rules on texts a row sees only those before the first that rejects it. A null or empty text has no words and fails few_words. Repeated rows and null ids give a row each; an empty table gives no rows; other columns of docs are ignored. Several rules can hold: rejected_by names one of them.
    """
    narrow = docs.select(F.col(id_col), F.col(text_col))
    with_text = lambda df: features(df, id_col=id_col, text_col=text_col, keep=(text_col,)).withColumnRenamed(text_col, "own_text")
    every = rules(F.col("own_text"))
    seen = cut(with_text(hashed_sample(narrow, sample, id_col, text_col)), "sample")
    order = [r for r, _, _ in ordered_rules(seen, every)]
    drop(seen)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = with_text(narrow).withColumn("rejected_by", cascade(order)).withColumn("base_failed", base).drop("own_text")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns. The cascade runs on the texts."""
    seen = cut(hashed_sample(docs.select(F.col(text_col).alias("text")), sample, "text"), "sample")
    order = [r.name for r, _, _ in ordered_rules(seen, text_rules(F.col("text")))]
    drop(seen)
    rules = {r.name: r for r in text_rules(F.col(text_col))}
    return docs.filter(cascade([rules[name] for name in order]).isNull())
