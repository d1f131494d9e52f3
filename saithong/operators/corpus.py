"""Relational operators over token arrays: counts, keywords, summaries, overlap metrics, evaluation of segmentations, lookups.

Each takes and returns DataFrames. Tokens are an array column; documents are told apart by a key column.
"""

from __future__ import annotations

import gzip

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saithong.functions.text import as_column, char_name
from saithong.operators.lexical import arrow


def tokens_of(df: DataFrame, tokens: str, *keys: str) -> DataFrame:
    """(keys, pos, token): a row per token."""
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def rank(df: DataFrame, tokens: str, *keys: str, stop_words: DataFrame | None = None) -> DataFrame:
    """(keys, token, n): how often each token occurs, without those of stop_words (word)."""
    rows = df.select(*keys, F.explode(tokens).alias("token"))
    counts = rows.groupBy(*keys, "token").agg(F.count("*").alias("n"))
    return counts if stop_words is None else counts.join(stop_words.select(F.col("word").alias("token")), "token", "left_anti").select(*keys, "token", "n")


def find_keyword(df: DataFrame, tokens: str, *keys: str, stop_words: DataFrame | None = None, least: int = 3) -> DataFrame:
    """rank() with at least so many occurrences."""
    return rank(df, tokens, *keys, stop_words=stop_words).filter(F.col("n") >= least)


def ngrams(tokens: Column | str, n: int) -> Column:
    """The runs of n tokens, as arrays."""
    t = as_column(tokens)
    return F.when(F.size(t) < n, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, F.lit(n))))


def ngram_counts(df: DataFrame, tokens: str, *keys: str, least: int = 2, most: int = 4) -> DataFrame:
    """(keys, n, ngram, count) for runs of `least` to `most` tokens, joined by blanks. Counted as arrays' slices, joined once in the counts."""
    t = F.col(tokens)
    starts = F.sequence(F.lit(1), F.size(t) - least + 1)
    gram = lambda i, k: F.array_join(F.slice(t, i, F.lit(k)), " ")
    every = F.flatten(F.transform(starts, lambda i: F.array(*(F.struct(F.lit(k).alias("n"), F.when(i + k - 1 <= F.size(t), gram(i, k)).alias("ngram")) for k in range(least, most + 1)))))
    rows = df.filter(F.size(t) >= least).select(*keys, F.explode(every).alias("g")).select(*keys, "g.n", "g.ngram").filter(F.col("ngram").isNotNull())
    return rows.groupBy(*keys, "n", "ngram").agg(F.count("*").alias("count"))


def bigram_probabilities(df: DataFrame, tokens: str) -> DataFrame:
    """(w1, w2, n, prob): pairs of neighbours, and the share of all w1 that w2 follows. One pass over the tokens: the last one of a row counts with no w2."""
    rows = df.select(F.explode(F.arrays_zip(F.col(tokens).alias("w1"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("w2"))).alias("x")).select("x.w1", "x.w2")
    counts = rows.groupBy("w1", "w2").agg(F.count("*").alias("n"))
    all_of = counts.groupBy("w1").agg(F.sum("n").alias("m"))
    return counts.filter(F.col("w2").isNotNull()).join(all_of, "w1").select("w1", "w2", "n", (F.col("n") / F.col("m")).alias("prob"))


def extract_keywords(df: DataFrame, tokens: str, key: str, *, most: int = 5, least: int = 1, stop_words: DataFrame | None = None) -> DataFrame:
    """(key, place, token, n): the most frequent tokens of each document, earlier ones first among equals; those below `least` are dropped after the cut."""
    rows = tokens_of(df, tokens, key)
    if stop_words is not None:
        rows = rows.join(stop_words.select(F.col("word").alias("token")), "token", "left_anti")
    counts = rows.groupBy(key, "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first")))
    return placed.filter((F.col("place") <= most) & (F.col("n") >= least)).select(key, "place", "token", "n")


def summarize_by_frequency(df: DataFrame, sentences: str, key: str, *, tokens_of_sentence: Column | None = None, n: int = 1, stop_words: DataFrame | None = None, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(key, place, sentence): the n best sentences of each document. A sentence scores the sum of its words' shares of the most frequent word's count, of words whose share lies between low and high; earlier sentences first among equals.

    tokens_of_sentence: the tokens of the column `sentence`; words between blanks by default.
    """
    split = F.split(F.col("sentence"), " ") if tokens_of_sentence is None else tokens_of_sentence
    each = df.select(key, F.posexplode(sentences).alias("at", "sentence"))
    words = each.select(key, "at", F.explode(split).alias("word"))
    counted = words if stop_words is None else words.join(stop_words.select("word"), "word", "left_anti")
    counts = counted.groupBy(key, "word").agg(F.count("*").alias("c"))
    share = (F.col("c") / F.max("c").over(Window.partitionBy(key))).alias("f")
    shares = counts.select(F.col(key).alias("_k"), F.col("word").alias("_w"), share).filter((F.col("f") > low) & (F.col("f") < high))
    scores = words.join(shares, (F.col(key) == F.col("_k")) & (F.col("word") == F.col("_w"))).groupBy(F.col(key).alias("_k"), F.col("at").alias("_a")).agg(F.sum("f").alias("score"))
    scored = each.join(scores, (F.col(key) == F.col("_k")) & (F.col("at") == F.col("_a")), "left")
    order = Window.partitionBy(key).orderBy(F.desc(F.round(F.coalesce("score", F.lit(0.0)), 9)), "at")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(key, "place", "sentence")


# Metrics


def _gram_counts(df: DataFrame, key: str, tokens: str, n: int, name: str) -> DataFrame:
    return df.select(key, F.explode(ngrams(tokens, n)).alias("g")).groupBy(key, F.array_join("g", "\x1f").alias("g")).agg(F.count("*").alias(name))


def rouge_n(df: DataFrame, reference: str, hypothesis: str, key: str, n: int = 1) -> DataFrame:
    """(key, precision, recall, fmeasure) by the n-grams that two token arrays share, as multisets."""
    a, b = _gram_counts(df, key, reference, n, "r"), _gram_counts(df, key, hypothesis, n, "h")
    both = a.join(b, [key, "g"]).groupBy(key).agg(F.sum(F.least("r", "h")).alias("o"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)) - (n - 1), F.lit(0))
    sized = df.select(key, size(reference).alias("r"), size(hypothesis).alias("h")).join(both, key, "left")
    return _scores(sized.withColumn("o", F.coalesce("o", F.lit(0))), key)


def _scores(df: DataFrame, key: str) -> DataFrame:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    df = df.select(key, part("o", "h").alias("precision"), part("o", "r").alias("recall"))
    f = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return df.withColumn("fmeasure", F.when(F.col("precision") + F.col("recall") > 0, f).otherwise(0.0))




def lcs_length(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def longest_common_subsequence(a: str, b: str) -> str:
    """The longest common subsequence of two strings; of several that which keeps to the first string's later characters."""
    letters = np.array([ord(y) for y in b], np.int64)
    rows = np.zeros((len(a) + 1, len(b) + 1), np.uint16 if min(len(a), len(b)) < 1 << 16 else np.int64)
    for k, x in enumerate(a):
        np.maximum.accumulate(np.maximum(rows[k, 1:], rows[k, :-1] + (letters == ord(x)).astype(rows.dtype)), out=rows[k + 1, 1:])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1][j] > rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(above + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def lcs(a: Column | str, b: Column | str) -> Column:
    return arrow(lambda x, y: longest_common_subsequence(x, y) if x is not None and y is not None else None, "string")(a, b)


def word_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edit distance of two token arrays over the reference's length; for an empty reference 0 or infinity."""

    def rate(r: list, h: list) -> float:
        r, h = list(r) if r is not None else [], list(h) if h is not None else []
        return edit_distance(r, h) / len(r) if r else float("inf") if h else 0.0

    return arrow(rate, "double")(reference, hypothesis)


def rouge_l(df: DataFrame, reference: str, hypothesis: str, key: str) -> DataFrame:
    """(key, precision, recall, fmeasure) by the longest common subsequence of two token arrays."""
    return _scores(df.select(key, F.size(reference).alias("r"), F.size(hypothesis).alias("h"), arrow(lambda a, b: lcs_length(list(a), list(b)) if a is not None and b is not None else 0, "int")(reference, hypothesis).alias("o")), key)


def character_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edit distance of two strings over the reference's length; native."""
    r, h = as_column(reference), as_column(hypothesis)
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(float("inf"))).otherwise(F.levenshtein(r, h) / F.length(r))


def bleu(df: DataFrame, references: str, hypothesis: str, key: str, *, most: int = 4, smooth: bool = True) -> DataFrame:
    """One row: bleu (0 to 100), precisions, bp, length_ratio, hyp_length and ref_length of a corpus. references: an array of token arrays; of their lengths the one nearest to the hypothesis' counts, and of their n-gram counts the largest. An order without n-grams makes bleu 0; no hypothesis tokens at all make bp null."""
    hyp = F.size(hypothesis)
    nearest = F.array_min(F.transform(as_column(references), lambda r: F.struct(F.abs(F.size(r) - hyp).alias("d"), F.size(r).alias("n"))))
    first = F.get(F.filter(F.transform(as_column(references), lambda r: F.size(r)), lambda n: F.abs(n - hyp) == nearest["d"]), F.lit(0))
    lengths = df.select(hyp.alias("_h"), first.alias("_r")).agg(F.sum("_h").alias("hyp_length"), F.sum("_r").alias("ref_length"))
    out = lengths
    for n in range(1, most + 1):
        h = _gram_counts(df, key, hypothesis, n, "c")
        each = df.select(key, F.posexplode(references).alias("_ref", "_tokens")).select(key, "_ref", F.explode(ngrams("_tokens", n)).alias("g")).groupBy(key, "_ref", F.array_join("g", "\x1f").alias("g")).agg(F.count("*").alias("c"))
        best = each.groupBy(key, "g").agg(F.max("c").alias("m"))
        clipped = h.join(best, [key, "g"], "left").agg(F.coalesce(F.sum(F.least("c", F.coalesce("m", F.lit(0)))), F.lit(0)).alias("clip"), F.coalesce(F.sum("c"), F.lit(0)).alias("all"))
        p = F.when(F.col("all") == 0, 0.0).when((F.col("clip") == 0) & F.lit(smooth), 1 / (2 * F.col("all"))).otherwise(F.col("clip") / F.col("all"))
        out = out.join(clipped.select(p.alias(f"p{n}")))
    ps = [F.col(f"p{n}") for n in range(1, most + 1)]
    bp = F.when(F.col("hyp_length") == 0, None).when(F.col("hyp_length") < F.col("ref_length"), F.exp(1 - F.col("ref_length") / F.col("hyp_length"))).otherwise(1.0)
    mean = F.exp(sum((F.log(p) for p in ps), F.lit(0.0)) / most)
    score = F.when(F.least(*ps) > 0 if most > 1 else ps[0] > 0, 100 * bp * mean).otherwise(0.0)
    ratio = F.when(F.col("ref_length") > 0, F.col("hyp_length") / F.col("ref_length")).otherwise(0.0)
    return out.select(score.alias("bleu"), F.array(*ps).alias("precisions"), bp.alias("bp"), ratio.alias("length_ratio"), "hyp_length", "ref_length")


# Evaluation of segmentations


def clean_segmentation(x: Column | str, remove_space: bool = True) -> Column:
    """Words joined by |, without spaces, tags, repeated or trailing separators."""
    x = F.regexp_replace(as_column(x), r"\|? ?\|\z", "")
    if remove_space:
        x = F.regexp_replace(x, r"(?U)\s+", "")
    for pattern, to in ((r"\|+", "|"), ("</?[A-Z]+>", ""), (r"\|\z", "")):
        x = F.regexp_replace(x, pattern, to)
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def segmentation_stats(df: DataFrame, expected: str, actual: str, *keys: str) -> DataFrame:
    """(keys, tp, fp, tn, fn, correct, words, expected_words, indicators): per pair of segmentations of a text, characters that begin a word or not, and words found. indicators has a 1 for each word of the second that the first has too; empty words, between separators, aren't words. Keys should be distinct.

    A row per word of either, placed by a running sum of lengths, then grouped by place: time and memory in proportion to the texts, one shuffle by key.
    """
    lengths = lambda c, side: F.transform(F.filter(F.split(c, r"\|"), lambda w: w != ""), lambda w, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), F.length(w).cast("long").alias("len")))
    each = df.select(F.struct(*keys).alias("key"), F.explode_outer(F.concat(lengths(F.col(expected), 0), lengths(F.col(actual), 1))).alias("w")).select("key", "w.*")
    whole = Window.partitionBy("key")
    before = whole.orderBy("side", "pos").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("len"))).over(whole), F.lit(0))
    placed = each.withColumns({"n": of(0), "m": of(1)}).withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)) - F.when(F.col("side") == 1, F.col("n")).otherwise(0))
    end = lambda side: F.max(F.when(F.col("side") == side, F.col("start") + F.col("len")))
    places = placed.groupBy("key", "start", "n", "m").agg(end(0).alias("e"), end(1).alias("a"), F.max(F.when(F.col("side") == 1, F.col("pos"))).alias("pos"))
    is_e, is_a, hit = F.col("e").isNotNull(), F.col("a").isNotNull(), F.coalesce(F.col("e") == F.col("a"), F.lit(False))
    count = lambda c: F.count(F.when(c, 1)).cast("int")
    found = F.array_sort(F.collect_list(F.when(is_a, F.struct("pos", hit.cast("int").cast("string").alias("hit")))))
    out = places.groupBy("key", "n", "m").agg(
        count(is_e & is_a).alias("tp"), count(is_a & ~is_e & (F.col("start") < F.col("n"))).alias("fp"), count(is_e & ~is_a & (F.col("start") < F.col("m"))).alias("fn"), count(hit).alias("correct"), count(is_a).alias("words"), count(is_e).alias("expected_words"),
        F.array_join(F.transform(found, lambda x: x["hit"]), "").alias("indicators"),
    )
    tn = (F.least("n", "m").cast("int") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn")
    return out.select(*(F.col(f"key.{k}").alias(k) for k in keys), "tp", "fp", tn, "fn", "correct", "words", "expected_words", "indicators")


def segmentation_scores(stats: DataFrame) -> DataFrame:
    """One row of precision and recall for characters and words over all pairs."""
    s = lambda c: F.sum(c)
    return stats.agg((s("tp") / (s("tp") + s("fp"))).alias("char_precision"), (s("tp") / (s("tp") + s("fn"))).alias("char_recall"), (s("correct") / s("words")).alias("word_precision"), (s("correct") / s("expected_words")).alias("word_recall"))


# Lookups


def tag_by_lexicon(df: DataFrame, tokens: str, lexicon: DataFrame, *keys: str, default: str = "") -> DataFrame:
    """(keys, pos, token, tag): each token with its tag of lexicon (word, tag), else the default."""
    lex = lexicon.select(F.col("word").alias("token"), "tag").dropDuplicates(["token"])
    return tokens_of(df, tokens, *keys).join(lex, "token", "left").select(*keys, "pos", "token", F.coalesce("tag", F.lit(default)).alias("tag"))


def tag_locations(df: DataFrame, tokens: str, places: DataFrame, *keys: str) -> DataFrame:
    """Tokens that are names of places (word) as B-LOCATION, others as O."""
    return tag_by_lexicon(df, tokens, places.select("word", F.lit("B-LOCATION").alias("tag")), *keys, default="O")


def find_listed(df: DataFrame, tokens: str, listed: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, token) of tokens that a list (word) has: profanity, say."""
    return tokens_of(df, tokens, *keys).join(listed.select(F.col("word").alias("token")).distinct(), "token", "left_semi").select(*keys, "pos", "token")


def contains_listed(tokens: Column | str, listed: list[str]) -> Column:
    return F.arrays_overlap(as_column(tokens), F.array(*(F.lit(w) for w in listed)))


def censor_listed(tokens: Column | str, listed: list[str], by: str = "*") -> Column:
    """The text with each listed token's characters replaced."""
    words = F.array(*(F.lit(w) for w in listed))
    return F.array_join(F.transform(as_column(tokens), lambda t: F.when(F.array_contains(words, t), F.repeat(F.lit(by), F.length(t))).otherwise(t)), "")


def char_analysis(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, name, n): counts of characters by name."""
    each = df.select(*keys, F.explode(F.filter(F.split(text, ""), lambda c: c != "")).alias("c"))
    return each.groupBy(*keys, char_name("c").alias("name")).agg(F.count("*").alias("n"))


def bad_words(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(word, wrong, right): words that a segmentation (key, tokens) finds wrongly more often than rightly, by the spans of another one."""
    from saithong.operators.segment import spans

    rows = lambda d: d.select(key, F.explode(F.arrays_zip(F.col("tokens").alias("t"), spans("tokens").alias("s"))).alias("x")).select(key, F.col("x.t").alias("word"), F.col("x.s").alias("span"))
    known = rows(gold).select(F.col(key).alias("_k"), F.col("span").alias("_sp")).distinct().withColumn("hit", F.lit(1))
    joined = rows(found).join(known, (F.col(key) == F.col("_k")) & (F.col("span") == F.col("_sp")), "left")
    return joined.groupBy("word").agg(F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("wrong"), F.sum(F.coalesce("hit", F.lit(0))).alias("right")).filter("wrong > right")


def revise_words(words: DataFrame, bad: DataFrame) -> DataFrame:
    """words (word) without the bad ones."""
    return words.join(bad.select("word"), "word", "left_anti")


def ngram_probabilities(counts: DataFrame, context_counts: DataFrame | None = None) -> DataFrame:
    """counts (w1[, w2[, w3]], n) with prob: of a word its share of all, of longer runs that of the run without its last word (context_counts)."""
    words = [c for c in counts.columns if c.startswith("w")]
    if len(words) == 1:
        return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select(*words, "n", (F.col("n") / F.col("total")).alias("prob"))
    ctx = words[:-1]
    return counts.join(context_counts.select(*ctx, F.col("n").alias("m")), ctx).select(*words, "n", F.when(F.col("m") == 0, 0.0).otherwise(F.col("n") / F.col("m")).alias("prob"))


# Classification


_MOST_TRAINING = 8_000_000


def gzip_knn(df: DataFrame, text: str, key: str, training: list[tuple[str, str]], k: int = 1) -> DataFrame:
    """(key, label): the label of most of the k training texts nearest by compressed size; the smallest of equal ones. The training texts go to every worker: more than _MOST_TRAINING characters are an error."""
    if sum(len(t) for t, _ in training) > _MOST_TRAINING:
        raise ValueError(f"training texts of more than {_MOST_TRAINING} characters")
    size = lambda s: len(gzip.compress(s.encode(), mtime=0))
    known = df.sparkSession.sparkContext.broadcast([(t, label, size(t)) for t, label in training])

    def nearest(x: str | None) -> str | None:
        if x is None or not known.value:
            return None
        cx = size(x)
        ranked = sorted(range(len(known.value)), key=lambda i: ((size(x + known.value[i][0]) - min(cx, known.value[i][2])) / max(cx, known.value[i][2]), i))
        votes = [known.value[i][1] for i in ranked[:k]]
        return min(set(votes), key=lambda v: (-votes.count(v), v))

    return df.select(key, arrow(nearest, "string")(text).alias("label"))


# Vectors


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of numbers; null if one has no length."""
    a, b = as_column(a), as_column(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def sentence_vectors(df: DataFrame, tokens: str, vectors: DataFrame, key: str, mean: bool = True) -> DataFrame:
    """(key, i, value): the sum of the known tokens' vectors (word, vector), or that over the number of all tokens."""
    each = tokens_of(df, tokens, key).join(vectors.select(F.col("word").alias("token"), "vector"), "token")
    sums = each.select(key, F.posexplode("vector").alias("i", "v")).groupBy(key, "i").agg(F.sum("v").alias("value"))
    if not mean:
        return sums
    return sums.join(df.select(key, F.size(tokens).alias("n")), key).select(key, "i", (F.col("value") / F.col("n")).alias("value"))
