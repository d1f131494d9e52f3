"""Spans, tags and vectors as relations: interval joins, anti-joins, islands, neighbouring rows, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saithong.functions.text import as_column


_BUCKET = 256  # characters


def spans_to_sentences(sentences: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, pos, start, end, word): each span (start, end inclusive, over the joined sentences) cut out of the sentence (key, pos, text) that holds it. An interval join by key and stretches of text: a span meets only sentences that reach into its start's stretch."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = sentences.select(key, "pos", "text", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("from")).withColumn("to", F.col("from") + F.length("text")).filter("to > `from`")
    stretch = lambda c: F.floor(c / _BUCKET)
    placed = placed.withColumn("stretch", F.explode(F.sequence(stretch(F.col("from")), stretch(F.col("to") - 1))))
    held = placed.join(spans.select(key, "start", "end", stretch(F.col("start")).alias("stretch")), [key, "stretch"]).filter((F.col("start") >= F.col("from")) & (F.col("end") < F.col("to")))
    return held.select(key, "pos", "start", "end", F.substring("text", F.col("start") - F.col("from") + 1, F.col("end") - F.col("start") + 1).alias("word"))


def top_level_entities(entities: DataFrame, key: str) -> DataFrame:
    """Entities (key, start, end, ...) that lie in no longer one of the same key."""
    outer = entities.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")) & ((F.col("start") > F.col("_s")) | (F.col("end") < F.col("_e")))
    return entities.join(outer, inside, "left_anti")


def iob_entities(tokens: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """(key, first, last, kind, text): runs of B- and I- tags of tokens (key, pos, token, tag). A run begins at a B-, or at an I- behind another kind. keep: kinds; others stay apart."""
    w = Window.partitionBy(key).orderBy("pos")
    kind = F.regexp_extract("tag", "^[BI]-(.*)$", 1)
    rows = tokens.withColumn("kind", kind).withColumn("begins", (F.col("kind") == "") | F.col("tag").startswith("B-") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind")))
    if keep is not None:
        rows = rows.withColumn("kind", F.when(F.col("kind").isin(keep), F.col("kind")).otherwise("")).withColumn("begins", F.col("begins") | (F.col("kind") == ""))
    rows = rows.withColumn("island", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(key, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("text"))
    return runs.select(key, "first", "last", "kind", "text")


def merge_entities(tokens: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """(key, pos, token): the tokens with each entity as one."""
    runs = iob_entities(tokens, key, keep)
    return runs.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).alias("pos"), F.col("text").alias("token"))


def inline_tags(tokens: DataFrame, key: str) -> DataFrame:
    """(key, text): entities between <KIND> and </KIND>."""
    runs = iob_entities(tokens, key)
    said = F.when(F.col("kind") == "", F.col("text")).otherwise(F.concat(F.lit("<"), "kind", F.lit(">"), "text", F.lit("</"), "kind", F.lit(">")))
    return runs.withColumn("said", said).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "said"))), lambda x: x["said"]), "").alias("text"))


def neighbour_features(tokens: DataFrame, key: str, columns: list[str], reach: int = 1) -> DataFrame:
    """tokens (key, pos, ...) with the given columns of the tokens up to `reach` places before and behind, as {column}_{offset}; null beyond the ends."""
    w = Window.partitionBy(key).orderBy("pos")
    return tokens.withColumns({f"{c}_{'m' if k < 0 else 'p'}{abs(k)}": F.lag(c, -k).over(w) for c in columns for k in range(-reach, reach + 1) if k})


def token_shape(token: Column | str) -> Column:
    """A struct of what taggers ask of a token: thai, digits, space, punctuation, first and last three characters, length."""
    t = as_column(token)
    return F.struct(t.rlike("^[฀-๿]+$").alias("thai"), t.rlike("^[0-9๐-๙]+$").alias("digits"), t.rlike(r"^\s+$").alias("space"), t.rlike(r"^\p{Punct}+$").alias("punctuation"), F.left(t, F.lit(3)).alias("prefix"), F.right(t, F.lit(3)).alias("suffix"), F.length(t).alias("length"))


def romanize_by_lookup(df: DataFrame, text: str, readings: DataFrame, key: str) -> DataFrame:
    """(key, pos, word, romanized): words between blanks by a table (word, reading), null for those that it lacks (give them to another engine)."""
    words = df.select(key, F.posexplode(F.split(text, " ")).alias("pos", "word"))
    table = readings.select("word", F.col("reading").alias("romanized")).dropDuplicates(["word"])
    return words.join(table, "word", "left").select(key, "pos", "word", "romanized")


def combinations(candidates: Column | str) -> Column:
    """All ways to pick one of each array's entries, in order: of an array of arrays."""
    start = F.array(F.array().cast("array<string>"))
    return F.aggregate(as_column(candidates), start, lambda out, c: F.flatten(F.transform(out, lambda o: F.transform(c, lambda x: F.concat(o, F.array(x))))))


def _unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def odd_one_out(words: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, word): of each key's words (key, word) the one farthest from the mean direction of all; ties by word. Words without a vector don't count."""
    known = words.join(vectors.select("word", _unit(F.col("vector")).alias("u")), "word")
    mean = known.select(key, F.posexplode("u").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))
    dot = F.aggregate(F.zip_with("u", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return known.join(mean, key).withColumn("d", dot).groupBy(key).agg(F.min_by("word", F.struct("d", "word")).alias("word"))


def most_similar(positive: list[str], negative: list[str], vectors: DataFrame, n: int = 10) -> DataFrame:
    """(word, score): the n words with the best product of similarities to the positive words over that to the negative ones (each shifted to 0..1). The few given words' vectors (of several the smallest) are literals of the plan; all others are scanned."""
    few = vectors.filter(F.col("word").isin([*positive, *negative])).groupBy("word").agg(_unit(F.min("vector")).alias("u"))  # a row a given word
    given = {r.word: r.u for r in few.collect()}
    for w in [*positive, *negative]:
        if w not in given:
            raise KeyError(w)
    u = _unit(F.col("vector"))
    like = lambda w: (1 + F.aggregate(F.zip_with(u, F.array(*(F.lit(float(x)) for x in given[w])), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)) / 2
    score = F.lit(1.0)
    for w in positive:
        score = score * like(w)
    for w in negative:
        score = score / (like(w) + 1e-6)
    return vectors.filter(~F.col("word").isin([*positive, *negative])).select("word", score.alias("score")).orderBy(F.desc("score"), "word").limit(n)
