"""A word net as relations: senses (synset, pos, lang, lemma) and hypernyms (child, parent). Lookups are joins; similarities go up the hypernyms level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synsets(words: DataFrame, senses: DataFrame, lang: str | None = None, pos: str | None = None) -> DataFrame:
    """(word, synset, pos) for words (word), of a language and a part of speech if given."""
    found = senses.join(words.select(F.col("word").alias("lemma")).distinct(), "lemma")
    for column, value in (("lang", lang), ("pos", pos)):
        found = found if value is None else found.filter(F.col(column) == value)
    return found.select(F.col("lemma").alias("word"), "synset", "pos").distinct()


def lemmas(names: DataFrame, senses: DataFrame, lang: str) -> DataFrame:
    """(synset, lemma) of the synsets in names (synset) in a language: a translation if words came from another."""
    return senses.filter(F.col("lang") == lang).join(names.select("synset").distinct(), "synset").select("synset", "lemma").distinct()


def all_lemmas(senses: DataFrame, lang: str, pos: str | None = None) -> DataFrame:
    rows = senses.filter(F.col("lang") == lang)
    return (rows if pos is None else rows.filter(F.col("pos") == pos)).select("lemma").distinct()


def languages(senses: DataFrame) -> DataFrame:
    return senses.select("lang").distinct()


def custom_senses(spark, path: str, lang: str) -> DataFrame:
    """Senses of a tab-separated file: synset (with its part of speech behind the last hyphen), a type that ends in lemma, the lemma."""
    rows = spark.read.csv(path, sep="\t", schema="synset string, kind string, lemma string", comment="#", quote="")
    return rows.filter(F.col("kind").endswith("lemma")).select("synset", F.substring_index("synset", "-", -1).alias("pos"), F.lit(lang).alias("lang"), "lemma")


def synonyms(words: DataFrame, senses: DataFrame, lang: str) -> DataFrame:
    """(word, synonym): lemmas that share a synset, the word itself not among them: what an augmenter puts in its place."""
    own = synsets(words, senses, lang)
    return own.join(lemmas(own, senses, lang), "synset").filter(F.col("word") != F.col("lemma")).select("word", F.col("lemma").alias("synonym")).distinct()


def ancestors(nodes: DataFrame, hypernyms: DataFrame, depth: int = 20) -> DataFrame:
    """(node, ancestor, steps) for nodes (node): each itself (0 steps) and what lies above it, by the shortest way, up to `depth` steps. A recursive query, a join a step; it may give any number of rows."""
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # depth bounds it
    start = nodes.select("node").distinct()
    up = hypernyms.select("child", "parent").distinct()
    every = spark.sql(
        """
        WITH RECURSIVE above(node, ancestor, steps) MAX RECURSION LEVEL 1000 AS (
          SELECT node, node, 0 FROM {start}
          UNION ALL
          SELECT a.node, u.parent, a.steps + 1 FROM above a JOIN {up} u ON a.ancestor = u.child WHERE a.steps < {depth})
        SELECT * FROM above""",
        start=start, up=up, depth=depth,
    )
    return every.groupBy("node", "ancestor").agg(F.min("steps").alias("steps"))


def similarities(pairs: DataFrame, hypernyms: DataFrame, depth: int = 20, height: int | None = None) -> DataFrame:
    """pairs (a, b) with steps (the length of the shortest way over a common ancestor; null without one), path (1 / (steps + 1)), lch (-log((steps + 1) / (2 * height)), if height, the taxonomy's, is given) and wup (twice the depth of the deepest common ancestor over the depths of both by way of it; a root has depth 1)."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    above = ancestors(nodes, hypernyms, depth)
    side = lambda x: above.select(F.col("node").alias(x), "ancestor", F.col("steps").alias(f"steps_{x}"))
    met = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", "ancestor"])
    common = met.select(F.col("ancestor").alias("node")).distinct()
    deep = ancestors(common, hypernyms, depth).groupBy(F.col("node").alias("ancestor")).agg((F.max("steps") + 1).alias("depth"))
    best = met.join(deep, "ancestor").withColumn("steps", F.col("steps_a") + F.col("steps_b")).groupBy("a", "b").agg(F.min("steps").alias("steps"), F.max(F.struct("depth", (-F.col("steps")).alias("less"))).alias("top"))
    wup = 2 * F.col("top.depth") / (2 * F.col("top.depth") - F.col("top.less"))
    lch = F.log(F.lit(2.0 * height) / (F.col("steps") + 1)) if height else F.lit(None).cast("double")
    return pairs.join(best, ["a", "b"], "left").select("a", "b", "steps", (1 / (F.col("steps") + 1)).alias("path"), lch.alias("lch"), wup.alias("wup"))


def morphy(words: DataFrame, senses: DataFrame, endings: list[tuple[str, str]], lang: str = "eng") -> DataFrame:
    """(word, base): for each word the lemma that it is, or becomes by replacing an ending, the first of the given ones; null if none."""
    known = all_lemmas(senses, lang).select(F.col("lemma").alias("base"))
    word = F.col("word")
    ways = F.array(F.struct(F.lit(0).alias("order"), word.alias("base")), *(F.struct(F.lit(i).alias("order"), F.when(word.endswith(a) & (F.length(word) > len(a)), F.concat(F.left(word, F.length(word) - len(a)), F.lit(b))).alias("base")) for i, (a, b) in enumerate(endings, 1)))
    tried = words.select("word").distinct().select("word", F.explode(ways).alias("w")).select("word", "w.*").filter(F.col("base").isNotNull())
    found = tried.join(known, "base").groupBy("word").agg(F.min_by("base", "order").alias("base"))
    return words.join(found, "word", "left").select("word", "base")


def height_of(hypernyms: DataFrame, depth: int = 20) -> int:
    """Nodes on the longest way from a root down, at most depth + 1."""
    leaves = hypernyms.select(F.col("child").alias("node")).distinct()
    return int(ancestors(leaves, hypernyms, depth).agg(F.coalesce(F.max("steps"), F.lit(0))).first()[0]) + 1


