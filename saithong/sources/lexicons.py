"""Lexicons and tables from text files: word lists, provinces, frequencies, synonyms. Files are given; none comes with this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def word_list(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(word): the distinct lines of a file, trimmed, without comments (behind #) and empty ones."""
    line = F.regexp_replace("value", "^﻿", "")
    line = F.regexp_replace(line, "#.*$", "") if comments else line
    return spark.read.text(path).select(F.regexp_replace(line, r"(?U)^\s+|\s+$", "").alias("word")).filter("word <> ''").distinct()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of one file in order, as they are."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def provinces(spark: SparkSession, path: str) -> DataFrame:
    """(name_th, abbr_th, name_en, abbr_en) of a CSV without header; malformed rows are dropped."""
    schema = "name_th string, abbr_th string, name_en string, abbr_en string"
    return spark.read.csv(path, schema=schema, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def frequencies(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """(w1[, w2[, w3]], n) of tab-separated runs of words and their counts; malformed rows are dropped."""
    schema = ", ".join([*(f"w{i} string" for i in range(1, n + 1)), "n bigint"])
    return spark.read.csv(path, sep="\t", schema=schema, quote="", mode="DROPMALFORMED")


def meanings(spark: SparkSession, path: str) -> DataFrame:
    """(word, meaning) of a CSV with a header; several meanings of a word are rows."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select("word", "meaning")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos, synonym): a CSV's groups, one row per synonym."""
    rows = spark.read.csv(path, header=True).select("word", "pos", F.explode(F.split("synonym", r"\|")).alias("synonym"))
    return rows.filter("synonym <> ''")


def find_synonyms(table: DataFrame, words: DataFrame) -> DataFrame:
    """(word, synonym) for words (word): all that share a group with it, either way; itself not among them."""
    both = table.select("word", "synonym").union(table.select(F.col("synonym").alias("word"), F.col("word").alias("synonym")))
    group = table.select(F.col("word").alias("head"), F.col("synonym").alias("word")).join(table.select(F.col("word").alias("head"), "synonym"), "head").select("word", "synonym")
    return words.join(both.union(group), "word").filter("word <> synonym").distinct()


def transliterations(spark: SparkSession, path: str) -> DataFrame:
    """(word, readings): of tab-separated words, readings and flags, an array of (reading, standard)."""
    rows = spark.read.csv(path, sep="\t", schema="word string, reading string, standard string", mode="PERMISSIVE")
    return rows.groupBy("word").agg(F.collect_list(F.struct("reading", F.try_element_at(F.create_map(F.lit("TRUE"), F.lit(True), F.lit("FALSE"), F.lit(False)), F.upper("standard")).alias("standard"))).alias("readings"))
