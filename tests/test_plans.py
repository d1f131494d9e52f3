"""What plans look like: columns pruned, filters pushed down, no Python where native expressions do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from saithong.functions import dates as D
from saithong.functions import numbers as N
from saithong.functions import text as T
from saithong.operators import corpus as R
from saithong.operators import lexical as L
from saithong.operators import segment as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = {
    "normalize": lambda: T.normalize("text"), "count_thai": lambda: T.count_thai("text"), "cells": lambda: T.display_cells("text"), "key": lambda: T.collation_key("text"), "rep": lambda: T.replace_rep_after("text"), "brackets": lambda: T.rm_brackets("text"),
    "foreign": lambda: S.foreign_tokenize("text"), "sentences": lambda: S.sentences("text"), "udom83": lambda: L.udom83("text"), "metasound": lambda: L.metasound("text"), "words": lambda: N.num_to_thaiword("doc_id"), "baht": lambda: N.bahttext("doc_id"),
    "float": lambda: N.num_to_thaiword_float("doc_id"), "date": lambda: D.thai_strftime(F.lit("2020-01-02").cast("timestamp"), "%c"), "time": lambda: D.time_to_thaiword("text"), "morse": lambda: T.morse_encode("text", "en"), "cer": lambda: R.character_error_rate("text", "lang"),
}


@pytest.mark.parametrize("name", list(NATIVE))
def test_native_functions_run_no_python(spark, name):
    p = plan(spark.read.parquet(f"{SF}/documents.parquet").select(NATIVE[name]().alias("x")))
    assert "Python" not in p and "Arrow" not in p and "Pandas" not in p
    assert "ReadSchema: struct<doc_id" not in p.replace("struct<doc_id:bigint>", "") or name in ("words", "baht", "float")


def test_filters_and_columns_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").withColumn("tokens", S.foreign_tokenize("text", keep_whitespace=False))
    p = plan(R.rank(docs, "tokens", "source"))
    assert "EqualTo(lang,en)" in p and "n_chars" not in p


def test_counts_are_combined_before_the_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("tokens", S.foreign_tokenize("text"))
    assert "partial_count" in plan(R.rank(docs, "tokens"))


def test_python_sees_only_its_columns(spark):
    d = S.broadcast_words(spark, ["คน"])
    p = plan(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", S.word_tokenize("text", d).alias("t")))
    assert p.count("ArrowEvalPython") == 1 and "lang" not in p


def test_metrics_score_every_turn_whole(spark, tmp_path):
    from saithong.plans import registry

    said = {(1, 0): "a b c d e f g h", (1, 1): "x f g h", (1, 2): "x f g", (2, 4): "one two three four five six", (2, 5): "six", (3, 1): "alone", (4, 0): "", (4, 1): "ab ba"}
    spark.createDataFrame([(*k, "user", t) for k, t in said.items()], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = {k: (t, said[k[0], k[1] + 1]) for k, t in said.items() if (k[0], k[1] + 1) in said}
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()

    def brute(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for j, y in enumerate(b):
                rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][-1]))
        return rows[-1][-1]

    assert {(r.conv_id, r.turn): len(r.lcs) for r in run("longest_common_subsequence")} == {k: brute(*p) for k, p in pairs.items()}
    words = {k: (a.split(" "), b.split(" ")) for k, (a, b) in pairs.items()}
    assert {(r.conv_id, r.turn): r.recall for r in run("rouge_l")} == {k: pytest.approx(brute(a, b) / len(a), abs=1e-8) for k, (a, b) in words.items()}
    assert {(r.conv_id, r.turn): r.wer for r in run("word_error_rate")} == {(1, 0): 5 / 8, (1, 1): 1 / 4, (2, 4): round(5 / 6, 9), (4, 0): 2.0}


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"], capture_output=True, text=True, cwd=Path(__file__).parent.parent, timeout=120)
    assert said.returncode == 0, said.stderr
    assert min(map(int, said.stdout.split())) > 90
