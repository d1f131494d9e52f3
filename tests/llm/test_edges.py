"""Queries and pipeline on tables without rows, with null ids and with repeated rows."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, path, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def names():
    from saithong.llm.queries import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def hollow(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("hollow"), [], [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    long = " ".join(f"word{i % 97}" for i in range(400))
    rows = [(None, long, "en", None, 0), (None, None, None, None, None), (1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, "", "de", "s", 0), (3, long.upper(), None, "t", 1), (4, "x", "en", "", 1), (-5, long + " more", "en", "s", 1)]
    return tables(spark, tmp_path_factory.mktemp("odd"), rows, [(None, "word1 word2"), (7, None), (7, "")])


@pytest.mark.parametrize("name", names())
def test_no_rows(spark, hollow, name):
    from saithong.llm.queries import QUERIES

    assert QUERIES[name](spark, hollow).collect() == []


@pytest.mark.parametrize("name", names())
def test_odd_rows(spark, odd, name):
    from saithong.llm.queries import QUERIES

    rows = QUERIES[name](spark, odd).collect()
    if name == "op8_line_dedup":  # a row per id
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [-5, 1, 2, 3, 4] and len(rows) == 6
    else:
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [-5, 1, 1, 2, 3, 4] and len(rows) == 8


def test_near_duplicates_of_odd_rows(spark, odd):
    from saithong.llm.queries import QUERIES

    got = {r.doc_id: (r.component_id, r.kept) for r in QUERIES["op7_near_duplicates"](spark, odd).collect()}
    assert got[1] == (-5, False) and got[3] == (-5, False) and got[-5] == (-5, True) and got[2] == (2, True) and got[None] == (None, True)


def test_pipeline_of_odd_rows(spark, hollow, odd):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, hollow).collect() == []
    corpus_pipeline.run(spark, odd).collect()
    docs = spark.read.parquet(f"{odd}/documents.parquet").filter("doc_id = 1 or doc_id = 3")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, odd).collect()] == [1]
