"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.llm.mixing import mix

    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.llm.common import hashed_mod
    from saithong.llm.langid import identify

    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = hashed_mod(F.col("doc_id"), 4) == 2
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), docs.filter(~held_out), keep=("held_out",))


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.llm.common import hashed_mod
    from saithong.llm.suffix_tree import corpus_scores

    docs, held_out = _docs(spark, sf_dir), hashed_mod(F.col("doc_id"), 10) == 0
    return corpus_scores(docs, ~held_out, extra={"held_out": held_out})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.llm.quality import quality

    return quality(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from saithong.llm.repair import encode_documents

    return encode_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.llm.decontam import decontaminate

    found = decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.llm.hyperminhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), shingle=2, percent=80)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.llm.linededup import line_summary

    return line_summary(_docs(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from saithong.llm.pii import personal_data

    return personal_data(_docs(spark, sf_dir)).drop("found")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from saithong.llm.token_count import token_counts

    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_suffix_tree_scores, op4_quality_rules, op5_repair_token_ids, op6_decontamination, op7_near_duplicates, op8_line_dedup, op9_personal_data, op10_token_counts)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MIX = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, sum(size) AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
-- Clamp what is above its cap, deal the rest again by weight, until none is above.
f(round, source, size, w, capped, share) AS (
  SELECT 0, source, size, w, false, CAST(0 AS DOUBLE) FROM s
  UNION ALL
  SELECT round + 1, source, size, w, capped OR over, CASE WHEN capped OR over THEN 3.0 * size ELSE share END
  FROM (SELECT *, NOT capped AND level > 3 * size AS over FROM (
    SELECT round, source, size, w, capped, share, CAST(sum(size) OVER () - sum(CASE WHEN capped THEN 3 * size ELSE 0 END) OVER () AS DOUBLE) * w / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) AS level FROM f))
  WHERE round < 60),
l AS (SELECT source, size, w, capped, CAST(sum(size) OVER () - sum(CASE WHEN capped THEN 3 * size ELSE 0 END) OVER () AS DOUBLE) * w / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) AS level FROM f WHERE round = 60),
t AS (SELECT source, size AS source_size, CASE WHEN capped THEN CAST(3 * size AS DOUBLE) ELSE level END AS target FROM l),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base, CAST(floor(target) AS BIGINT) AS whole FROM t),
r AS (SELECT d.*, p.source_size, p.target, p.base, p.whole - p.base * p.source_size AS rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(base * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r"""

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM m, (SELECT unnest([0, 1, 2, 3, 4]) AS k)) GROUP BY doc_id),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_latin, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_letters < word_chars OR 2 * n_capitals > n_latin) AS kept FROM b"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (SELECT item_id, w[i : i + 12] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0))),
k AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k)),
m AS (SELECT g.doc_id, g.i, g.n, q.item_id FROM g JOIN q ON g.n = q.n AND g.x = q.x),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

#: SQL of the queries that SQL can express; the others are tested against brute force, an exact round trip or held-out accuracy.
ORACLE = {"op1_mix_sources": _MIX, "op4_quality_rules": _QUALITY, "op6_decontamination": _CONTAMINATION, "op7_near_duplicates": _NEAR}
