"""Parts of speech around a tagger: names for signs, tag sets mapped to universal ones, tags by lookup."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saithong.functions.text import as_column
from saithong.operators.lexical import PerceptronTagger, perceptron_tags

# Names of signs in the corpora, and universal tags for theirs.
SIGN_NAMES = {
    "orchid": {
        " ": "<space>", "+": "<plus>", "-": "<minus>", "=": "<equal>", ",": "<comma>", "$": "<dollar>", ".": "<full_stop>", "(": "<left_parenthesis>", ")": "<right_parenthesis>", '"': "<quotation>", "@": "<at_mark>", "&": "<ampersand>",
        "{": "<left_curly_bracket>", "^": "<circumflex_accent>", "?": "<question_mark>", "<": "<less_than>", ">": "<greater_than>", "!": "<exclamation>", "’": "<apostrophe>", ":": "<colon>", "*": "<asterisk>", ";": "<semi_colon>", "/": "<slash>",
    },
    "blackboard": {" ": "_"},
}
UNIVERSAL = {
    "orchid": {
        "NOUN": ["NOUN", "NCMN", "NTTL", "CNIT", "CLTV", "CMTR", "CFQC", "CVBL"], "VERB": ["VACT", "VSTA"], "PROPN": ["PROPN", "NPRP"], "ADJ": ["ADJ", "NONM", "VATT", "DONM"], "ADV": ["ADV", "ADVN", "ADVI", "ADVP", "ADVS"], "INTJ": ["INT"],
        "PRON": ["PRON", "PPRS", "PDMN", "PNTR"], "DET": ["DET", "DDAN", "DDAC", "DDBQ", "DDAQ", "DIAC", "DIBQ", "DIAQ"], "NUM": ["NUM", "NCNM", "NLBL", "DCNM"], "AUX": ["AUX", "XVBM", "XVAM", "XVMM", "XVBB", "XVAE"], "ADP": ["ADP", "RPRE"],
        "CCONJ": ["CCONJ", "JCRG"], "SCONJ": ["SCONJ", "PREL", "JSBR", "JCMP"], "PART": ["PART", "FIXN", "FIXV", "EAFF", "EITT", "AITT", "NEG"], "PUNCT": ["PUNCT", "PUNC"],
    },
    "blackboard": {"ADJ": ["AJ"], "ADV": ["AV"], "AUX": ["AX"], "CCONJ": ["CC"], "NOUN": ["CL", "FX", "NN"], "INTJ": ["IJ"], "PART": ["NG", "PA"], "NUM": ["NU"], "PROPN": ["PR"], "ADP": ["PS"], "PUNCT": ["PU"], "VERB": ["VV"], "X": ["XX"]},
}
#: Words that are nouns in universal tags whatever the tagger says (prefixes that make nouns).
ALWAYS_NOUNS = {"orchid": ["การ", "ความ"], "blackboard": []}
#: Parts of speech of a word net for universal ones; others have none.
WORDNET_POS = {"NOUN": "n", "VERB": "v", "PROPN": "n", "ADJ": "a", "ADV": "r"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(v) for kv in pairs.items() for v in kv))


def name_signs(tokens: Column | str, corpus: str = "orchid") -> Column:
    """Tokens with the signs that a corpus names by their names; native."""
    names = _map(SIGN_NAMES[corpus])
    return F.transform(as_column(tokens), lambda t: F.coalesce(F.try_element_at(names, t), t))


def universal_tag(word: Column, tag: Column, corpus: str = "orchid") -> Column:
    """The universal tag for a corpus' tag of a word; no tag stays none, an unknown one is null. Native."""
    known = _map({"": ""} | {t: u for u, tags in UNIVERSAL[corpus].items() for t in tags})
    return F.when(word.isin(ALWAYS_NOUNS[corpus]), "NOUN").otherwise(F.try_element_at(known, tag)) if ALWAYS_NOUNS[corpus] else F.try_element_at(known, tag)


def restore_signs(tagged: Column | str, corpus: str = "orchid", *, universal: bool = False) -> Column:
    """An array of (word, tag) with signs for their names, and universal tags if wanted; native."""
    signs = _map({v: k for k, v in SIGN_NAMES[corpus].items()})
    tag = (lambda x: universal_tag(x["word"], x["tag"], corpus)) if universal else (lambda x: x["tag"])
    return F.transform(as_column(tagged), lambda x: F.struct(F.coalesce(F.try_element_at(signs, x["word"]), x["word"]).alias("word"), tag(x).alias("tag")))


def pos_tag(df: DataFrame, tokens: str, *keys: str, tagger: PerceptronTagger | None = None, lexicon: DataFrame | None = None, corpus: str | None = None, universal: bool = False) -> DataFrame:
    """(keys, tagged): each row's tokens with tags, by a trained tagger or a table (word, tag) of any size; corpus: whose names of signs the tagger knows. Tokens that the table lacks have an empty tag."""
    if (tagger is None) == (lexicon is None):
        raise ValueError("give a tagger or a lexicon")
    named = name_signs(tokens, corpus) if corpus else F.col(tokens)
    rows = df.select(*keys, named.alias("tokens"))
    if tagger is not None:
        out = rows.select(*keys, perceptron_tags("tokens", tagger, df).alias("tagged"))
    else:
        id_ = F.monotonically_increasing_id()
        rows = rows.withColumn("row_of_tokens", F.struct(*keys) if keys else id_)
        each = rows.select("row_of_tokens", F.posexplode_outer("tokens").alias("pos", "word"))
        tags = lexicon.select(F.col("word").alias("known"), "tag").dropDuplicates(["known"])
        each = each.join(tags, F.col("word") == F.col("known"), "left").select("row_of_tokens", "pos", "word", F.coalesce("tag", F.lit("")).alias("tag"))
        gathered = each.groupBy("row_of_tokens").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "word", "tag")))).alias("x"))
        out = gathered.select(*(F.col(f"row_of_tokens.{k}").alias(k) for k in keys), F.transform("x", lambda x: F.struct(x["word"].alias("word"), x["tag"].alias("tag"))).alias("tagged"))
    return out.withColumn("tagged", restore_signs("tagged", corpus, universal=universal)) if corpus else out


def wordnet_pos(tag: Column | str, corpus: str = "orchid") -> Column:
    """The word net's part of speech for a corpus' tag; empty for tags without one, null for unknown ones. Native."""
    known = {"": ""} | {t: WORDNET_POS.get(u, "") for u, tags in UNIVERSAL[corpus].items() for t in tags}
    return F.try_element_at(_map(known), as_column(tag))


def read_lexicon(path: str) -> dict[str, str]:
    """{word: tag} of a small file with a word, a comma or tab, and a tag a line; the first of several counts."""
    out: dict[str, str] = {}
    for line in Path(path).read_text("utf-8-sig").splitlines():
        word, _, tag = line.replace("\t", ",").rpartition(",")
        if word:
            out.setdefault(word, tag)
    return out


def look_up(words: Iterable[str], lexicon: dict[str, str]) -> list[tuple[str, str]]:
    return [(w, lexicon.get(w, "")) for w in words]
