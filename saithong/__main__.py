"""python -m saithong COMMAND: tokenize, soundex, misspell, tag, data, evaluate."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="saithong", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    t = commands.add_parser("tokenize", help="cut a text into words, subwords or sentences")
    t.add_argument("unit", choices=["word", "subword", "syllable", "sentence"])
    t.add_argument("text")
    t.add_argument("--dictionary", help="a file with a word a line")
    t.add_argument("--engine", default="newmm")
    t.add_argument("--separator", default="|")
    t.add_argument("--drop-whitespace", action="store_true")
    s = commands.add_parser("soundex", help="the phonetic code of a word")
    s.add_argument("text")
    s.add_argument("--engine", default="lk82", choices=["lk82", "udom83", "metasound", "prayut_and_somchaip", "complete_soundex"])
    m = commands.add_parser("misspell", help="replace a share of a text's characters by keys nearby")
    m.add_argument("text")
    m.add_argument("--ratio", type=float, default=0.05)
    m.add_argument("--seed", type=int, default=0)
    g = commands.add_parser("tag", help="parts of speech of a text's words (joined by --separator), by a file of word, tag a line")
    g.add_argument("text")
    g.add_argument("--lexicon", required=True)
    g.add_argument("--separator", default="|")
    d = commands.add_parser("data", help="a folder of word lists: what it has, where a list is, or its words")
    d.add_argument("what", choices=["catalog", "path", "info", "get", "rm"])
    d.add_argument("name", nargs="?", default="")
    d.add_argument("--folder")
    e = commands.add_parser("evaluate", help="precision and recall of a segmentation (words joined by |) against another, line by line")
    e.add_argument("expected")
    e.add_argument("actual")
    a = parser.parse_args(argv)

    from saithong.operators import lexical, segment

    if a.command == "misspell":
        print(lexical.misspell(a.text, a.seed, a.ratio))
        return 0
    if a.command == "data":
        from saithong.sources.catalog import Catalog

        known = Catalog(a.folder)
        if a.what != "catalog" and a.name not in known:
            print(f"no list {a.name} in {known.folder}", file=sys.stderr)
            return 1
        said = {"catalog": lambda: "\n".join(sorted(known)), "path": lambda: str(known.path(a.name)), "info": lambda: str(known.detail(a.name)), "get": lambda: "\n".join(known.lines(a.name)), "rm": lambda: f"removed: {known.remove(a.name)}"}
        print(said[a.what]())
        return 0
    if a.command == "tokenize":
        words = segment.Dictionary(Path(a.dictionary).read_text("utf-8-sig").splitlines() if a.dictionary else ())
        if a.unit in ("word", "syllable"):  # a dictionary of words, or of syllables
            out = segment.tokenize(a.text, words, a.engine, not a.drop_whitespace)
        else:
            out = segment.tcc(a.text) if a.unit == "subword" else a.text.split()
        print(a.separator.join(out))
        return 0
    if a.command == "tag":
        from saithong.operators import tagging

        print(" ".join(f"{w}/{t}" for w, t in tagging.look_up(a.text.split(a.separator), tagging.read_lexicon(a.lexicon))))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from saithong.operators import corpus
    from saithong.sources import lexicons

    spark = SparkSession.builder.getOrCreate()
    if a.command == "soundex":
        print(spark.range(1).select(lexical.soundex(F.lit(a.text), a.engine)).first()[0])
        return 0
    x, y = (lexicons.lines(spark, p).select("line_no", corpus.clean_segmentation("value").alias(n)) for p, n in ((a.expected, "e"), (a.actual, "a")))
    if x.count() != y.count():
        print("the files have different numbers of lines", file=sys.stderr)
        return 1
    pairs = x.join(y, "line_no").filter((F.col("e") != "") & (F.col("a") != ""))
    print(corpus.segmentation_scores(corpus.segmentation_stats(pairs, "e", "a", "line_no")).toJSON().first())
    return 0


if __name__ == "__main__":
    sys.exit(main())
