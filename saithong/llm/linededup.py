"""Near-equal lines across documents: a segment-partition edit join.

A line of length n is cut into edits + 1 segments; of two lines within so many edits, one shares a segment with the other at a place that its number and both lengths bound. Segments are indexed and probed by hashes, pairs are verified by a banded bit-parallel edit distance, and linked lines make classes. Native: DataFrame expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saithong.llm.common import cut, drop, let, unused
from saithong.llm.components import components

EDITS = 2
PER_EDIT = 8  # characters that the shorter of two lines has for each edit, at least: lines below that only equal themselves
_WORD = 60  # bits of a column of the edit matrix
_LOOK = 24  # characters behind the common prefix that are looked at first
_BLOCK = 512  # indexed lines of a key that meet in one task
_BROADCAST_IDS = 200_000


def segment(n: Column, i: int, edits: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment i (from 0) of a line of length n: edits + 1 segments, the last ones longer by one if n isn't a multiple."""
    parts = edits + 1
    q, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    return (i * q + F.greatest(F.lit(0), longer - (parts - i)) + 1).cast("int"), (q + (F.lit(parts - i) <= longer).cast("int")).cast("int")


def keys_of(line: Column, n: Column, edits: int) -> tuple[Column, Column]:
    """(keys under which a line is indexed, further keys that it probes). A probe looks for a line no longer than this one; segment i (from 0) of one that is shorter by d starts at most i places from its own start, and at most edits - i from there moved by d."""
    own, probes = [], []
    for d in range(edits + 1):
        for i in range(edits + 1):
            start, length = segment(n - d, i, edits)
            for shift in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1):
                key = F.xxhash64(n - d, F.lit(i), F.substring(line, start + shift, length))
                (own if d == 0 and shift == 0 else probes).append(key)
    return F.array(*own), F.array(*probes)


def _common_prefix(a: Column, b: Column, most: Column) -> Column:
    """Length of the longest common prefix of two strings, at most `most` (below 2**24): a binary search by comparing pieces."""
    at = F.lit(0)
    for bit in (1 << k for k in range(23, -1, -1)):
        at = let(at, lambda lo, bit=bit: F.when((lo + bit <= most) & (F.substring(a, lo + 1, F.lit(bit)) == F.substring(b, lo + 1, F.lit(bit))), lo + bit).otherwise(lo))
    return at


def _distance(long: Column, short: Column, steps: Column, edits: int, *, whole: bool) -> Column:
    """The edit distance of two arrays of characters if it is at most `edits`, else a larger number; without whole, only the value on the matrix's diagonal after so many steps, which it can't undercut by more than 2 * edits.

    Bit-parallel, in a band of 2 * edits + 1 diagonals that one word holds: vertical differences of a column of the matrix are two bit vectors, and a step along the shorter string is a dozen word operations.
    """
    every, top = (1 << _WORD) - 1, _WORD - 1
    bits = lambda x: F.lit(x).cast("bigint")
    flip = lambda x: x.bitwiseXOR(bits(every))
    n = F.size(long)

    def step(s: Column, i: Column) -> Column:
        same = None
        for d in range(2 * edits + 1):  # bit top - d stands for place i + edits - d of the longer string
            at = i + edits - d
            bit = F.when((at >= 0) & (F.get(long, F.greatest(at, F.lit(0))) == F.get(short, i)), bits(1 << (top - d))).otherwise(bits(0))
            same = bit if same is None else same.bitwiseOR(bit)

        def column(d0: Column) -> Column:
            hp = s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"])))
            hn = d0.bitwiseAND(s["vp"])
            low = F.shiftright(d0, 1)
            along = F.when(d0.bitwiseAND(bits(1 << top)) == 0, 1).otherwise(0)
            row = lambda v: (v.bitwiseAND(s["mask"]) != 0).cast("int")  # noqa: E731  on the last row
            on_diagonal = (i < n - edits) if whole else F.lit(True)
            return F.struct(
                hn.bitwiseOR(flip(low.bitwiseOR(hp))).alias("vp"), low.bitwiseAND(hp).alias("vn"),
                (s["dist"] + F.when(on_diagonal, along).otherwise(row(hp) - row(hn))).alias("dist"),
                F.when(on_diagonal, s["mask"]).otherwise(F.shiftright(s["mask"], 1)).alias("mask"),
            )

        d0 = let(same, lambda x: (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseAND(bits(every)).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]))
        return F.when(s["dist"] > 3 * edits + 1, s).otherwise(let(d0, column))  # it falls on the last row alone, by at most 2 * edits

    start = F.struct(bits(every ^ ((1 << (_WORD - edits - 1)) - 1)).alias("vp"), bits(0).alias("vn"), F.lit(edits).alias("dist"), bits(1 << (top - 1)).alias("mask"))
    return F.aggregate(F.sequence(F.lit(0), steps - 1), start, step, lambda s: s["dist"])


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most `edits`, by a banded bit-parallel computation behind their common prefix. Pairs that differ more are mostly told by the next few characters."""
    chars = lambda x: F.split(x, "")

    def rest(long: Column, short: Column) -> Column:
        full = let(chars(long), lambda x: let(chars(short), lambda y: _distance(x, y, F.size(y), edits, whole=True))) <= edits
        head = let(chars(F.left(long, F.lit(_LOOK + 2 * edits))), lambda x: let(chars(F.left(short, F.lit(_LOOK + 2 * edits))), lambda y: _distance(x, y, F.lit(_LOOK), edits, whole=False)))
        likely = F.when(F.length(short) <= _LOOK + 2 * edits, True).otherwise(head <= 3 * edits)
        return F.when(F.length(short) == 0, F.length(long) <= edits).when(~likely, False).otherwise(full)

    def behind(long: Column, short: Column) -> Column:
        tail = lambda x, p: F.substring(x, p + 1, F.length(x))
        return F.when(F.length(long) - F.length(short) > edits, False).otherwise(let(_common_prefix(long, short, F.length(short)), lambda p: let(tail(long, p), lambda x: let(tail(short, p), lambda y: rest(x, y)))))

    longer = F.length(a) >= F.length(b)
    return let(F.when(longer, a).otherwise(b), lambda x: let(F.when(longer, b).otherwise(a), lambda y: behind(x, y)))


def marks(line: Column) -> Column:
    """256 bits, four numbers, of which those are set that hashes of a line's pairs of neighbouring characters name. An edit removes at most two pairs and adds two, so it changes at most four bits."""
    chars = F.split(line, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, F.length(line)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(256)).cast("int"))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    word = lambda codes, i: F.aggregate(F.filter(codes, lambda c: F.floor(c / 64) == i), F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(one((c % 64).cast("int"))))
    return let(F.array_distinct(pairs), lambda codes: F.struct(*(word(codes, i).alias(f"m{i}") for i in range(4))))


def _different_marks(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.m{i}").bitwiseXOR(F.col(f"{b}.m{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}.m0").bitwiseXOR(F.col(f"{b}.m0"))))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, line): lines with a character other than white space; a document without any has one row with a null line."""
    full = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda s: F.btrim(s["line"], F.lit(" \t\n\x0b\x0c\r")) != "")
    return docs.select(F.col(id_col).alias("doc"), F.explode_outer(full).alias("l")).select("doc", "l.pos", "l.line")


def line_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """Per line with a word (and per document without such lines, with nulls): doc, pos (its place among all lines of the text), line_id, class_id, links and status.

    Equal lines are one; two different ones are linked if at most `edits` insertions, deletions and substitutions of characters turn one into the other, and no more than one for each per_edit characters of the shorter one (short lines with as many edits are mostly other words); links make classes. status is first (of its class, in order of document and place), equal (to an earlier line) or near (no equal line is earlier, but one of its class is). links counts the different lines linked to this one. Blank lines aren't lines here; null texts have none. Repeated rows repeat their lines. Lines are told apart by 64-bit hashes.
    """
    lines = _lines(docs, id_col, text_col).withColumns({"id": F.when(F.col("line").isNotNull(), F.xxhash64("line")), "n": F.length("line")})
    places = cut(lines.select("doc", "pos", "id"), "lines")
    own, probes = keys_of(F.col("line"), F.col("n"), edits)
    long = lines.filter(F.col("n") >= max(per_edit, edits + 1)).select("id", own.alias("own"), probes.alias("probes"))
    distinct = cut(long.dropDuplicates(["id"]), "segments")
    indexed = distinct.select(F.col("id").alias("a"), F.explode("own").alias("key"))
    probing = distinct.select(F.col("id").alias("b"), F.explode(F.array_distinct(F.concat("own", "probes"))).alias("k"))
    # Keys under which different lines meet. A line meets others under few keys, so only those keys' rows get texts.
    met = probing.join(indexed, (F.col("key") == F.col("k")) & (F.col("a") != F.col("b")), "left_semi")
    met = cut(met.groupBy("k").agg(F.count("*").alias("n")).select(F.col("k").alias("m"), F.ceil(F.col("n") / _BLOCK).cast("int").alias("parts")), "met")
    small = lambda df: F.broadcast(df) if df.count() <= _BROADCAST_IDS else df  # noqa: E731  counted
    few = small(met)
    # A key with many lines is dealt in blocks of indexed lines, each of which meets all that probe, so that no task has them all.
    here = cut(indexed.join(few, F.col("key") == F.col("m")).select("a", "key", F.pmod(F.col("a"), "parts").cast("int").alias("part")), "here")
    there = cut(probing.join(few, F.col("k") == F.col("m")).select("b", "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of")), "there")

    drop(distinct, met)

    ids = cut(here.select(F.col("a").alias("i")).union(there.select("b")).distinct(), "ids")
    texts = lines.select("id", "line").join(small(ids), F.col("id") == F.col("i"), "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    texts = cut(texts.withColumn("n", F.length("line")).select("id", "line", "n", own.alias("own"), F.concat(own, probes).alias("all"), marks(F.col("line")).alias("marks")), "texts")
    drop(ids)
    keyed = here, there
    here = cut(here.join(texts.select("id", F.col("line").alias("l_a"), F.col("n").alias("n_a"), "own", F.col("marks").alias("m_a")), F.col("a") == F.col("id")).drop("id"), "here")
    there = cut(there.join(texts.select("id", F.col("line").alias("l_b"), F.col("n").alias("n_b"), "all", F.col("marks").alias("m_b")), F.col("b") == F.col("id")).drop("id"), "there")
    drop(*keyed, texts)
    # Each pair is verified once, under its smallest common key, and within the join, so that no pairs but links leave it.
    once = (F.col("n_a") < F.col("n_b")) | (F.col("a") < F.col("b"))
    first_key = F.array_min(F.array_intersect("own", "all")) == F.col("key")
    shorter = F.least("n_a", "n_b")
    alike = F.when(shorter >= edits * per_edit, within(F.col("l_a"), F.col("l_b"), edits)).otherwise(F.levenshtein("l_a", "l_b") <= F.floor(shorter / per_edit))
    # Most pairs that share but a segment, of lines from one template say, are told apart by their marks, at the cost of a few operations.
    near = (F.col("key") == F.col("k")) & (F.col("part") == F.col("of")) & (F.col("a") != F.col("b")) & F.when(~once | (_different_marks("m_a", "m_b") > 4 * edits), False).when(~first_key, False).otherwise(alike)
    links = cut(here.join(there, near).select(F.col("a"), F.col("b")), "links")
    drop(here, there)

    degree = links.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("links"))
    label = components(links)
    linked = label.join(degree, F.col("node") == F.col("x")).select("node", "label", "links")
    first = places.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("doc", "pos")).alias("first"))
    known = cut(first.join(linked, F.col("id") == F.col("node"), "left").select(F.col("id").alias("i"), "first", F.coalesce("label", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    of_class = cut(known.groupBy(F.col("class_id").alias("c")).agg(F.min("first").alias("class_first")), "class")
    known = cut(known.join(of_class, F.col("class_id") == F.col("c")).drop("c"), "known")
    out = places.join(known, F.col("id") == F.col("i"), "left")
    here = F.struct("doc", "pos")
    status = F.when(F.col("id").isNull(), F.lit(None)).when(here == F.col("class_first"), "first").when(here == F.col("first"), "near").otherwise("equal")
    return out.select("doc", "pos", F.col("id").alias("line_id"), "class_id", "links", status.alias("status"))


def line_summary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """Per document id: n_lines, n_equal and n_near (lines that line_classes() would drop), n_links (of its lines) and class_id (the smallest of its lines' classes; null without lines)."""
    c = line_classes(docs, id_col=id_col, text_col=text_col, edits=edits, per_edit=per_edit)
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    return c.groupBy(F.col("doc").alias(id_col)).agg(F.count("line_id").alias("n_lines"), is_("equal").alias("n_equal"), is_("near").alias("n_near"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"), F.min("class_id").alias("class_id"))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """docs with each text's lines that are first in their class, and its blank lines; all other columns as they are. Rows are told apart by id (null first) and the 64-bit hash of their text; rows alike in both lose the same lines."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    c = line_classes(docs.select(key.alias("key"), F.col(text_col).alias("text")), id_col="key", text_col="text", edits=edits, per_edit=per_edit)
    doc, positions, own = unused(docs, "line_doc", "line_positions", "own_doc")
    dropped = cut(c.filter("status <> 'first'").groupBy(F.col("doc").alias(doc)).agg(F.collect_set("pos").alias(positions)), "dropped")
    gone = F.map_from_arrays(positions, positions)
    kept = let(gone, lambda m: F.filter(F.split(F.col(text_col), "\n"), lambda x, i: F.get(F.array(m[i]), F.lit(0)).isNull()))
    joined = docs.withColumn(own, key).join(dropped, F.col(own) == F.col(doc), "left")
    return joined.withColumn(text_col, F.when(F.col(positions).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop(own, doc, positions)
