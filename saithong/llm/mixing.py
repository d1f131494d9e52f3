"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything is DataFrame expressions. Sizes are cut to a narrow table once; the rest reads only that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saithong.llm.common import cut, n_words_of, words_of

SEED = "mix"
_BROADCAST_ROWS = 10_000


def water_fill(sources: DataFrame, *, max_epochs: int = 3) -> DataFrame:
    """sources (source, source_size, weight; a row each, all of which one task puts in order) with target, the share of the sum of all sizes that each source gets.

    Sources want shares in proportion to their weights but get at most max_epochs times their size; what is above is dealt again by weight until none is above. That is a water level: in order of cap per weight, the first k sources stand at their caps and the others at level * weight, with the smallest k for which none of the others is above its cap. Needs max_epochs >= 1; sources of size 0 get 0.
    """
    size, weight = F.col("source_size"), F.col("weight")
    cap = max_epochs * size
    order = Window.orderBy(cap.cast("double") / weight, F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = sources.withColumns({
        "left_size": F.sum(size).over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "left_weight": F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0)),
    })
    # With all before it capped, this source is the first that isn't above its cap, or one after it.
    below = F.col("left_size").cast("double") * weight / F.col("left_weight") <= cap
    filled = filled.withColumn("k", F.min(F.when(below, F.struct(cap.cast("double") / weight, F.col("source").isNull(), F.col("source"), "left_size", "left_weight"))).over(whole))
    level = F.col("k.left_size").cast("double") * weight / F.col("k.left_weight")
    return filled.select("source", "source_size", "weight", F.when(F.col("k").isNull(), cap.cast("double")).otherwise(F.least(level, cap.cast("double"))).alias("target"))


def by_rank(sources: DataFrame, n_weights: int = 3) -> DataFrame:
    """sources with weight: 1, 2, ... n_weights, repeating, in order of the code points of source, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", (F.pmod(place - 1, F.lit(n_weights)) + 1).cast("long"))


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows (counted); else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def _sized(docs: DataFrame, id_col: str, text_col: str, seed: str) -> DataFrame:
    """docs with _size (words), _h (the seeded hash of the id) and _bin (its first digits)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.withColumns({"_size": n_words_of(F.col(text_col)), "_h": h, "_bin": F.conv(F.substring(h, 1, 3), 16, 10).cast("int")})


def plan_mix(sized: DataFrame, *, source_col: str, weights: DataFrame | None = None, max_epochs: int = 3) -> DataFrame:
    """Per source of sized rows (_size, _bin): _source, source_size, target, _base (whole repetitions of each row), _rest (words beyond them), and the bin at whose border the rest ends (_border, _below: words of the bins before it)."""
    bins = cut(sized.groupBy(F.col(source_col).alias("source"), F.col("_bin").alias("bin")).agg(F.sum("_size").alias("bin_size")), "bins")
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    if weights is None:
        sources = by_rank(sources)
    else:
        w = weights.select(F.col("source").alias("s"), F.col("weight"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("weight", F.coalesce("weight", F.lit(1)))
    per = water_fill(sources, max_epochs=max_epochs)
    per = per.withColumn("_base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    per = per.select(F.col("source").alias("_source"), "source_size", "target", "_base", (F.floor("target").cast("long") - F.col("_base") * F.col("source_size")).alias("_rest"))
    per = cut(per, "sources")
    below = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    border = bins.withColumn("below", F.coalesce(F.sum("bin_size").over(below), F.lit(0)))
    border = border.join(_small(per.select(F.col("_source").alias("s"), "_rest")), F.col("source").eqNullSafe(F.col("s")))
    border = border.filter((F.col("below") <= F.col("_rest")) & (F.col("_rest") < F.col("below") + F.col("bin_size")))
    border = border.select(F.col("source").alias("s"), F.col("bin").alias("_border"), F.col("below").alias("_below"))
    return cut(per.join(border, F.col("_source").eqNullSafe(F.col("s")), "left").drop("s"), "plan")


def deal(sized: DataFrame, plan: DataFrame, *, id_col: str, source_col: str) -> DataFrame:
    """sized rows with the plan's columns, _whole (whole repetitions) and _part (words of a last, fractional one). Only rows of the bins at the borders are put in order, source by source: a 4096th of each."""
    rows = sized.join(_small(plan), F.col(source_col).eqNullSafe(F.col("_source")))
    at_border = F.col("_bin") == F.col("_border")
    order = Window.partitionBy("_source").orderBy("_h", id_col, "_size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_below") - F.coalesce(F.sum("_size").over(order), F.lit(0))
    # Without a border the rest is 0.
    easy = rows.filter(~F.coalesce(at_border, F.lit(False))).withColumn("_extra", F.when(F.col("_bin") < F.col("_border"), F.col("_size")).otherwise(F.lit(0)))
    edge = rows.filter(at_border).withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_size"), left)))
    whole: Column = F.col("_base") + F.when((F.col("_extra") == F.col("_size")) & (F.col("_size") > 0), 1).otherwise(0)
    part: Column = F.when(F.col("_extra") < F.col("_size"), F.col("_extra")).otherwise(0)
    return easy.unionByName(edge).withColumns({"_whole": whole.cast("long"), "_part": part.cast("long")})


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """Per row of docs: id, source, size (words), source_size, target, whole (whole repetitions), part (words of a last, fractional one) and taken = whole * size + part.

    The words that a source's rows take add up to its target, rounded down. Each row gets floor(target / source_size) repetitions; the rest of the target goes to rows in the order of md5(seed:id), whole while they fit, and the row at the border is taken in part. So no row exceeds max_epochs repetitions, and reruns agree.
    weights: (source, weight) with weight > 0; without it, by_rank(). Null texts have size 0 and take nothing; the null source is a source of its own; repeated rows and ids are rows of their own; an empty table gives no rows; other columns of docs are ignored.
    A source's rows are never gathered in one task: sums by source and the first digits of the hash come first, and only the group at the border is put in order.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = cut(_sized(narrow, "id", "text", seed).drop("text"), "sizes")
    out = deal(sized, plan_mix(sized, source_col="source", weights=weights, max_epochs=max_epochs), id_col="id", source_col="source")
    taken = F.col("_whole") * F.col("_size") + F.col("_part")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", F.col("_whole").alias("whole"), F.col("_part").alias("part"), taken.alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, weights: DataFrame | None = None, max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of docs, as often as mix() takes them, with all their columns; a fractional repetition has the text's first words, joined by blanks (and length_col, if given, their length). The texts aren't shuffled."""
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}  # the columns made here can clash with none of these
    docs = docs.toDF(*at.values())
    id_col, text_col, source_col, length_col = at[id_col], at[text_col], at[source_col], at.get(length_col or "")
    sizes = cut(_sized(docs.select(F.col(id_col), F.col(source_col), F.col(text_col)), id_col, text_col, seed).select(F.col(source_col).alias("source"), "_size", "_bin"), "sizes")
    plan = plan_mix(sizes, source_col="source", weights=weights, max_epochs=max_epochs)
    dealt = deal(_sized(docs, id_col, text_col, seed), plan, id_col=id_col, source_col=source_col)
    copies = F.filter(F.sequence(F.lit(1), F.col("_whole").cast("int") + 1), lambda k: (k <= F.col("_whole")) | (F.col("_part") > 0))
    rows = dealt.withColumn("_copy", F.explode(copies))
    cut_short = F.col("_copy") > F.col("_whole")
    text = F.when(cut_short, F.array_join(F.slice(words_of(F.col(text_col)), F.lit(1), F.greatest(F.col("_part"), F.lit(1)).cast("int")), " ")).otherwise(F.col(text_col))
    rows = rows.withColumn("_text", text)
    if length_col:
        rows = rows.withColumn(length_col, F.when(cut_short, F.length("_text").cast("long")).otherwise(F.col(length_col)))
    return rows.withColumn(text_col, F.col("_text")).select(*(F.col(c) for c in docs.columns)).toDF(*names)
