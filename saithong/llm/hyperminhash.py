"""Near-duplicates by HyperMinHash: compressed registers are banded for candidates, a collision-corrected estimate sifts them, and links are confirmed on full shingle sets.

Documents with equal sets form a class; only a class's first document (its smallest id) goes on. In each bucket of a band all classes are held against the bucket's smallest id (a star: as many pairs as members), and links make components. Only buckets that then still hold several components are looked at pair by pair, in blocks, within tasks; of those pairs none is emitted but the links that join components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saithong.llm.common import by_bytes, cut_by_workers, drop, tidied, unused, word_numbers
from saithong.llm.components import components

P, R = 8, 10  # 2**P registers; bits of mantissa beside a leading-zero count of 6 bits
REGISTERS = 1 << P
BANDS, ROWS = 48, 6  # a pair with a Jaccard similarity of 0.8 shares no band with a probability of 4.6e-7
_MARGIN = 0.11  # estimates below the threshold by more are not verified: over 4 standard deviations
_BLOCK = 512
_TASK_ROWS = 3000  # rows of blocks in a task, about
_BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240)
_PICK = np.stack([_rng.permutation(REGISTERS)[:ROWS] for _ in range(BANDS)])
#: For each register the order in which an empty one looks for another to borrow from.
_BORROW = np.stack([_rng.permutation(REGISTERS) for _ in range(REGISTERS)])
_ODD = _rng.integers(1, 1 << 62, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that leaves no bit where it was."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text; A-Z lower-cased. Fewer words make one shingle."""
    words, numbers, sizes = word_numbers(texts, lower=True)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[numbers]

    def mix(h: np.ndarray, k: int) -> np.ndarray:
        s = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)])
        return s

    every = mix(h, n) if len(h) >= n else h
    out, at = [], 0
    for size in sizes.tolist():
        s = np.sort(every[at : at + size - n + 1]) if size >= n else mix(h[at : at + size], size) if size else h[:0]
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
        at += size
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of a sorted set of hashes, uint16: leading zeros and mantissa of the smallest hash of each bucket; 0 where a bucket is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(s):
        return out
    bucket = (s >> np.uint64(64 - P)).astype(np.int64)
    first = np.r_[True, bucket[1:] != bucket[:-1]]
    rest = s[first] << np.uint64(P) | np.uint64(1 << (P - 1))  # never 0
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63)
    zeros -= (rest >> (np.uint64(63) - zeros.astype(np.uint64))) != np.uint64(1)  # where the float was rounded up
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - R)
    out[bucket[first]] = ((zeros + 1) << R).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with each empty one borrowed from the first that isn't, in its own random order, so that equal sets stay equal and small sets can be banded."""
    empty = regs == 0
    if not empty.any() or empty.all():
        return regs
    out = regs.copy()
    where = np.flatnonzero(empty)
    order = _BORROW[where]
    out[where] = regs[order[np.arange(len(where)), np.argmax(~empty[order], axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """[documents, BANDS] keys, int64, of [documents, REGISTERS] filled registers."""
    picked = regs[:, _PICK].astype(np.uint64) + np.uint64(1)
    return mixed((mixed(picked * _ODD).sum(2) + np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates for rows of registers, corrected for registers that agree by chance (as many as sets of these sizes without a common member would have)."""
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = 0.169919487159739 * 2.0 ** (P - R) * 4 * ratio / (1 + ratio) ** 2 * (used / REGISTERS)
    return np.clip((same - chance) / np.maximum(used - chance, 1e-9), 0, 1)


def _signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for start, end in by_bytes(texts, 4 << 20):
                sets = shingle_sets(texts[start:end], n)
                keys = band_keys(np.stack([filled(registers(s)) for s in sets]))
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
                digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[start:end], pa.array(sizes), digest, bands], ["id", "n", "digest", "bands"])

    return cut_by_workers(docs.select(F.col(id_col), F.col(text_col)), "signatures", run, f"id {kind}, n bigint, digest binary, bands array<bigint>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, s, half, regs) of docs (id, text), as bytes: the sets of hashes, their upper halves, and their registers."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for start, end in by_bytes(texts, 4 << 20):
                sets = shingle_sets(texts[start:end], n)
                yield pa.RecordBatch.from_arrays([b.column(0)[start:end], pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary()), pa.array([registers(s).tobytes() for s in sets], pa.binary())], ["id", "s", "half", "regs"])

    return cut_by_workers(docs, "sets", run, f"id {kind}, s binary, half binary, regs binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(percent: int):
    """Links (a, b) among pairs (a, b, s_a, s_b): those whose estimate comes near the threshold and whose full sets reach it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                likely = 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and estimate(registers(a), registers(b), len(a), len(b)) >= percent / 100 - _MARGIN
                keep.append(likely and _similar(a, b, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(regs: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[float, int, int]]:
    """(minus the estimate, i, j) of the pairs of a block, of different components (and sides, if there are two), whose estimate comes near the threshold."""
    two, found, every = side.min() != side.max(), [], np.arange(len(n))
    for i in range(len(n)):
        j = np.flatnonzero((comp != comp[i]) & (every > i) & ((side != side[i]) if two else True) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if len(j):
            e = estimate(regs[i], regs[j], n[i], n[j])
            near = e >= percent / 100 - _MARGIN
            found += zip((-e[near]).tolist(), [i] * int(near.sum()), j[near].tolist(), strict=True)
    return found


def _codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _promising(percent: int):
    """Of a block's rows (key, kind, x, y, side, label, a, n, regs) those in a likely pair."""

    def run(table: pa.Table) -> pa.Table:
        regs = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("regs").combine_chunks()])
        pairs = _likely(regs, table.column("n").to_numpy(), _codes(table.column("label"))[1], table.column("side").to_numpy(), percent)
        rows = sorted({k for _, i, j in pairs for k in (i, j)})
        return table.drop_columns(["n", "regs"]).take(pa.array(rows, pa.int64()))

    return run


def _joined_in_block(percent: int):
    """Pairs (a, b) whose half hashes say that they link components of a block, of rows (label, a, half, side); once two components are joined no more links between them are looked for.

    Half hashes rarely agree by chance, and never nearly often enough to make up a hundredth of a set; whoever is that near to the threshold is returned but joins nothing.
    """

    def run(table: pa.Table) -> pa.Table:
        names, comp = _codes(table.column("label"))
        sets = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) << np.uint64(32) for x in table.column("half").combine_chunks()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        root = list(range(len(names)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for _, i, k in sorted(_likely(np.stack([registers(s) for s in sets]), n, comp, table.column("side").to_numpy(), percent)):
            x, y = top(comp[i]), top(comp[k])
            if x != y and _similar(sets[i], sets[k], percent - 1):
                out.append((i, k))
                if _similar(sets[i], sets[k], percent + 1):
                    root[x] = y
        a, b = (pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), ())))
        return pa.table([table.column("a").take(a), table.column("a").take(b)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: its id, n_shingles (size of its set), component_id (smallest id that links reach) and kept (its id is that).

    A row's set holds the distinct shingles of `shingle` lower-cased words; a text with fewer words has its whole sequence as one; texts without words, and null, have none and are linked with nothing. Rows with 100 * intersection >= percent * union are linked. Ids should be distinct and not null: equal rows with one id count as one document; rows with a null id stay alone, with a null component_id, and are kept. An empty table gives no rows; other columns of docs are ignored.
    Hashes of 64 bits stand for shingles. A link at the threshold itself is missed with a probability of about 5e-6: 4.6e-7 because no band is common, the rest because the estimate of full registers is too low; small sets, whose estimates are nearly exact, and closer pairs with less.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _signatures(docs, shingle, id_col, text_col)
    linked = rows.filter((F.col("n") > 0) & F.col("id").isNotNull())
    classes = cut_by_workers(linked.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    first = cut_by_workers(linked.join(classes.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("rep"))).select("rep", "n", "bands"), "first")

    keyed = first.select("rep", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.max("rep").alias("last"), F.count("*").alias("members"))
    buckets = cut_by_workers(buckets.filter(F.col("hub.rep") != F.col("last")), "buckets")
    member = cut_by_workers(keyed.join(buckets.select(F.col("key").alias("k"), "hub", "members"), F.col("key") == F.col("k")).select("key", "rep", "n", "hub", "members"), "members")

    drop(first, buckets)

    ids = cut_by_workers(member.groupBy("rep").agg(F.count("*").alias("times")).select(F.col("rep").alias("r")), "candidates")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    few = ids.count() <= _BROADCAST_IDS  # counted
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("r"), "left_semi")
    sets = _sets(texts, shingle)
    drop(ids)

    near = (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")) & (F.col("rep") != F.col("hub.rep"))
    star = member.filter(near).groupBy(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).agg(F.count("*").alias("bands"))
    with_sets = lambda df, side: df.join(sets.select(F.col("id").alias(f"i_{side}"), F.col("s").alias(f"s_{side}")), F.col(side) == F.col(f"i_{side}")).drop(f"i_{side}")
    pairs = cut_by_workers(with_sets(star.select("a", "b"), "a"), "half")
    links = cut_by_workers(with_sets(pairs, "b").select("a", "b", "s_a", "s_b"), "links", _confirmed(percent), f"a {kind}, b {kind}")
    drop(pairs)
    label = components(links, cut_by_workers)
    drop(links)

    # Buckets that still hold several components: all pairs between them, in blocks. The largest component needs none within itself, so only the others' rows are repeated for each of its blocks.
    labelled = cut_by_workers(member.filter("members > 2").join(label, F.col("rep") == F.col("node"), "left").select("key", F.col("rep").alias("a"), "n", F.coalesce("label", "rep").alias("label")), "labelled")
    drop(member)
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    several = sizes.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("total"), F.count("*").alias("comps")).filter("comps > 1")
    several = cut_by_workers(several.select("k", F.col("most.label").alias("main"), F.ceil(F.col("most.c") / _BLOCK).cast("int").alias("n_main"), F.ceil((F.col("total") - F.col("most.c")) / _BLOCK).cast("int").alias("n_rest")), "several")
    left = labelled.join(several, F.col("key") == F.col("k"))
    is_main, h = F.col("label") == F.col("main"), F.xxhash64("a")
    own = F.when(is_main, F.pmod(h, "n_main")).otherwise(F.pmod(h, "n_rest")).cast("int")
    place = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    main = F.transform(upto("n_rest"), lambda j: place(0, own, j, F.lit(0)))
    rest = F.concat(F.transform(upto("n_main"), lambda i: place(0, i, own, F.lit(1))), F.transform(upto("n_rest"), lambda j: place(1, F.least(own, j), F.greatest(own, j), own)))
    left = left.select("key", "label", "a", "n", F.explode(F.when(is_main, main).otherwise(rest)).alias("p")).select("key", "p.*", "label", "a", "n")
    block = ["key", "kind", "x", "y"]
    dealt = lambda df, rows: df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _TASK_ROWS)), *block)  # noqa: E731  by rows, not bytes: these stages compute much for little data
    left = cut_by_workers(left, "left")
    drop(labelled, several)
    with_regs = left.join(sets.select(F.col("id").alias("i"), "regs"), F.col("a") == F.col("i")).drop("i")
    blocks = left
    left = cut_by_workers(dealt(with_regs, left.count()).groupBy(*block).applyInArrow(_promising(percent), f"key bigint, kind int, x int, y int, side int, label {kind}, a {kind}").repartition(*block), "promising")
    drop(blocks)
    with_halves = left.join(sets.select(F.col("id").alias("i"), "half"), F.col("a") == F.col("i")).select(*block, "side", "label", "a", "half")
    likely = cut_by_workers(dealt(with_halves, left.count()).groupBy(*block).applyInArrow(_joined_in_block(percent), f"a {kind}, b {kind}").distinct(), "likely")
    more = with_sets(with_sets(likely, "a"), "b").select("a", "b", "s_a", "s_b").mapInArrow(tidied(_confirmed(percent)), f"a {kind}, b {kind}")
    by = lambda side: label.select(F.col("node").alias(f"n_{side}"), F.col("label").alias(f"l_{side}"))
    more = more.join(by("a"), F.col("a") == F.col("n_a"), "left").join(by("b"), F.col("b") == F.col("n_b"), "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    more = cut_by_workers(more.distinct(), "more")
    drop(sets, left, likely)
    top = components(more, cut_by_workers)
    drop(more)

    before = label.select(F.col("node").alias("l_node"))
    label = label.join(top.select(F.col("node").alias("t_node"), F.col("label").alias("t_label")), F.col("label") == F.col("t_node"), "left").select("node", F.coalesce("t_label", "label").alias("label"))
    alone = top.join(before, F.col("node") == F.col("l_node"), "left_anti").select("node", "label")
    label = cut_by_workers(label.unionByName(alone), "labels")
    known = cut_by_workers(classes.join(label, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("label", "rep").alias("component_id")), "known")
    drop(classes)
    out = rows.select("id", "n", "digest").join(known, (F.col("digest") == F.col("d")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that with the smallest id (null last); all rows without words, which are linked with nothing. Rows are told apart by a 64-bit hash of id and text, so rows with a null id, or with one id and different texts, are documents of their own; of rows alike in both one stays. What is to be dropped is sent to the texts if it is little (counted), else joined."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    found = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), id_col="key", text_col="text", shingle=shingle, percent=percent)
    small = lambda df: F.broadcast(df) if df.count() <= _BROADCAST_IDS else df
    rows = cut_by_workers(found.groupBy("key", F.col("component_id").alias("component")).agg(F.count("*").alias("n")), "components")
    # Keys of groups of several: those that aren't their component's own, and these components. No join deals rows by component, which a large group would make hot.
    others = rows.filter(F.col("key") != F.col("component")).select("key", "component")
    members = cut_by_workers(others.unionByName(others.groupBy(F.col("component").alias("key")).agg(F.first("component").alias("component"))), "members")
    ids = docs.select(key.alias("k"), F.col(id_col).alias("id")).join(small(members), F.col("k") == F.col("key")).select("key", "component", "id")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")).select(F.col("first.key").alias("stays"))
    bad, again = unused(docs, "dropped_key", "repeated_key")
    dropped = cut_by_workers(members.join(first, F.col("key") == F.col("stays"), "left_anti").select(F.col("key").alias(bad)), "dropped")
    out = docs.join(small(dropped), key == F.col(bad), "left_anti")
    repeated = cut_by_workers(rows.filter("n > 1").join(dropped, F.col("key") == F.col(bad), "left_anti").select(F.col("key").alias(again)), "repeated")
    if repeated.isEmpty():
        return out
    repeated = small(repeated)
    (name,) = unused(docs, "own_key")
    once = out.join(repeated, key == F.col(again), "left_semi").withColumn(name, key).dropDuplicates([name]).drop(name)
    return out.join(repeated, key == F.col(again), "left_anti").unionByName(once)
