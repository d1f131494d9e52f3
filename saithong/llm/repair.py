"""Token ids in binary shards, compressed by Re-Pair grammars, with random access to each document."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saithong.llm.common import by_bytes, coded_words, cut_by_workers, held, tidied

END = 1
_MEMO = 500_000
_ROWS = 50_000  # documents in a task, about
_BLOCK = 1 << 20  # ids in a shard, about; a longer document makes a shard of its own
#: One row of the file format. rules: pairs of symbols, uint32; a rule's own symbol is n_ids plus its place. lengths: ids that each rule expands to, uint32. symbols: the compressed sequence, uint32 or uint16. doc_sizes, doc_symbols: ids and symbols of each document, uint32.
SHARD = "part int, shard int, n_ids int, width int, n_tokens bigint, rules binary, lengths binary, symbols binary, doc_sizes binary, doc_symbols binary"


def grammar(ids: np.ndarray, sizes: np.ndarray, n_ids: int, *, per_round: int = 4096, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths, symbols of each document) for the ids of documents of these sizes, none 0: round by round the most frequent pairs of neighbours, at most per_round at once, become new symbols, until no pair occurs `least` times; a pair never spans two documents."""
    seq, rules, lengths = ids.astype(np.uint32), [np.zeros((0, 2), np.int64)], np.ones(n_ids, np.int64)
    ends = np.cumsum(sizes) - 1
    top = n_ids
    while True:
        half, code = (16, np.uint32) if top < 0xFFFF else (32, np.uint64)  # bits of a symbol
        codes = seq[:-1].astype(code)
        codes <<= code(half)
        codes |= seq[1:]
        codes[ends[:-1]] = np.iinfo(code).max
        codes.sort()
        codes = codes[: len(codes) - len(ends) + 1]
        if not len(codes):
            break
        starts = np.r_[0, 1 + np.flatnonzero(codes[1:] != codes[:-1])]
        counts = np.diff(starts, append=len(codes))
        frequent = counts >= least
        if not frequent.any():
            break
        found, counts = codes[starts[frequent]], counts[frequent]
        best = np.sort(found[np.lexsort((found, -counts))[:per_round]])
        a, b = (best >> code(half)).astype(np.int64), (best & code((1 << half) - 1)).astype(np.int64)
        lefts, rights = np.unique(a), np.unique(b)
        left, right = np.zeros(top, np.int16), np.zeros(top, np.int16)
        left[lefts], right[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        table = np.zeros((len(lefts) + 1, len(rights) + 1), np.int16)
        table[left[a], right[b]] = np.arange(1, len(best) + 1)
        wide = seq.astype(np.intp)
        l, r = left.take(wide[:-1], mode="clip"), right.take(wide[1:], mode="clip")
        l[ends[:-1]] = 0
        at = np.flatnonzero((l > 0) & (r > 0))
        rule = table.reshape(-1)[l[at].astype(np.int32) * table.shape[1] + r[at]]
        hit = np.flatnonzero(rule)
        at, rule = at[hit], rule[hit]
        near = np.flatnonzero(np.diff(at) == 1)  # of pairs that overlap every other one is taken, from the left
        if len(near):
            nth = np.arange(len(near))
            first = np.r_[True, np.diff(near) != 1]
            odd = (nth - np.maximum.accumulate(np.where(first, nth, 0))) % 2 == 0
            taken = np.ones(len(at), bool)
            taken[near[odd] + 1] = False
            at, rule = np.compress(taken, at), np.compress(taken, rule)
        seq[at] = top - 1 + rule.astype(np.int64)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = np.compress(keep, seq)
        ends = ends - np.searchsorted(at + 1, ends, "right")
        rules.append(np.stack([a, b], 1))
        lengths = np.r_[lengths, lengths[a] + lengths[b]]
        top += len(best)
    return seq, np.concatenate(rules), lengths[n_ids:], np.diff(ends, prepend=-1)


def expansions(rules: np.ndarray, lengths: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, start, length): symbol s expands to flat[start[s] : start[s] + length[s]]."""
    length = np.r_[np.ones(n_ids, np.int64), lengths]
    start = np.cumsum(length) - length
    flat = np.empty(int(length.sum()), np.uint32)
    flat[:n_ids] = np.arange(n_ids)
    for k, (a, b) in enumerate(rules.tolist(), n_ids):
        s, n = start[k], length[a]
        flat[s : s + n] = flat[start[a] : start[a] + n]
        flat[s + n : s + n + length[b]] = flat[start[b] : start[b] + length[b]]
    return flat, start, length


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The slices of flat for each of which, one after another; no slice may be empty."""
    n, first = length[which], start[which]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0]
    place = np.ones(int(ends[-1]), np.int32 if len(flat) < 1 << 31 else np.int64)
    place[0] = first[0]
    place[ends[:-1]] = first[1:] - (first[:-1] + n[:-1] - 1)
    return flat[np.cumsum(place, out=place)]


# The normalizer and pre-tokenizer of files whose words can be encoded apart: lower case, white space dropped, letters, digits and other characters split from each other.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MARKS = ".,;:!?"
#: A mark behind a letter or digit, which this pre-tokenizer always splits off.
_MARKED = f"[a-z0-9ß-öø-ÿ][{_MARKS}]$"
#: Words of lower-case Latin letters alone: normalization leaves them as they are and the pre-tokenizer whole, so the library's model can be asked at once. _BYTE_CHARS: the characters that stand for bytes in its vocabulary: printable ones for themselves, the others from 256 on.
_PLAIN = "^[a-zß-öø-ÿ]+$"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def by_words(config: dict) -> bool:
    """Whether a tokenizer file encodes a text as its words between ASCII white space, in lower case, marks at their ends apart: it has the normalizer and pre-tokenizer above, and added tokens that only words with a < can hold."""
    special = all("<" in t["content"] and not re.search(r"\s", t["content"]) and not any(t[k] for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in config.get("added_tokens") or [])
    return config.get("normalizer") == _NORMALIZER and config.get("pre_tokenizer") == _PRE_TOKENIZER and special


def _stems(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(what to encode for each word, number of a mark to encode after it, or 0): A-Z in lower case, as the tokenizer makes them, and without a mark at the end. Words that could hold a special token stay whole."""
    special = pc.match_substring(words, "<")
    low = pc.if_else(special, words, pc.ascii_lower(words))
    marked = pc.and_not(pc.match_substring_regex(low, _MARKED), special)
    mark = pc.index_in(pc.utf8_slice_codeunits(low, -1), value_set=pa.array(list(_MARKS)))
    number = pc.fill_null(pc.if_else(marked, pc.add(mark, 1), 0), 0)
    return pc.if_else(marked, pc.utf8_slice_codeunits(low, 0, -1), low), number.to_numpy(zero_copy_only=False).astype(np.int64)


class Encoder:
    """Whole texts to ids with the tokenizers library. If the file allows it (by_words) words are encoded apart: their stems once, which are remembered up to a bound; else each text is encoded as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        config = json.loads(self.model.to_str())
        self.apart = by_words(config)
        self.plain = self.apart and config["model"]["type"] == "BPE"
        self.n_ids = max(self.model.get_vocab_size(with_added_tokens=True), END + 1)
        if self.apart:
            self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}  # places of stems
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add(pa.array(["", *_MARKS]))

    def _add(self, stems: pa.Array) -> None:
        names, plain = stems.to_pylist(), pc.match_substring_regex(stems, _PLAIN).to_pylist()
        merge = self.model.model.tokenize
        if not self.plain:
            plain = [False] * len(names)
        ids: list = [[t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS))] if ok else None for w, ok in zip(names, plain, strict=True)]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, self.model.encode_batch_fast([names[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = x.ids
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.memo.update(zip(names, range(len(self.start), len(self.start) + len(names)), strict=True))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(n) - n]
        self.length = np.r_[self.length, n]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END after it; number of ids of each text)."""
        if not self.apart:
            rows = [[*x.ids, END] for x in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            n = np.fromiter(map(len, rows), np.int64, len(rows))
            return np.fromiter(chain.from_iterable(rows), np.uint32, int(n.sum())), n
        if len(self.memo) > _MEMO:
            self.reset()
        words, numbers, counts = coded_words(texts)
        stems, mark = _stems(words)
        coded = stems.dictionary_encode()
        places = np.fromiter(map(self.memo.get, coded.dictionary.to_pylist(), repeat(-1)), np.int64, len(coded.dictionary))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            places[missing] = len(self.start) + np.arange(len(missing))
            self._add(coded.dictionary.take(pa.array(missing)))
        # The distinct words' ids, one after another: stem, then mark (place 0 is empty, places 1 to 6 are the marks).
        at = np.stack([places[coded.indices.to_numpy(zero_copy_only=False)], mark], 1).reshape(-1)
        own = np.r_[gather(self.flat, self.start, self.length, at[self.length[at] > 0]), np.uint32(END)]
        length = np.r_[self.length[at].reshape(-1, 2).sum(1), 1]
        # The end follows each text like a word of its own; words without ids fall out.
        ends = np.cumsum(counts + 1) - 1
        seq = np.full(len(numbers) + len(counts), len(words), np.int64)
        inside = np.ones(len(seq), bool)
        inside[ends] = False
        seq[inside] = numbers
        sizes = np.diff(np.cumsum(length[seq])[ends], prepend=0)
        if not length.all():
            seq = seq[length[seq] > 0]
        return gather(own, np.cumsum(length) - length, length, seq), sizes


def encoder(path: str) -> Encoder:
    """The Python worker's encoder for a file; what it remembers serves all of the stage's tasks."""
    if (__name__, path) not in held:
        held[__name__, path] = Encoder(path)
    return held[__name__, path]


def _shard(part: int, shard: int, ids: list[np.ndarray], sizes: list[np.ndarray], n_ids: int) -> tuple:
    flat, n = np.concatenate(ids), np.concatenate(sizes)
    symbols, rules, lengths, per_doc = grammar(flat, n, n_ids)
    width = 2 if n_ids + len(rules) <= 1 << 16 else 4
    as_bytes = lambda x, w=4: x.astype(f"<u{w}").tobytes()
    return part, shard, n_ids, width, len(flat), as_bytes(rules), as_bytes(lengths), as_bytes(symbols, width), as_bytes(n), as_bytes(per_doc)


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block: int = _BLOCK) -> DataFrame:
    """The table of shards (SHARD and doc_ids, an array) of docs in ascending order of ids, written in the shared folder and read from there.

    Rows are dealt by ranges of ids, so that shards in order of (part, shard) hold ids in ascending order, nulls first; rows with the same id follow in the order of a hash of their texts, which deals them to several tasks if they are many. A null text is the empty text: END alone. An empty table makes no shards.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in SHARD.split(", ")]
    types = [pa.int32()] * 4 + [pa.int64()] + [pa.binary()] * 5

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard, held = encoder(path), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        keys: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            row = _shard(part, shard, ids, sizes, encode.n_ids)
            doc_ids = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(row, types, strict=True)), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)], [*names, "doc_ids"])

        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for start, end in by_bytes(texts, 12 << 20):
                out, n = encode(texts[start:end])
                at = np.r_[0, np.cumsum(n)]
                cuts = [0, *np.unique(np.searchsorted(at, np.arange(block, at[-1], block))).tolist(), len(n)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    ids.append(out[at[lo] : at[hi]])
                    sizes.append(n[lo:hi])
                    keys.append(b.column(0)[start + lo : start + hi])
                    held += int(at[hi] - at[lo])
                    if held >= block:
                        yield flush()
                        ids, sizes, keys, held, shard = [], [], [], 0, shard + 1
        if ids:
            yield flush()

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // _ROWS))
    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("text_hash"))
    ordered = rows.repartitionByRange(parts, F.col(id_col), F.col("text_hash")).sortWithinPartitions(id_col, "text_hash").drop("text_hash")
    return cut_by_workers(ordered, "shards", run, f"{SHARD}, doc_ids array<{kind}>")


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, row: dict):
        u4 = lambda k: np.frombuffer(row[k], "<u4").astype(np.int64)
        self.n_ids, self.sizes, per_doc = row["n_ids"], u4("doc_sizes"), u4("doc_symbols")
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.int64)
        self.first = np.r_[0, np.cumsum(per_doc)]
        self.flat, self.start, self.length = expansions(u4("rules").reshape(-1, 2), u4("lengths"), self.n_ids)

    def doc(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard; only its own symbols are expanded."""
        return gather(self.flat, self.start, self.length, self.symbols[self.first[k] : self.first[k + 1]])

    def span(self, start: int, end: int) -> np.ndarray:
        """The shard's ids from start to end: expansion lengths tell which symbols cover them."""
        ends = np.cumsum(self.length[self.symbols])
        a, b = np.searchsorted(ends, [start, end - 1], "right")
        before = ends[a] - self.length[self.symbols[a]]
        return gather(self.flat, self.start, self.length, self.symbols[a : b + 1])[start - before : end - before]

    def all(self) -> np.ndarray:
        return gather(self.flat, self.start, self.length, self.symbols)


def read_shards(shards: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shards: part, shard, its id, the place of its first id in the shard, n_tokens and the crc32 of its ids as little-endian uint32."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i].as_py() for k in b.schema.names if k != "doc_ids"}
                s = Shard(row)
                raw, ends = memoryview(s.all().astype("<u4").tobytes()), np.cumsum(s.sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), s.sizes.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), b.column("doc_ids")[i].values, pa.array(ends - s.sizes), pa.array(s.sizes), pa.array(crc, pa.int64())], ["part", "shard", id_col, "place", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(tidied(run), f"part int, shard int, `{id_col}` {kind}, place bigint, n_tokens bigint, ids_crc32 bigint")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Per shard (part, shard): before, the number of ids in all shards before it. Summed per part first, so that one task orders no more than the parts."""
    sizes = shards.select("part", "shard", "n_tokens")
    up_to: Column = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return sizes.withColumn("up_to", F.coalesce(up_to, F.lit(0))).join(parts, F.col("part") == F.col("p")).select("part", "shard", (F.col("base") + F.col("up_to")).alias("before"))


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", broadcast_shards: int = 100_000) -> DataFrame:
    """Writes docs as shards, reads them back, and returns per document: its id, start (ids of all documents before it), n_tokens and ids_crc32. Rules for nulls, repeated and empty input: see write_shards."""
    shards = write_shards(docs, path, id_col=id_col, text_col=text_col)
    starts = shard_starts(shards)
    if shards.count() <= broadcast_shards:  # counted: few rows of three numbers
        starts = F.broadcast(starts)
    return read_shards(shards, id_col=id_col).join(starts, ["part", "shard"]).select(F.col(id_col), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
