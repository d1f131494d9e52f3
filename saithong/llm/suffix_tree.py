"""Language-model scoring by a probabilistic suffix tree over words, grown and read without a tree in one place.

A context is a word, or up to `depth` words (of which the first may be a text's beginning). All contexts that the training texts have at least twice are examined, whether their suffixes stay or not; one stays if its next words diverge from those of its suffix. Its distribution is smoothed with its suffix's, and a word is scored in the state of the longest suffix of what is before it that stayed.

Blocks of texts ask for sums over the corpus by 64-bit hashes of their distinct words and phrases, turn by turn: a block sends a key once, so no key is hot, sums are made by ranges of hashes, and nothing is collected or broadcast. Different phrases with the same hash would be counted as one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saithong.llm.common import by_bytes, cut, tidied, word_numbers

DEPTH = 3  # words of the longest contexts
BACK = 12.0  # weight of a suffix's distribution in that of its context, in tokens
GAIN = 6.0  # nats by which a context's next words must be likelier than in its suffix's distribution
_LEAST = 2  # occurrences of a context
_SLICE = 1_000_000  # tokens whose keys share a bucket, about
_END, _BEGIN = b"\n", b"\n\n"  # stand behind and before a text; no word has white space
_PIECE = 64 << 10  # bytes of a block in a row
_RAW = 5  # bytes of a difference between keys that are stored as they are


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for b in batches:
        column = pc.fill_null(b.column("text"), "")
        for start, end in by_bytes(column, 4 << 20):
            yield b.slice(start, end - start), column[start:end]


def _planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all lowest ones first, so that equal high ones lie together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)


def _packed(a: np.ndarray) -> bytes:
    """Counts or floats, compressed; counts in as few bytes each as the largest needs."""
    if a.dtype.kind != "f":
        a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    return a.dtype.str.ljust(4).encode() + len(a).to_bytes(8, "little") + pa.Codec("zstd").compress(_planes(a).tobytes(), asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    kind, n = np.dtype(b[:4].decode().strip()), int.from_bytes(b[4:12], "little")
    raw = pa.Codec("zstd").decompress(b[12:], n * kind.itemsize, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: their low bytes look random and stay, the others are mostly equal and are compressed."""
    planes = _planes(np.diff(keys, prepend=np.uint64(0)))
    return len(keys).to_bytes(8, "little") + planes[:_RAW].tobytes() + pa.Codec("zstd").compress(planes[_RAW:].tobytes(), asbytes=True)


def _unpacked_keys(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    low, high = b[8 : 8 + _RAW * n], pa.Codec("zstd").decompress(b[8 + _RAW * n :], (8 - _RAW) * n, asbytes=True) if n else b""
    planes = np.concatenate([np.frombuffer(x, np.uint8) for x in (low, high)]).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of 64-bit keys."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block of texts, the hashes of its distinct words, and its words as numbers among these: bytes in pieces, as large values burden the JVM. The first piece's row has the ids."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for b, texts in _texts(batches):
        words, numbers, sizes = word_numbers(texts, lower=True)
        train = pc.fill_null(b.column("train"), False).to_numpy(zero_copy_only=False)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.lexsort((hashes, -np.bincount(numbers, minlength=len(words))))  # frequent words get small numbers; equally frequent ones, most of all, small differences
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        hashes = _packed_keys(hashes[order])
        parts = [train.tobytes(), sizes.astype("<u4").tobytes(), hashes, _packed(place[numbers])]
        data = np.array([len(texts), len(hashes)], "<u8").tobytes() + b"".join(parts)
        pieces = [data[i : i + _PIECE] for i in range(0, len(data), _PIECE)]
        k, tokens = len(pieces), sizes + 1
        rows = pa.ListArray.from_arrays(pa.array([0] + [len(texts)] * k, pa.int32()), pa.StructArray.from_arrays([b.column("id"), b.column("extra")], ["id", "extra"]))
        once = lambda n, k=k: pa.array([int(n)] + [0] * (k - 1), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), pa.array(range(k), pa.int32()), once(tokens.sum()), once(tokens[train].sum()), pa.array(pieces, pa.binary()), rows], ["block", "piece", "n", "n_train", "data", "rows"])
        block += 1


def _counts_of(level: int) -> int:
    """The kind of asking how often training texts have phrases of level + 1 words."""
    return 2 * level


def _stays(level: int) -> int:
    """The kind of asking which contexts of so many words stay."""
    return 2 * level + 1


class _Level(NamedTuple):
    """Tokens behind contexts of so many words that are examined."""

    level: int
    at: np.ndarray  # their places
    context: np.ndarray  # the contexts' keys
    total: np.ndarray  # the contexts' occurrences
    n: np.ndarray  # those with this token behind them
    lower: np.ndarray  # the token's probability in the suffix's state
    upper: np.ndarray  # in the context's
    sure: np.ndarray  # the latter with one occurrence left out
    shared: np.ndarray  # whether texts that are not for training have the context too

    def told(self) -> np.ndarray:
        """Whether the divergence of the token's context is told and asked for. It need not be where training texts alone have the context and each of them knows: always the same next word, or two occurrences with different ones, which are no evidence."""
        return self.shared | ((self.n != self.total) & (self.total > 2))

    def stays(self, said: np.ndarray | None, gain: float) -> np.ndarray:
        """Whether the token's context stays; said: what was answered about those told."""
        out = (self.n == self.total) & (self.total * np.log(self.sure / self.lower) > gain)
        told = self.told()
        if told.any():
            out[told] = said.astype(bool)[np.unique(self.context[told], return_inverse=True)[1]]
        return out


class _Unknown(NamedTuple):
    """A level whose counts are still to be asked for: keys of phrases, and whether they are in training texts."""

    level: int
    keys: np.ndarray
    train: np.ndarray


class _Block:
    """The tokens of a block, and what has been answered about them."""

    def __init__(self, block: pa.Table, answers: pa.Table, n: int, v: int, back: float):
        self.n, self.v, self.back = n, v, back
        pieces = sorted(zip(block.column("piece").to_pylist(), block.column("data").to_pylist(), strict=True))
        data = b"".join(p for _, p in pieces)
        texts, words = np.frombuffer(data, "<u8", 2).tolist()
        at = 16 + np.cumsum([0, texts, 4 * texts, words])
        train, sizes = np.frombuffer(data[at[0] : at[1]], bool), np.frombuffer(data[at[1] : at[2]], "<u4").astype(np.int64)
        hashes = np.r_[_unpacked_keys(data[at[2] : at[3]]), np.array([xxhash.xxh3_64_intdigest(x) for x in (_END, _BEGIN)], np.uint64)]
        self.words, of_word = np.unique(hashes, return_inverse=True)
        end, begin = of_word[-2:]
        self.tokens = sizes + 1
        self.first = np.cumsum(self.tokens) - self.tokens
        self.flat = np.full(int(self.tokens.sum()), end)
        inside = np.ones(len(self.flat), bool)
        inside[self.first + sizes] = False
        self.flat[inside] = of_word[_unpacked(data[at[-1] :])]
        self.train = np.repeat(train, self.tokens)
        self.before = np.r_[begin, self.flat[:-1]]
        self.before[self.first] = begin
        self.counts = 2 * np.bincount(self.flat, self.train, len(self.words)).astype(np.int64) + (np.bincount(self.flat, ~self.train, len(self.words)) > 0)
        self.counts[begin] = 2 * self.train[self.first].sum() + (not self.train[self.first].all())
        kinds, buckets, data = (answers.column(k).to_pylist() for k in ("kind", "bucket", "data"))
        parts: dict[int, list] = {}
        for k, _, d in sorted(zip(kinds, buckets, data, strict=True), key=lambda x: x[:2]):
            parts.setdefault(k, []).append(_unpacked(d))
        self.said = {k: np.concatenate(p) for k, p in parts.items()}

    def levels(self, most: int) -> Iterator[_Level | _Unknown]:
        """Level by level of contexts, up to the first that is unknown."""
        key = _mixed(self.words[self.before], self.words[self.flat])  # of the phrase that ends at each token
        if _counts_of(0) not in self.said:
            yield _Unknown(1, key, self.train)
            return
        count, others = (self.said[_counts_of(0)] >> 1).astype(np.int64), (self.said[_counts_of(0)] & 1).astype(bool)
        self.known = (count > 0)[self.flat]
        p = self.base = ((count + 0.1) / (self.n + 0.1 * (self.v + 1)))[self.flat]
        at = np.flatnonzero(count[self.before] >= _LEAST)
        context, total, shared = self.words[self.before[at]], count[self.before[at]], others[self.before[at]]
        asked, n = np.arange(len(key)), np.zeros(len(key), np.int64)  # n: how often training texts have the phrase
        elsewhere = np.zeros(len(n), bool)  # whether other texts have it too
        begins = np.zeros(len(n), bool)
        begins[self.first] = True
        for level in range(1, most + 1):
            if len(asked):
                if _counts_of(level) not in self.said:
                    yield _Unknown(level, key[asked], self.train[asked])
                    return
                said = self.said[_counts_of(level)][np.unique(key[asked], return_inverse=True)[1]]
                n[asked], elsewhere[asked] = said >> 1, said & 1
            lower = p[at]
            upper = (n[at] + self.back * lower) / (total + self.back)
            yield _Level(level, at, context, total, n[at], lower, upper, (np.maximum(n[at] - 1, 0) + self.back * lower) / (total - 1 + self.back), shared)
            p = p.copy()
            p[at] = upper
            # One word more before: the context is the phrase that ended at the token before, if it doesn't reach into another text.
            at = at[~begins[at]]
            at = at[n[at - 1] >= _LEAST]
            context, total, shared = key[at - 1], n[at - 1], elsewhere[at - 1]
            shorter, key_before = n, key
            key = np.zeros_like(key_before)
            key[at] = _mixed(key_before[at - 1], self.words[self.flat[at]])
            # What occurs once, and here in a training text, does so with any word before it, which need not be told if no other text has it; what doesn't occur doesn't.
            n = np.zeros_like(shorter)
            n[at] = np.minimum(shorter[at], 1)
            asked = at[(shorter[at] > 1) | ((shorter[at] == 1) & (elsewhere[at] | ~self.train[at]))]
            elsewhere = np.zeros_like(elsewhere)

    def asks(self, turn: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, sorted keys, values to add up) of a turn: how often training texts have phrases of turn + 1 words (and words, in the first), twice that and one more if other texts have them; and nats by which the next words of contexts are likelier than in the suffix's state: of single words in the second turn, of others when they weigh least on the disks, a turn after they could."""
        if turn == 1:
            yield _counts_of(0), self.words, self.counts
        for x in self.levels(min(turn, depth)):
            if isinstance(x, _Unknown):
                keys, of = np.unique(x.keys, return_inverse=True)
                yield _counts_of(x.level), keys, 2 * np.bincount(of, x.train, len(keys)).astype(np.int64) + (np.bincount(of, ~x.train, len(keys)) > 0)
            elif turn == (min(x.level + 2, depth + 1) if x.level > 1 else 2) and (told := x.told()).any():
                keys, of = np.unique(x.context[told], return_inverse=True)
                nats = self.train[x.at[told]] * np.log(x.sure[told] / x.lower[told])
                yield _stays(x.level), keys, np.bincount(of, nats, len(keys)).astype(np.float32)

    def scores(self, depth: int, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, those with a count, log10 of its probability by word counts and by the tree."""
        p = None
        for x in self.levels(depth):
            p = self.base.copy() if p is None else p
            on = x.stays(self.said.get(_stays(x.level)), gain)
            p[x.at[on]] = x.upper[on]
        total = lambda x: np.add.reduceat(x, self.first)
        return self.tokens, total(self.known.astype(np.int64)), total(np.log10(self.base)), total(np.log10(p))


def _answered(gain: float) -> Callable[[pa.Table], pa.Table]:
    """Sums of the values of equal keys of a bucket, given back to each block in the order of its keys: counts (twice, and one more for texts that are not for training), or whether a context stays. n counts the distinct keys that occur, on one row of each bucket."""

    def run(asked: pa.Table) -> pa.Table:
        kind, bucket = asked.column("kind")[0].as_py(), asked.column("bucket")[0].as_py()
        order = np.argsort(asked.column("block").to_numpy(), kind="stable")  # sums of floats in the same order in every run
        asked = asked.take(pa.array(order))
        keys = [_unpacked_keys(k) for k in asked.column("keys").to_pylist()]
        values = np.concatenate([_unpacked(x) for x in asked.column("sums").to_pylist()])
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        if kind % 2:
            total = np.bincount(of, values, len(distinct))
            answer = (total > gain).astype(np.uint8)
        else:
            total = np.bincount(of, values >> 1, len(distinct)).astype(np.int64)
            answer = 2 * total + (np.bincount(of, values & 1, len(distinct)) > 0)
        ends = np.cumsum([len(k) for k in keys])
        data = [_packed(answer[of[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
        n = [int((total > 0).sum())] + [0] * (len(keys) - 1)
        return pa.table({"block": asked.column("block"), "kind": pa.array([kind] * len(keys), pa.int32()), "bucket": pa.array([bucket] * len(keys), pa.int32()), "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


_ASK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])
_NOTHING = pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})


def corpus_scores(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, depth: int = DEPTH, back: float = BACK, gain: float = GAIN) -> DataFrame:
    """Per row: its id, the columns of extra, n_tokens, n_known (tokens with a count), train_tokens, base_score and score (log10 of the text's probability by word counts, and by the tree of the rows where `training` holds), and gain_per_token, the mean of what the tree adds.

    In a context with `total` occurrences a word with n of them has the probability (n + back * p) / (total + back), with p its probability in the suffix's state, and for the empty context by word counts; so the probabilities of all words add up to what those by word counts do. A context stays if, over its occurrences, the logarithms of these probabilities, each with the occurrence itself left out of n and total, exceed those in the suffix's state by more than `gain`: what is seen once is no evidence.
    Lower-case A-Z; a null or empty text is one token, the end; where `training` is null it doesn't hold. With no training text every token has the same probability. Ties at the bounds: a context with 2 occurrences is examined, one with exactly `gain` goes. Repeated rows and null ids give a row each; an empty table gives no rows; other columns are ignored.
    """
    extra = extra or {}
    rows = docs.select(F.col(id_col).alias("id"), F.struct(F.lit(0).alias("_"), *(c.alias(k) for k, c in extra.items())).alias("extra"), training.alias("train"), F.col(text_col).alias("text"))
    kind, more = (rows.schema[k].dataType.simpleString() for k in ("id", "extra"))
    blocks = cut(rows.mapInArrow(tidied(_encoded), f"block bigint, piece int, n bigint, n_train bigint, data binary, rows array<struct<id: {kind}, extra: {more}>>"), "blocks")
    size, n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    bits = max(1, math.ceil(math.log2(size / _SLICE))) if size else 1
    answers, v = None, 0

    def asked(block: pa.Table, said: pa.Table, turn: int) -> pa.Table:
        out: dict[str, list] = {k: [] for k in _ASK.names}
        name = block.column("block")[0].as_py()
        for what, keys, sums in _Block(block, said, n, v, back).asks(turn, depth):
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, z in zip(starts, np.r_[starts[1:], len(keys)][: len(starts)], strict=True):
                for k, x in zip(out, (name, what, int(bucket[a]), _packed_keys(keys[a:z]), _packed(sums[a:z])), strict=True):
                    out[k].append(x)
        return pa.table(list(out.values()), schema=_ASK)

    def in_turn(turn: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda block, said: asked(block, said, turn)

    def final(block: pa.Table, said: pa.Table) -> pa.Table:
        own = block.column("rows").combine_chunks().flatten()
        columns = _Block(block, said, n, v, back).scores(depth, gain)
        return pa.table([own.field("id"), own.field("extra"), *map(pa.array, columns)], names=["id", "extra", "n_tokens", "n_known", "base_score", "score"])

    ask = "block bigint, kind int, bucket int, keys binary, sums binary"
    texts = blocks.select("block", "piece", "data")
    for turn in range(1, depth + 2):
        if turn == 1:
            wanted = texts.groupBy("block").applyInArrow(lambda block: asked(block, _NOTHING, 1), ask)
        else:
            wanted = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(in_turn(turn), ask)
        got = cut(wanted.groupBy("bucket", "kind").applyInArrow(_answered(gain), "block bigint, kind int, bucket int, n bigint, data binary"), "answers")
        if turn == 1:
            v = got.filter(F.col("kind") == _counts_of(0)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] - (n > 0)  # without the beginning
        answers = got if answers is None else answers.unionByName(got)
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(final, f"id {kind}, extra {more}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), *(F.col(f"extra.{k}").alias(k) for k in extra), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain_per_token"))
