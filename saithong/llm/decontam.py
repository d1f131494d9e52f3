"""Benchmark decontamination over a distributed positional inverted index.

The index is dealt by documents: each row holds the posting lists of a block of documents, sorted by term and position. Test terms are looked up block by block: the postings of a phrase's rarest term, moved by its offset, are intersected with the lists of the next rarest, and so on. Nothing is shuffled by term, so frequent terms are no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saithong.llm.common import cut, cut_by_workers, tidied, unused, word_numbers

WINDOW = 13
_BLOCK_BYTES = 4 << 20
_QUERY_ROWS = 20_000  # test items looked up at a time
#: Lower-cases A-Z and makes a blank of all that is no digit, letter or byte above ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: terms: distinct terms of the block, joined by blanks, in order of their numbers; ends: of each term's posting list; postings: positions in the block, uint32, by term and position; first: position of each document's first word; sizes: words of each document. A free position lies between documents, so that no phrase spans two.
INDEX = "terms binary, ends binary, postings binary, first binary, sizes binary"


def fold(text: bytes) -> list[bytes]:
    """Words of a text: lower case, digits, letters and characters above ASCII."""
    return text.translate(_FOLD).split()


def index_block(texts: list[bytes]) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """The columns of INDEX for a block of documents."""
    words, ids, sizes = word_numbers(pa.array([t.translate(_FOLD) for t in texts], pa.binary()))
    first = np.cumsum(sizes + 1) - sizes - 1
    at = (np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)).astype("<u4")
    ends = np.cumsum(np.bincount(ids, minlength=len(words)))
    return b" ".join(words), ends.astype("<u4").tobytes(), at[np.argsort(ids, kind="stable")].tobytes(), first.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()


class Block:
    """Looks up phrases in one row of the index."""

    def __init__(self, terms: bytes, ends: bytes, postings: bytes, first: bytes, sizes: bytes):
        self.ends = np.frombuffer(ends, "<u4").astype(np.int64)
        self.starts = np.r_[0, self.ends[:-1]] if len(self.ends) else self.ends
        self.postings = np.frombuffer(postings, "<u4").astype(np.int64)
        self.first, self.sizes = np.frombuffer(first, "<u4").astype(np.int64), np.frombuffer(sizes, "<u4").astype(np.int64)
        self.names = terms.split()

    def resolve(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """Number in this block of each test term, or -1."""
        out = np.full(len(vocabulary) + 1, -1, np.int64)  # the last is for places beyond a phrase's end
        for k, w in enumerate(self.names):
            if (v := vocabulary.get(w)) is not None:
                out[v] = k
        return out

    def _candidates(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) for each posting of each row's term."""
        n = self.ends[term] - self.starts[term]
        row = np.repeat(np.arange(len(term)), n)
        at = np.repeat(self.starts[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return row, self.postings[at]

    def _by_rarity(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of phrases whose terms all occur here, and for each the offsets of its terms from the rarest on."""
        inside = np.arange(phrases.shape[1]) < lengths[:, None]
        ok = np.flatnonzero(((phrases >= 0) | ~inside).all(1))
        counts = np.where(inside[ok], (self.ends - self.starts)[phrases[ok]] if len(self.ends) else 0, np.iinfo(np.int64).max)
        return ok, np.argsort(counts, axis=1, kind="stable")

    def exact(self, phrases: np.ndarray, lengths: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(row of phrases, position of its first word) of each occurrence. phrases: numbers of terms in this block. Rows are taken in groups with about `most` candidates."""
        ok, order = self._by_rarity(phrases, lengths)
        if not len(ok):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.repeat(np.arange(len(self.ends)), self.ends - self.starts) << 32 | self.postings
        anchor = phrases[ok, order[:, 0]]
        bounds = np.r_[0, 1 + np.flatnonzero(np.diff(np.cumsum(self.ends[anchor] - self.starts[anchor]) // most)), len(ok)]
        rows, places = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own, offs = ok[lo:hi], order[lo:hi]
            row, at = self._candidates(anchor[lo:hi])
            at = at - offs[row, 0]
            row, at = row[at >= 0], at[at >= 0]
            for j in range(1, phrases.shape[1]):
                if not len(row):
                    break
                more = j < lengths[own[row]]
                key = phrases[own[row], offs[row, j]] << 32 | (at + offs[row, j])
                found = np.searchsorted(keys, key)
                hit = keys[np.minimum(found, len(keys) - 1)] == key
                row, at = row[hit | ~more], at[hit | ~more]
            rows.append(own[row])
            places.append(at)
        return np.concatenate(rows), np.concatenate(places)

    def near(self, phrases: np.ndarray, lengths: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of phrases, position of its rarest term) where each other term of the phrase occurs, in any order, at most length - 1 + slop words from that position in the same document."""
        ok, order = self._by_rarity(phrases, lengths)
        if not len(ok):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.repeat(np.arange(len(self.ends)), self.ends - self.starts) << 32 | self.postings
        row, at = self._candidates(phrases[ok, order[:, 0]])
        doc = np.searchsorted(self.first, at, "right") - 1
        for j in range(1, phrases.shape[1]):
            more = j < lengths[ok[row]]
            reach = lengths[ok[row]] - 1 + slop
            lo, hi = np.maximum(self.first[doc], at - reach), np.minimum(self.first[doc] + self.sizes[doc] - 1, at + reach)
            term = phrases[ok[row], order[row, j]] << 32
            hit = (np.searchsorted(keys, term | hi, "right") > np.searchsorted(keys, term | lo)) | ~more
            row, at, doc = row[hit], at[hit], doc[hit]
        return ok[row], at


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """The positional index of docs: one row per block of documents, INDEX, ids (an array) and a name, written in the shared folder and read from there. Null texts have no words; rows with the same id stay apart; an empty table gives no rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        ids: list[pa.Array] = []
        held = made = 0

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in index_block(texts)), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([f"{TaskContext.get().partitionId()}-{made}"])], [*names, "ids", "block"])

        for b in batches:
            start = 0
            for i, t in enumerate(pc.fill_null(b.column(1), "").cast(pa.binary())):
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= block_bytes:
                    ids.append(b.column(0)[start : i + 1])
                    yield flush()
                    texts, ids, held, start, made = [], [], 0, i + 1, made + 1
            if start < b.num_rows:
                ids.append(b.column(0)[start:])
        if texts:
            yield flush()

    return cut_by_workers(docs.select(F.col(id_col), F.col(text_col)), "postings", run, f"{INDEX}, ids array<{kind}>, block string")


def phrases_of(items: list[tuple[str | None, str | None]], window: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """(vocabulary, windows as numbers of terms, their lengths, their items, names of items). An item shorter than a window is one; one without words has none."""
    vocabulary: dict[bytes, int] = {}
    rows: dict[tuple[tuple[int, ...], int], None] = {}
    names: dict[str | None, int] = {}
    for name, text in items:
        n = [vocabulary.setdefault(w, len(vocabulary)) for w in fold((text or "").encode())]
        of = names.setdefault(name, len(names))
        for i in range(max(1, len(n) - window + 1) if n else 0):
            rows[tuple(n[i : i + window]), of] = None
    out = np.full((len(rows), window), len(vocabulary), np.int32)
    for k, (w, _) in enumerate(rows):
        out[k, : len(w)] = w
    return vocabulary, out, np.array([len(w) for w, _ in rows], np.int64), np.array([of for _, of in rows], np.int64), list(names)


def _lookup(index: DataFrame, items: list[tuple], window: int, id_col: str) -> DataFrame:
    """Per document: the index's row and its place there, its id, n_words, n_hit, the items found (sorted) and the runs of words hit."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    sent = index.sparkSession.sparkContext.broadcast(phrases_of(items, window))  # of a bounded block of items

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, windows, lengths, item, names = sent.value
        for b in batches:
            for i in range(b.num_rows):
                block = Block(*(b.column(k)[i].as_py() for k in range(5)))
                row, at = block.exact(block.resolve(vocabulary)[windows], lengths)
                first, sizes, n = block.first, block.sizes, lengths[row]
                size = int((sizes + 1).sum())
                hit = np.cumsum(np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)) > 0
                before = np.r_[0, np.cumsum(hit)]
                steps = np.diff(np.r_[False, hit, False].astype(np.int8))
                starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
                of, doc = np.searchsorted(first, starts, "right") - 1, np.searchsorted(first, at, "right") - 1
                found: list[list[str]] = [[] for _ in range(len(first))]
                for d, k in {*zip(doc.tolist(), item[row].tolist(), strict=True)}:
                    if names[k] is not None:
                        found[d].append(names[k])
                runs = pa.StructArray.from_arrays([pa.array(starts - first[of]), pa.array(ends - first[of])], ["start", "end"])
                bounds = pa.array(np.searchsorted(of, np.arange(len(first) + 1)), pa.int32())
                columns = [[b.column("block")[i].as_py()] * len(first), np.arange(len(first)), b.column("ids")[i].values, sizes, before[first + sizes] - before[first], pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.ListArray.from_arrays(bounds, runs)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["block", "place", id_col, "n_words", "n_hit", "items", "runs"])

    return index.mapInArrow(tidied(run), f"block string, place bigint, `{id_col}` {kind}, n_words bigint, n_hit bigint, items array<string>, runs array<struct<start: bigint, end: bigint>>")


def _blocks(items: DataFrame, id_col: str, text_col: str, rows: int) -> Iterator[list[tuple]]:
    """The different test items in blocks of about `rows` items or 4 MB, each small enough for the driver and a broadcast (some 50 bytes a window)."""
    items = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()  # equal ones would meet in one block
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-n // rows), -(-size // (4 << 20)))
    for k in range(parts):
        yield [tuple(r) for r in (items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else items).collect()]


def phrase_hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", items_text_col: str | None = None, window: int = WINDOW, query_rows: int = _QUERY_ROWS) -> DataFrame:
    """Per document: its id, n_words, n_hit (words inside an occurrence of a window), items (ids of items with occurring windows, sorted as strings) and runs (the runs of words hit: start, end exclusive).

    A window is `window` consecutive words of an item; a shorter item, but not an empty one, is one window. Null texts have no words. Items with a null id count for n_hit but aren't listed; repeated items count once. Repeated documents get a row each; empty tables give no rows or no hits. Items are looked up in blocks, so their table may be of any size.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col)
    found = [_lookup(index, x, window, id_col) for x in _blocks(items, item_col, items_text_col or text_col, query_rows)]
    if len(found) == 1:
        return found[0].drop("block", "place")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("runs"))),
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda out, r: F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= r["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.get(out, F.size(out) - 1)["start"].alias("start"), F.greatest(F.get(out, F.size(out) - 1)["end"], r["end"]).alias("end"))))).otherwise(F.concat(out, F.array(r))),
    )
    every = every.groupBy("block", "place").agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), merged.alias("runs"))
    return every.select(id_col, "n_words", F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_hit"), "items", "runs")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """phrase_hits() with n_items, items_sha256 (of the ids, comma-joined) and contaminated: at least one word hit, and at least a twentieth of the document's words."""
    out = phrase_hits(docs, items, **options)
    return out.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def proximity_hits(docs: DataFrame, phrases: list[str], slop: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phrase, at) for each occurrence (place in words) of a phrase's rarest term in a document around which all its other terms occur, in any order, at most len - 1 + slop words away. phrases: a short list of queries; those without words match nothing."""
    index = build_index(docs, id_col=id_col, text_col=text_col)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    longest = max([1, *(len(fold(p.encode())) for p in phrases)])
    sent = index.sparkSession.sparkContext.broadcast(phrases_of([(p, p) for p in phrases], longest))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, windows, lengths, item, names = sent.value
        for b in batches:
            for i in range(b.num_rows):
                block = Block(*(b.column(k)[i].as_py() for k in range(5)))
                row, at = block.near(block.resolve(vocabulary)[windows], lengths, slop)
                doc = np.searchsorted(block.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values.take(pa.array(doc)), pa.array([names[k] for k in item[row]], pa.string()), pa.array(at - block.first[doc])], [id_col, "phrase", "at"])

    return index.mapInArrow(tidied(run), f"`{id_col}` {kind}, phrase string, at bigint")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns. Rows are told apart by id and text (its 64-bit hash): a row with a null id goes if its text is contaminated, and a clean one stays whatever other rows have its id."""
    own, digest = F.col(id_col), F.xxhash64(F.col(text_col))
    key = F.struct(own.alias("id"), digest.alias("h"))
    found = decontaminate(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, id_col="key", text_col="text", items_text_col=text_col, **options)
    bad_id, bad_hash = unused(docs, "bad_id", "bad_hash")
    bad = cut(found.filter("contaminated").select(F.col("key.id").alias(bad_id), F.col("key.h").alias(bad_hash)).distinct(), "contaminated")
    few = bad.count() <= broadcast_ids  # counted
    return docs.join(F.broadcast(bad) if few else bad, own.eqNullSafe(F.col(bad_id)) & (digest == F.col(bad_hash)), "left_anti")
