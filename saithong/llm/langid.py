"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

A text is cut into windows; the network reads each in both directions, labels every byte, and the document's probabilities are the mean over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saithong.llm.common import by_bytes, tidied

UNKNOWN = "und"
HIDDEN = 8
WINDOW = 128  # bytes that the network reads at a time
#: Training: labelled rows of each language (the first in order of a hash), their bytes in all (whole texts only), languages, and passes over all windows.
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE, LANGUAGES, EPOCHS = 64, 2 << 20, 1000, 5
_BATCH = 64
_LANES = 1024  # windows read side by side when predicting


@dataclass
class Network:
    """Per direction: table [256, 3H] (a byte's input to the update, reset and candidate gates, with their biases), u [H, 2H], c [H, H]; out [2H, L] and bias [L]."""

    languages: list[str]
    tables: list[np.ndarray]
    u: list[np.ndarray]
    c: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.tables, *self.u, *self.c, self.out, self.bias]


def start(languages: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    tables = [(rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32) for _ in range(2)]
    return Network(languages, tables, [draw(hidden, 2 * hidden) for _ in range(2)], [draw(hidden, hidden) for _ in range(2)], draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _read(net: Network, d: int, bytes_: np.ndarray, inside: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """States [T, B, H] of direction d over bytes [T, B]; outside of the texts (where inside [T, B] is 0) they stay zero. keep gets what backpropagation needs."""
    steps, lanes = bytes_.shape
    h = np.zeros((lanes, net.c[d].shape[0]), np.float32)
    n = h.shape[1]
    states = np.empty((steps, lanes, n), np.float32)
    table, u, c = net.tables[d], net.u[d], net.c[d]
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        x = table[bytes_[t]]
        gates = h @ u
        gates += x[:, : 2 * n]
        _sigmoid(gates)
        z, r = gates[:, :n], gates[:, n:]
        rh = r * h
        a = rh @ c
        a += x[:, 2 * n :]
        np.tanh(a, out=a)
        if keep is not None:
            keep.append((t, h, z, r, rh, a))
        new = a - h
        new *= z
        new += h
        if inside is not None:
            new *= inside[t][:, None]
        h = new
        states[t] = h
    return states


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def probabilities(net: Network, bytes_: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """[T, B, L]: the label of every position."""
    n = net.c[0].shape[0]
    logits = _read(net, 0, bytes_) @ net.out[:n]  # it comes to the end last
    logits += _read(net, 1, bytes_, inside) @ net.out[n:]
    logits += net.bias
    return _softmax(logits)


def gradients(net: Network, bytes_: np.ndarray, labels: np.ndarray, inside: np.ndarray, share: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the labels [B] at the positions inside [T, B] (each weighed by the share of its lane), and its gradients by backpropagation through time."""
    steps, lanes = bytes_.shape
    n = net.c[0].shape[0]
    kept: list[list] = [[], []]
    states = [_read(net, d, bytes_, inside, kept[d]) for d in (0, 1)]
    p = _softmax(states[0] @ net.out[:n] + states[1] @ net.out[n:] + net.bias)
    weight = inside if share is None else inside * share
    weight = weight / weight.sum()
    each = np.arange(lanes)
    loss = -float((np.log(p[:, each, labels] + 1e-12) * weight).sum())
    p[:, each, labels] -= 1
    p *= weight[:, :, None]
    d_out = np.concatenate([np.einsum("tbh,tbl->hl", states[d], p) for d in (0, 1)])
    g_tables, g_u, g_c = [], [], []
    for d in (0, 1):
        above = p @ net.out[d * n : (d + 1) * n].T
        table, u, c = np.zeros_like(net.tables[d]), np.zeros_like(net.u[d]), np.zeros_like(net.c[d])
        dh = np.zeros((lanes, n), np.float32)
        for t, h, z, r, rh, a in reversed(kept[d]):
            dh = (dh + above[t]) * inside[t][:, None]
            da = dh * z * (1 - a * a)
            drh = da @ net.c[d].T
            gates = np.concatenate([dh * (a - h) * z * (1 - z), drh * h * r * (1 - r)], 1)
            c += rh.T @ da
            u += h.T @ gates
            np.add.at(table, bytes_[t], np.concatenate([gates, da], 1))
            dh = dh * (1 - z) + drh * r + gates @ net.u[d].T
        g_tables.append(table)
        g_u.append(u)
        g_c.append(c)
    return loss, [*g_tables, *g_u, *g_c, d_out, p.sum((0, 1))]


def windows_of(text: bytes, window: int = WINDOW) -> list[bytes]:
    return [text[i : i + window] for i in range(0, len(text), window)]


def _lanes(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes [T, B], positions inside [T, B])."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.frombuffer(b"".join(p.ljust(window, b" ") for p in pieces), np.uint8).reshape(len(pieces), window)
    return np.ascontiguousarray(flat.T), np.arange(window)[:, None] < sizes


def fit(rows: list[tuple[str, str]], *, hidden: int = HIDDEN, window: int = WINDOW, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Trains on (text, language) rows by Adam: on all windows of all texts, each language with the same weight. Without usable rows there is no network."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[bytes]] = {}
    for text, language in sorted(rows):
        by.setdefault(language, []).extend(w for w in windows_of(text.encode(), window) if len(w) >= 8)
    languages = sorted(k for k, v in by.items() if v)
    if not languages:
        return None
    pieces = [w for k in languages for w in by[k]]
    labels = [i for i, k in enumerate(languages) for _ in by[k]]
    weights = np.array([len(pieces) / (len(languages) * len(by[k])) for k in languages], np.float32)
    all_labels = np.array(labels)
    net = start(languages, hidden, seed)
    params = net.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, total = 0, epochs * -(-len(pieces) // _BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for at in range(0, len(order), _BATCH):
            own = order[at : at + _BATCH]
            data, inside = _lanes([pieces[j] for j in own], window)
            # A window may stand for a short text: some lose their end.
            inside = inside & (np.arange(window)[:, None] < np.where(rng.random(len(own)) < 0.3, rng.integers(8, window + 1, len(own)), window))
            data = np.where(inside, data, 32).astype(np.uint8)
            _, grads = gradients(net, data, all_labels[own], inside.astype(np.float32), weights[all_labels[own]])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            now = rate * min(1.0, 2 * (1 - step / total) + 0.02)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: Network, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """[texts, L]: probabilities of each text, the mean over the labels of all its bytes. Empty texts get zeros."""
    out = np.zeros((len(texts), len(net.languages)))
    pieces: list[bytes] = []
    of: list[int] = []
    for i, t in enumerate(texts):
        w = windows_of(t, window)
        pieces += w
        of += [i] * len(w)
    owner = np.array(of, np.int64)
    for at in range(0, len(pieces), _LANES):
        data, inside = _lanes(pieces[at : at + _LANES], window)
        p = probabilities(net, data, inside)
        p *= inside[:, :, None]
        np.add.at(out, owner[at : at + _LANES], p.sum(0))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return out / np.maximum(sizes, 1)[:, None]


def training_rows(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int = ROWS_PER_LANGUAGE, most_bytes: int = BYTES_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most per_language labelled rows of each language, the first in order of a hash of id and text, as long as their whole texts make up at most most_bytes; longer texts aren't learned from. Hashes and sizes alone are ranked; then the rows up to the last hash are fetched, ranked again, as rows alike have the same hash. More than LANGUAGES languages are an error."""
    size = F.octet_length(text_col)
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (size <= most_bytes))
    rows = labelled.select(F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), size.alias("size"), F.col(text_col).alias("t"))
    by_hash = Window.partitionBy("l").orderBy("h", "t")

    def first(df: DataFrame, order) -> DataFrame:
        ranked = df.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language)
        return ranked.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("sum") <= most_bytes)

    last = first(rows.select("l", "h", "size"), Window.partitionBy("l").orderBy("h", "size")).groupBy("l").agg(F.max("h").alias("last")).withColumnRenamed("l", "of")
    if (n := last.count()) > LANGUAGES:
        raise ValueError(f"{n} languages; at most {LANGUAGES} can be learned")
    chosen = first(rows.join(F.broadcast(last), (F.col("l") == F.col("of")) & (F.col("h") <= F.col("last"))).select("l", "h", "size", "t"), by_hash)  # a row a language, at most LANGUAGES
    return [(r[0], r[1]) for r in chosen.select("t", "l").collect()]


def identify(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), per_language: int = ROWS_PER_LANGUAGE, hidden: int = HIDDEN) -> DataFrame:
    """Per row of docs: its id, the columns in keep, lang_pred (a language of the training rows) and score (its pooled probability, 0 to 1).

    training: labelled rows, of which at most per_language a language, and BYTES_PER_LANGUAGE bytes of them, are learned from. Prediction sees texts alone, every byte of them. A null text or one without a letter is `und` with score 0, as is every text if nothing could be learned. Ties go to the first language in order. Repeated rows and null ids give a row each; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    net = fit(training_rows(training, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language), hidden=hidden)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(id_col), F.col(text_col), *(F.col(k) for k in keep))
    kept = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Network | None = sent.value
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
            names: list[str] = []
            scores: list[float] = []
            raw = texts.cast(pa.binary())
            for s, e in by_bytes(raw, 1 << 20):
                if model is None:
                    names += [UNKNOWN] * (e - s)
                    scores += [0.0] * (e - s)
                    continue
                p = label(model, [t if ok else b"" for t, ok in zip(raw[s:e].to_pylist(), lettered[s:e], strict=True)])
                best = p.argmax(1)
                names += [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered[s:e], strict=True)]
                scores += np.clip(p[np.arange(len(p)), best], 0, 1).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(2 + k) for k in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, *keep, "lang_pred", "score"])

    return rows.mapInArrow(tidied(run), f"`{id_col}` {kind}, {kept}lang_pred string, score double")
