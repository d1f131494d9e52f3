"""Each operator against a brute-force version on small fixtures with the hard cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "über", "señal", "x1", "Ω", "don't"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, id string, n string"


def make_rows(n=60, seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(n - 12)]
    texts += [None, "", "   \n\t", "one", "one two", texts[0], texts[0] + " beta", "a" * 3000, "word " * 5000, "é\x0bx\x1cy z", "<|endoftext|> a <|ENDOFTEXT|>. B,", "THE The the"]
    return [(i, t, rng.choice(["en", "de"]), rng.choice(["s1", "s2", None]), 0 if t is None else len(t), "clash", "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = make_rows()
    return spark.createDataFrame([*rows, rows[4]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mix_fills_to_targets(spark, docs, empty):
    from saithong.llm.mixing import mix

    rows = mix(docs).collect()
    again = mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:  # the plain loop: clamp, reshare
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and rest * weight[s] / w > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        own = [r for r in rows if r.source == s]
        target = 3 * sizes[s] if s in capped else rest * weight[s] / w
        assert own[0].target == pytest.approx(target)
        assert sum(r.taken for r in own) == math.floor(own[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert mix(empty).collect() == []


def test_mix_caps_and_reshares(spark):
    from saithong.llm.mixing import by_rank, water_fill

    src = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 0)], "source string, source_size bigint")
    t = {r.source: r.target for r in water_fill(by_rank(src)).collect()}
    assert t["b"] == 30 and t["c"] == 30 and t["d"] == 0 and t["a"] == pytest.approx(960)


def test_mixed_documents_repeat_rows(spark, docs):
    from saithong.llm.mixing import mix, mixed_documents

    out = mixed_documents(docs, length_col="n_chars")
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == mix(docs).agg(F.sum("taken")).first()[0]


def test_quality_counts(spark, docs, empty):
    from saithong.llm.quality import keep_good, quality

    extra = [(900, "\n".join(["same line here now ok"] * 5 + ["", " "]), None, None, 0, "", "", ""), (901, "a b c d e f a b c d e f g", None, None, 0, "", "", ""), (902, "#### $$$ %% && ||" * 9, None, None, 0, "", "", "")]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {}
    for r in quality(both).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in both.collect():
        t, w = r.text or "", words(r.text)
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        for g in got[r.doc_id]:
            assert (g.n_words, g.word_chars, g.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
            assert g.n_dup_lines == len(lines) - len(set(lines)) and g.n_repeat_words == len(hit)
            assert g.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (g.base_failed and g.kept)
    good = sorted(r.doc_id for r in keep_good(both).collect())
    assert good == sorted(r.doc_id for rs in got.values() for r in rs if r.kept)
    assert 902 not in good
    assert quality(empty).collect() == []


def test_cascade_orders_by_rejection_per_cost(spark):
    from saithong.llm.quality import Rule, cascade, ordered_rules

    df = spark.range(100)
    rules = [Rule("dear", F.col("id") < 50, 100.0), Rule("cheap", F.col("id") < 10, 1.0), Rule("never", F.lit(False), 0.1)]
    assert [r.name for r, _, _ in ordered_rules(df, rules)] == ["cheap", "dear", "never"]
    boom = Rule("boom", F.raise_error(F.lit("evaluated")).isNotNull())
    assert df.select(cascade([Rule("all", F.lit(True)), boom]).alias("c")).distinct().first().c == "all"
    # Measured: as many rows go, but one rule counts to 200,000 for each.
    long = F.aggregate(F.sequence(F.lit(0), F.lit(200_000)), F.col("id"), lambda a, x: a + x % 7) < 0
    found = ordered_rules(df, [Rule("slow", (F.col("id") < 50) | long), Rule("fast", F.col("id") < 50)])
    assert [r.name for r, _, _ in found] == ["fast", "slow"] and found[1][1] > 1e-4 and [s for _, _, s in found] == [0.5, 0.5]
    assert [s for _, _, s in ordered_rules(df.limit(0), rules)] == [0.0] * 3


def test_sample_is_from_the_whole_table(spark):
    from saithong.llm.quality import hashed_sample

    df = spark.range(0, 20_000, 1, 8)
    got = hashed_sample(df, 1000, "id")
    assert 800 < got.count() < 1200 and got.select(F.spark_partition_id()).distinct().count() == 8


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


def test_token_shards_round_trip(spark, docs, empty):
    from saithong.llm.repair import encode_documents

    path, tok = tokenizer("word_bpe_49k.json")
    got = encode_documents(docs, path).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    at = 0
    import numpy as np

    for g, r in zip(got, rows, strict=True):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert encode_documents(empty, path).collect() == []


def test_grammar_decodes_at_random_places():
    import numpy as np

    from saithong.llm.repair import Shard, _shard

    rng = np.random.default_rng(5)
    phrase = rng.integers(0, 50, 40)
    sizes = rng.integers(1, 300, 50)
    ids = np.concatenate([np.tile(phrase, 8)[:n] if k % 2 else rng.integers(0, 50, n) for k, n in enumerate(sizes)]).astype(np.uint32)
    row = _shard(0, 0, [ids], [sizes], 50)
    shard = Shard(dict(zip("part shard n_ids width n_tokens rules lengths symbols doc_sizes doc_symbols".split(), row, strict=True)))
    assert len(shard.symbols) < len(ids) and (shard.all() == ids).all()
    ends = np.cumsum(sizes)
    assert all((shard.doc(k) == ids[e - n : e]).all() for k, (e, n) in enumerate(zip(ends, sizes, strict=True)))
    assert all((shard.span(a, a + 70) == ids[a : a + 70]).all() for a in range(0, len(ids) - 70, 331))
    for a in range(1, 5):  # runs of one id overlap with themselves
        row = _shard(0, 0, [np.full(100 + a, 7, np.uint32)], [np.array([100 + a])], 50)
        assert (Shard(dict(zip("part shard n_ids width n_tokens rules lengths symbols doc_sizes doc_symbols".split(), row, strict=True))).all() == 7).all()


FOLD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return FOLD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contamination(docs, items):
    windows = []
    for name, t in items:
        w = fold(t)
        windows += [(name, w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w else []
    for d, t in docs:
        w, hit, found = fold(t), set(), set()
        for name, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    if name is not None:
                        found.add(str(name))
        ids = sorted(found)
        yield d, (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("query_rows", [20_000, 3])
def test_decontamination(spark, docs, empty, query_rows):
    from saithong.llm.decontam import decontaminate, drop_contaminated

    rng = random.Random(9)
    long = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(6)]
    items = [(1, long[0]), (2, long[1]), (2, long[1]), (10, "x1 OMEGA"), (3, None), (4, "..."), (None, long[2]), (5, "alpha beta")]
    texts = [(200, "pre " + long[0] + " post"), (201, " ".join(long[1].split()[5:20]).upper().replace(" ", "-")), (202, long[2]), (203, "alpha\nBETA!"), (204, "alpha"), (205, "filler " * 3000 + long[0]), (206, long[1].replace(" ", " , ") + " " + long[0])]
    both = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*t, "") for t in texts], "doc_id bigint, text string, n string"))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in decontaminate(both, b, query_rows=query_rows).collect())
    expected = sorted(brute_contamination([(r.doc_id, r.text) for r in both.collect()], items))
    assert got == expected
    kept = sorted(r.doc_id for r in drop_contaminated(both, b).collect())
    assert kept == [d for d, x in expected if not x[-1]]
    assert decontaminate(empty, b).collect() == []
    assert not any(r.contaminated for r in decontaminate(both, b.limit(0)).collect())


def test_proximity(spark):
    from saithong.llm.decontam import proximity_hits

    df = spark.createDataFrame([(1, "a b x c"), (2, "c a y y y y b"), (3, "a b"), (4, None)], "doc_id int, text string")
    hits = {(r.doc_id, r.phrase) for r in proximity_hits(df, ["a b c", "zzz"], slop=1).collect()}
    assert hits == {(1, "a b c")}


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words(t)]
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    label[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(spark, docs, empty, block, monkeypatch):
    from saithong.llm import hyperminhash as H

    monkeypatch.setattr(H, "_BLOCK", block)
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(45):  # a group whose members drift apart: some linked with few others only
        w = list(base)
        for _ in range(rng.randint(1, 22)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    rows = [(300 + i, t) for i, t in enumerate(texts)]
    both = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*r, "") for r in rows], "doc_id bigint, text string, n string"))
    expected = brute_components([(r.doc_id, r.text) for r in both.collect()], 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in H.near_duplicates(both, shingle=2).collect()}
    assert got == expected
    assert len({c for d, (_, c) in expected.items() if d >= 300}) > 2
    kept = [r.doc_id for r in H.keep_one(both, shingle=2).collect()]
    assert sorted(kept) == sorted(d for d, (_, c) in expected.items() if c == d)
    assert H.near_duplicates(empty).collect() == []


def test_registers_survive_edges():
    import numpy as np

    from saithong.llm.hyperminhash import band_keys, estimate, filled, registers

    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.r_[a[:4500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(estimate(registers(a), registers(b), len(a), len(b)) - j) < 0.15
    for s in (a[:0], a[:1], np.array([0, 1, (1 << 64) - 1], np.uint64)):
        assert filled(registers(s)).shape == (256,)
    assert (band_keys(filled(registers(a[:3]))[None]) == band_keys(filled(registers(a[:3]))[None])).all()


class BruteTree:
    """The suffix tree in dictionaries, from its definition."""

    def __init__(self, texts, depth, back, gain):
        self.depth, self.back, self.count, self.total = depth, back, Counter(), Counter()
        for t in texts:
            seq = ["<>", *self.tokens(t)]
            for i in range(1, len(seq)):
                for k in range(min(i, depth) + 1):
                    self.count[tuple(seq[i - k : i + 1])] += 1
                    self.total[tuple(seq[i - k : i])] += 1
        self.n, self.vocabulary = self.total[()], {g[0] for g in self.count if len(g) == 1}
        following = {}
        for g, n in self.count.items():
            following.setdefault(g[:-1], []).append((g[-1], n))
        self.kept = set()
        for ctx, n in self.total.items():
            if ctx and n >= 2:
                nats = sum(k * math.log((k - 1 + back * self.p(ctx[1:], w)) / (n - 1 + back) / self.p(ctx[1:], w)) for w, k in following[ctx])
                if nats > gain:
                    self.kept.add(ctx)

    @staticmethod
    def tokens(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + ["\n"]

    def p(self, ctx, w):
        if not ctx:
            return (self.count[(w,)] + 0.1) / (self.n + 0.1 * (len(self.vocabulary) + 1))
        return (self.count[(*ctx, w)] + self.back * self.p(ctx[1:], w)) / (self.total[ctx] + self.back)

    def state(self, seq):
        return next((c for k in range(self.depth, 0, -1) if len(c := tuple(seq[-k:])) == k and c in self.kept), ())

    def score(self, t):
        seq = ["<>", *self.tokens(t)]
        return sum(math.log10(self.p(self.state(seq[:i]), seq[i])) for i in range(1, len(seq)))


def test_suffix_tree_is_the_brute_force_one(spark, docs, empty, monkeypatch):
    from saithong.llm import suffix_tree as T

    monkeypatch.setattr(T, "_SLICE", 3000)  # several buckets
    held = F.col("doc_id") % 5 == 0
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in _zipf_rows()], "doc_id bigint, text string")).repartition(3).cache()
    rows = both.collect()
    for depth, back in ((4, 4.0), (2, 30.0)):
        tree = BruteTree([r.text for r in rows if r.doc_id % 5], depth, back, 1.0)
        got = T.corpus_scores(both, ~held, extra={"held_out": held}, depth=depth, back=back, gain=1.0).collect()
        assert {len(c) for c in tree.kept} == set(range(1, depth + 1))
        toks = BruteTree.tokens
        expected = sorted((r.doc_id, r.doc_id % 5 == 0, len(toks(r.text)), sum(w in tree.vocabulary for w in toks(r.text)), tree.n) for r in rows)
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == expected
        texts = {r.doc_id: r.text for r in rows}
        for r in got:
            assert r.base_score == pytest.approx(sum(math.log10(tree.p((), w)) for w in toks(texts[r.doc_id])), rel=1e-9)
            assert r.score == pytest.approx(tree.score(texts[r.doc_id]), rel=1e-9)
            assert r.gain_per_token == pytest.approx((r.score - r.base_score) / r.n_tokens)
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
        unknown = 0.1 / (tree.n + 0.1 * (len(tree.vocabulary) + 1))
        for ctx in list(tree.kept)[:50]:  # a distribution: with the place of the words that training lacks it sums to one
            rest = unknown
            for k in range(len(ctx), 0, -1):
                rest *= back / (tree.total[ctx[len(ctx) - k :]] + back)
            assert sum(tree.p(ctx, w) for w in tree.vocabulary) + rest == pytest.approx(1)
    assert T.corpus_scores(empty, ~held).collect() == []
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score for r in T.corpus_scores(docs, F.lit(False)).collect())


def _zipf_rows(seed=11, n=400):
    """Texts in which one word stands before many rare ones, and pairs of words belong together."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        w = []
        for _ in range(60):
            k = rng.randint(0, 9)
            if k < 4:
                w += ["the", f"r{int(rng.paretovariate(0.6)) % 4000}"]
            elif k < 8:
                a = rng.randint(0, 30)
                w += [f"a{a}", f"b{a}", f"c{(a + rng.randint(0, 1)) % 31}"]
            else:
                w.append(f"r{rng.randint(0, 4000)}")
        made.append((i, " ".join(w)))
    return made


def test_suffix_tree_query_learns_rare_pairs(spark, tmp_path):
    from saithong.llm.queries import op3_suffix_tree_scores

    # A pair that occurs at most 10 times among more than 5 million tokens is less than 2e-6 of them, and still is learned.
    rows = [(i, "x y " * 32_000) for i in range(100)] + [(100 + i, "rare pair") for i in range(10)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_suffix_tree_scores(spark, str(tmp_path)).filter("doc_id >= 100").collect()
    assert all(r.score > r.base_score + 3 for r in got)


def test_language_id(spark, empty):
    from saithong.llm.langid import identify

    rng = random.Random(4)
    vocab = {"aa": ["kala", "moko", "takapa"], "bb": ["schirz", "wrent", "zwulf"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(40)), k, "clash") for i in range(120) for k in [rng.choice(list(vocab))]]
    df = spark.createDataFrame([*rows, (500, None, "aa", ""), (501, "12 34", None, ""), (502, "", "bb", "")], "doc_id int, text string, lang string, score string")
    got = identify(df, df.filter("doc_id % 4 <> 2 and doc_id < 500"), per_language=40)
    got = {r.doc_id: r for r in got.collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k, _ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert {r.lang_pred for r in identify(df.select("doc_id", "text"), df.limit(0)).collect()} == {"und"}
    assert identify(empty, df).collect() == []


def test_gradients_by_differences():
    import numpy as np

    from saithong.llm import langid as L

    rng = np.random.default_rng(0)
    net = L.start(["a", "b", "c"], 4, 1)
    net.tables, net.u, net.c = ([x.astype(np.float64) for x in p] for p in (net.tables, net.u, net.c))
    net.out = net.out.astype(np.float64)
    data, labels, inside = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((7, 5), np.float32)
    inside[4:, 1] = inside[6:, 3] = 0  # shorter texts: what is behind their ends has no part in anything
    _, grads = L.gradients(net, data, labels, inside)
    for p, g in zip(net.params(), grads, strict=True):
        i = (int(data[3, 2]), 1) if p.shape[0] == 256 else tuple(int(rng.integers(0, k)) for k in p.shape)
        old = p[i]
        p[i] = old + 1e-3
        up = L.gradients(net, data, labels, inside)[0]
        p[i] = old - 1e-3
        down = L.gradients(net, data, labels, inside)[0]
        p[i] = old
        assert (up - down) / 2e-3 == pytest.approx(float(g[i]), abs=2e-5)


def test_padding_changes_nothing():
    import numpy as np

    from saithong.llm import langid as L

    net = L.start(["a", "b"], 4, 1)
    text = b"short text"
    assert np.allclose(L.label(net, [text], 128), L.label(net, [text], len(text)), atol=1e-6)


def test_training_rows_are_bounded(spark):
    from saithong.llm.langid import training_rows

    rows = [(None, f"text number {i}", "aa") for i in range(300)] + [(7, "the same", "bb")] * 300 + [(i, "x" * 5000, "cc") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(4)
    got = Counter(lang for _, lang in training_rows(df, id_col="doc_id", text_col="text", lang_col="lang", per_language=20, most_bytes=21_000))
    assert got == {"aa": 20, "bb": 20, "cc": 4}


def test_rows_are_told_apart_by_id_and_text(spark):
    from saithong.llm.decontam import drop_contaminated
    from saithong.llm.hyperminhash import keep_one
    from saithong.llm.linededup import drop_repeated_lines

    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    passage, clean, other, third = text(20), text(60), text(60), text(60)
    rows = [(None, passage, "n1"), (None, clean, "n2"), (5, passage + " x", "p"), (5, other, "q"), (6, third, "r"), (6, third, "r"), (7, other + " y", "s"), (8, None, "t"), (None, None, "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, own_key string").withColumn("bad_id", F.lit("x")).withColumn("Line_Doc", F.lit(1)).repartition(3)
    items = spark.createDataFrame([("i", passage), ("i", passage), ("j", None)], "item_id string, text string")
    marks = lambda d: sorted(r.own_key for r in d.collect())
    kept = drop_contaminated(df, items)
    assert kept.columns == df.columns and marks(kept) == ["n2", "q", "r", "r", "s", "t", "u"]
    kept = drop_contaminated(df, items, broadcast_ids=0)
    assert marks(kept) == ["n2", "q", "r", "r", "s", "t", "u"]
    kept = keep_one(df)
    # n1 and p are near, and p has an id; q (5) and s (7) are; of r one stays.
    assert kept.columns == df.columns and marks(kept) == ["n2", "p", "q", "r", "t", "u"]
    lines = spark.createDataFrame([(None, "line of a text\nthe other one", "a"), (1, "line of a text\nnew line here", "b"), (1, "the other one\nyet another line", "c")], "doc_id bigint, text string, own_doc string")
    got = {r.own_doc: r.text for r in drop_repeated_lines(lines).collect()}
    assert got == {"a": "line of a text\nthe other one", "b": "new line here", "c": "yet another line"}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_line_dedup(spark, docs, empty):
    from saithong.llm.linededup import drop_repeated_lines, line_summary

    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(24, 50))).strip().ljust(24, "z") for _ in range(12)]

    def change(s, k):
        s = list(s)
        for _ in range(k):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], ["q"], [s[p], "é"]])
        return "".join(s)

    texts = ["\n".join(change(rng.choice(base), rng.randint(0, 3)) for _ in range(4)) for _ in range(25)] + [None, "", "\n \n", "short\nshort\nshorz", "eight ch\neight cx\neight xx", "Share on Facebook\nShare on Facebook!\nShare on Facebooked", "x" * 40000 + "y", "x" * 40000 + "z", base[0] + "\n" + base[0]]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, n_lines string").repartition(3)
    occ = {}
    for i, t in enumerate(texts):
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                occ.setdefault(x, []).append((i, p))
    lines = list(occ)
    near = [(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :] if abs(len(a) - len(b)) <= 2 and (a[:30000] == b[:30000] and len(a) > 30000 or len(a) < 30000 and edit(a, b) <= min(2, len(a) // 8, len(b) // 8))]
    label = {x: x for x in lines}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in near:
        label[top(a)] = top(b)
    first = {}
    for x, o in occ.items():
        first[top(x)] = min(first.get(top(x), o[0]), o[0])
    expected = {i: [0, 0, 0, 0] for i in range(len(texts))}
    for x, o in occ.items():
        for q in o:
            e = expected[q[0]]
            e[0] += 1
            e[3] += sum(x in p for p in near)
            if q != first[top(x)]:
                e[1 if q != o[0] else 2] += 1
    got = {r.doc_id: [r.n_lines, r.n_equal, r.n_near, r.n_links] for r in line_summary(df).collect()}
    assert got == expected
    assert sum(e[2] for e in expected.values()) > 0
    out = {r.doc_id: r.text for r in drop_repeated_lines(df).collect()}
    assert out[33] == base[0] or base[0] not in (out[33] or "")
    assert all(sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (out[i] or "").split("\n")) == e[0] - e[1] - e[2] for i, e in expected.items())
    assert line_summary(empty).collect() == []


def test_mix_keeps_clashing_columns(spark):
    from saithong.llm.mixing import mixed_documents

    rows = [(i, f"one two three {i}", f"s{i % 3}", i, -i, "t", 7) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, _size int, _h int, _text string, c0 int")
    got = mixed_documents(df)
    assert got.columns == df.columns and all(r._h == -r._size and r._text == "t" and r.c0 == 7 for r in got.collect())


def test_links_of_many_documents(spark):
    """Recall of links near the threshold: groups of texts that share little more than four fifths with each other."""
    from saithong.llm.hyperminhash import near_duplicates

    rng = random.Random(12)
    texts = []
    for _ in range(300):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 300))]
        for _ in range(5):
            w = list(base)
            for at in rng.sample(range(len(w)), max(1, len(w) // 32)):
                w[at] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    sets = [frozenset(zip(w, w[1:])) for w in map(str.split, texts)]
    label = list(range(len(texts)))
    links = 0
    for g in range(0, len(texts), 5):  # texts of different groups share nothing
        for i in range(g, g + 5):
            for j in range(i + 1, g + 5):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    links += 1
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label[g : g + 5] = [new if x == old else x for x in label[g : g + 5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, shingle=2, percent=80).collect()}
    assert links > 1000 and got == dict(enumerate(label))


def test_marks_bound_edits(spark):
    from saithong.llm.linededup import marks

    rng = random.Random(6)
    rows = []
    for _ in range(300):
        a = [rng.choice("abcdé ") for _ in range(rng.randint(2, 60))]
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], ["x"], [b[at], "y"]])
            b = b or ["z"]
        rows.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select(marks(F.col("a")).alias("x"), marks(F.col("b")).alias("y")).collect()
    assert all(sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(r.x, r.y, strict=True)) <= 8 for r in got)
    assert len({tuple(r.x) for r in got}) > 250


def test_lines_of_one_template(spark):
    import time

    from saithong.llm.linededup import line_classes

    rng = random.Random(8)
    lines = ["A common opening of some lines in a template, number " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(4000)]
    lines += [lines[7] + "s", lines[7][:-1] + "?"]
    seconds = []
    for n in (1000, 4000):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(lines[:n] + lines[4000:])], "doc_id int, text string").repartition(4).cache()
        df.count()
        start = time.perf_counter()
        linked = {r.doc for r in line_classes(df).filter("links > 0").collect()}
        seconds.append(time.perf_counter() - start)
        assert linked == {7, n, n + 1}
    assert seconds[1] < 4 * seconds[0]


def test_edit_distance_bit_parallel(spark):
    from saithong.llm.linededup import within

    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 45)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice([[], ["a"], ["x"]])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 4):
        assert all(r.w == (edit(r.a, r.b) <= k) for r in df.select("a", "b", within(F.col("a"), F.col("b"), k).alias("w")).collect())


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(s[::2] + [x * 2 - 9 * (x > 4) for x in s[1::2]]) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    out += [(m.start(), 3, f"phone:{m.start()}:{m.end()}") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [x for _, _, x in sorted(out)]


def test_personal_data(spark, docs, empty):
    from saithong.llm.pii import personal_data

    texts = ["a@b.c d@e@f.g x..y@z-1.co.", "1.2.3.4 1.2.3.4.5 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 0", "+1 (650) 253-0000, +49 30 1", "IBAN DE89 3704 0044 0532 0130 00 here", "my ssn: 123-45-6789", "code 123-45-6789", "é ü a@b.de 😀 x@y.zz", "@a.b @", None]
    both = docs.select("doc_id", "text", "id").unionByName(spark.createDataFrame([(600 + i, t, "") for i, t in enumerate(texts)], "doc_id bigint, text string, id string"))
    text = {r.doc_id: r.text or "" for r in both.collect()}
    got = {r.doc_id: r for r in personal_data(both).collect()}
    for d, t in text.items():
        base = base_spans(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert set(base) <= set(got[d].spans.split(",") if got[d].spans else [])
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]
    assert "iban:5:32" in got[604].spans and "ssn" in got[605].spans and "ssn" not in got[606].spans
    assert personal_data(empty).collect() == []


def test_token_counts(spark, docs, empty):
    from saithong.llm.token_count import token_counts

    path, tok = tokenizer("byte_bpe_50k.json")
    hard = ["a  b", " a", "a ", "a\n b\n\n c", "x <|endoftext|> y", "a\x1c b", "a  b", "don't  'll 've", "1 2 　 3"]
    both = docs.select("doc_id", "text", "n_tokens").unionByName(spark.createDataFrame([(700 + i, t, "") for i, t in enumerate(hard)], "doc_id bigint, text string, n_tokens string"))
    expected = sorted((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect())
    got = token_counts(both, path).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts(empty, path).collect() == []


def test_token_counts_of_pieces(spark, docs):
    import public_tokenizers
    import sentencepiece

    from saithong.llm.token_count import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert all(r.n_tokens == len(model.encode(r.text or "")) for r in token_counts(docs.limit(20), path).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect())


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, seen = docs.count(), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append((name, out.count()))
        if name == "quality_rules":
            good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").join(docs.filter("size(split(text, ' ')) > 30"), "doc_id")
            assert good.join(out, "doc_id", "left_anti").count() <= 0.05 * good.count()
        if name == "near_dedup":
            expected = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(d for d, (_, c) in expected.items() if c == d)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            expected = dict(brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items))
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(d for d, x in expected.items() if not x[-1])
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and 0 < seen[0][1] < n
    assert P.run(spark, SF).count() == seen[-1][1]


def test_components(spark):
    from saithong.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    random.Random(0).shuffle(chain)
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_grammar_of_many_ids():
    import numpy as np

    from saithong.llm.repair import Shard, _shard

    rng = np.random.default_rng(8)
    for n_ids in (65_530, 200_000):  # symbols that fit 16 bits at first, and that never do
        ids = np.concatenate([np.tile(rng.integers(0, n_ids, 30), 40) for _ in range(20)]).astype(np.uint32)
        row = _shard(0, 0, [ids], [np.full(200, len(ids) // 200)], n_ids)
        shard = Shard(dict(zip("part shard n_ids width n_tokens rules lengths symbols doc_sizes doc_symbols".split(), row, strict=True)))
        assert (shard.all() == ids).all() and len(shard.symbols) < len(ids)


def test_tables_by_workers(spark):
    import pyarrow.compute as pc

    from saithong.llm.common import cut_by_workers, drop

    df = spark.range(25_000).selectExpr("id", "cast(id as string) s", "if(id % 3 = 0, null, named_struct('a', id, 'b', array(id, null))) t", "cast(cast(id as string) as binary) b", "cast(id / 7 as decimal(20, 4)) d", "timestamp_seconds(id) at", "date_add(date '1500-01-01', cast(id as int)) day")
    table = cut_by_workers(df, "own")
    assert table.schema.simpleString() == df.schema.simpleString()
    assert table.exceptAll(df).isEmpty() and table.count() == 25_000
    odd = cut_by_workers(df.select("id"), "own", lambda batches: (b.filter(pc.equal(pc.bit_wise_and(b.column(0), 1), 1)) for b in batches), "id bigint")
    assert odd.count() == 12_500 and odd.filter("id % 2 = 0").isEmpty()
    none = cut_by_workers(df.filter("id < 0"), "own")
    assert none.collect() == [] and none.schema.simpleString() == df.schema.simpleString()
    drop(table, odd, none)


def test_near_duplicates_start_no_processes(spark):
    """Hadoop's local file system writes a .crc file beside each file, and starts processes for each of both."""
    from pathlib import Path

    from saithong.llm.common import shared_dir
    from saithong.llm.hyperminhash import keep_one

    folder = Path(shared_dir(spark).removeprefix("file:").replace("//", "/")) / "saithong"
    before = set(folder.glob("*"))
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(words if i % 2 else [*words[:-1], f"own{i}"])) for i in range(40)] + [(40, "alone"), (41, None)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [0, 40, 41]
    tables = set(folder.glob("*")) - before
    files = [f.name for t in tables for f in t.rglob("*") if f.is_file()]
    assert files and not [f for f in files if f.endswith(".crc")]
