"""Whitening, packing and the prefix trie against brute force, on odd tables and through their parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import packing, registry, trie, whitening

# Trie ---------------------------------------------------------------------------------------------


def brute_trie(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: (r[1], r[0], r[3]))


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(int(c - np.fmod(c, 5)), [])[:h] + own[h:]
    return out


def conversation_rows(n, seed, longest=9):
    r = random.Random(seed)
    convs = {c: [(r.choice(["user", "assistant"]), r.choice(["a", "bé", "", "c d"])) for _ in range(r.choice([1, 2, 3, longest]))] for c in r.sample(range(-40, 400), n)}
    return convs, [(c, t, role, text) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]


@pytest.mark.parametrize(("n", "block"), [(3, 1 << 17), (150, 1 << 17), (150, 7), (150, 1)])
def test_trie_against_brute_force(spark, n, block, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", block)
    convs, rows = conversation_rows(n, n)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    lists = trie.with_shared_heads(trie.turn_lists(df))
    got = sorted((tuple(r) for r in trie.prefix_trie(lists).collect()), key=lambda r: (r[1], r[0], r[3]))
    assert got == brute_trie(rebuilt(convs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=6), min_size=1, max_size=30), st.integers(1, 12))
def test_blocks_add_up(sequences, size):
    """Any cut of the sorted sequences into blocks gives the same nodes."""
    weight = {"a": 3, "b": 5}
    digests = {x: hashlib.sha256(x.encode()).digest() for x in "ab"}
    convs = dict(enumerate(sequences))
    distinct = sorted({tuple(digests[x] for x in s) for s in sequences})
    by = defaultdict(list)
    for c, s in convs.items():
        by[tuple(digests[x] for x in s)].append(c)
    of = {digests[x]: weight[x] for x in "ab"}
    rows = [([(d, of[d]) for d in s], len(by[s]), min(by[s])) for s in distinct]
    lcp = lambda a, b: trie._common(a[0], b[0])
    total = defaultdict(lambda: [10**9, 0, 0, 0, 0])
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size]
        before = lcp(rows[lo - 1], part[0]) if lo else -1
        after = lcp(part[-1], rows[lo + size]) if lo + size < len(rows) else -1
        found = trie.block_nodes([r[0] for r in part], np.array([r[1] for r in part]), np.array([r[2] for r in part]), before, after)
        for key, conv, *sums in zip(*(list(found[c]) for c in ("node", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), strict=True):
            total[key] = [min(total[key][0], conv), *(a + b for a, b in zip(total[key][1:], sums, strict=True))]
    named = {c: [("", "x" * weight[x]) if x == "a" else ("b", "y" * weight[x]) for x in s] for c, s in convs.items()}
    want = sorted((r[0], r[3], r[4], r[5], r[6]) for r in brute_trie(named))
    assert sorted(tuple(int(x) for x in v) for v in total.values()) == want


def test_extents_and_minima():
    r = np.random.default_rng(1)
    lcp = r.integers(0, 5, 40)
    table = trie.sparse_table(lcp)
    at, depth = np.repeat(np.arange(41), 5), np.tile(np.arange(5), 41)
    left, right = trie.extents(table, 41, at, depth)
    for i, d, a, b in zip(at, depth, left, right, strict=True):
        lo, hi = i, i
        while lo and lcp[lo - 1] >= d:
            lo -= 1
        while hi < 40 and lcp[hi] >= d:
            hi += 1
        assert (a, b) == (lo, hi)
    lo, hi = np.triu_indices(40)
    assert trie.range_minimum(table, lo, hi).tolist() == [lcp[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, depth int, NODE string, parent long"
    rows = [(5, None, "user", None, 1, "x", 2), (5, 1, None, "b", 1, "x", 2), (5, 1, None, "b", 1, "x", 2), (None, 0, "user", "lost", 1, "x", 2), (6, 3, "user", "x" * 300_000, 1, "x", 2), (7, None, None, None, 1, "x", 2)]
    df = spark.createDataFrame(rows, schema)
    convs = {5: [("user", ""), ("", "b"), ("", "b")], 6: [("user", "x" * 300_000)], 7: [("", "")]}
    got = sorted((tuple(r) for r in trie.prefix_trie(trie.turn_lists(df)).collect()), key=lambda r: (r[1], r[0], r[3]))
    assert got == brute_trie(convs)
    assert trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(df.limit(0)))).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    """All have one turn; where h isn't 0 and there is no base, nothing is left."""
    convs = {c: [("user", "hi")] for c in (1, 2, 3, 4, 11, 12)}
    df = spark.createDataFrame([(c, 0, "user", "hi") for c in convs], "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(df))).collect()), key=lambda r: (r[1], r[0], r[3]))
    assert got == brute_trie(rebuilt(convs)) and got[0][3] == 6


def test_trie_query_against_its_sql(spark, data):
    got = registry.op13_trie(spark, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    found = con.execute(registry.ORACLE_SQL["op13_trie"])
    names = [d[0] for d in found.description]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(found.fetchall(), key=key)


# Packing ------------------------------------------------------------------------------------------


def check_packed(rows, ids_of, window):
    """Every id of every document once, sequences without gaps and at most a window long, no padding."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
        assert r.length > 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert docs.keys() == ids_of.keys()
    for doc, pieces in docs.items():
        got, at = b"", 0
        for start, length, ids, total in sorted(pieces):
            assert start == at and len(ids) == 4 * length and total == len(ids_of[doc])
            got, at = got + bytes(ids), at + length
        assert np.frombuffer(got, "<u4").tolist() == ids_of[doc]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.word_vocabulary())


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_holds_all_ids_once(spark, data, window, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 20_000)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    t = tokenizer()
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    check_packed(packing.pack(docs, registry.word_vocabulary(), window=window).collect(), want, window)


def test_packing_query_is_the_operators_digest(spark, data):
    t = tokenizer()
    docs = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = registry.op12_packing(spark, data).collect()
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    for r in rows:
        part = docs[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    again = registry.op12_packing(spark, data).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


ODD = ["", " ", "a", "a  b\n\nc\td", "Don't STOP, it's 12.5!", "x<|endoftext|>y <|startoftext|>", "<|", "naïve ÉCOLE,, İstanbul ΣΑΣ", "\x1c\x85 a b c", "é ́x", "日本語 テスト。", "word... end?!", "'s 't", "," * 40, "a" * 3000, "\r\n\x0b\x0c", "ɐ. ɏ."]


def ids(w, text):
    return np.frombuffer(w.encode(text), w.width).tolist()


def test_words_give_the_tokenizers_ids():
    t, w = tokenizer(), packing.Words(registry.word_vocabulary())
    want = [t.encode(x, add_special_tokens=False).ids for x in ODD]
    assert [ids(w, x) for x in ODD] == want
    assert [ids(w, x) for x in ODD] == want  # from what it remembers


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="abcXYZÀßéÿĀıſŉŒ'.,!-_ \n12", max_size=60))
def test_words_on_any_text(text):
    w = packing.words(registry.word_vocabulary())
    assert ids(w, text) == w._ids(text)


def test_words_forget_and_learn_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    w, t = packing.Words(registry.word_vocabulary()), tokenizer()
    for lo in range(0, 40, 4):
        texts = [f"word{i} again {i % 7}, and," for i in range(lo, lo + 8)]
        assert [ids(w, x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing_of_odd_tables(spark):
    schema = "doc_id int, text string, length string, ids int, terms long, deal int"
    rows = [(None, "null id", "x", 1, 2, 3), (1, None, "x", 1, 2, 3), (1, None, "x", 1, 2, 3), (2, "again and again", "x", 1, 2, 3), (2, "again and again", "x", 1, 2, 3), (3, "long " * 9000, "x", 1, 2, 3)]
    df = spark.createDataFrame(rows, schema)
    got = packing.pack(df, registry.word_vocabulary())
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    held = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {(r.doc_id, r.n, r.m) for r in held} == {(None, 3, 3), (1, 2, 1), (2, 8, 4), (3, 9001, 9001)}
    renamed = packing.pack(df.select(F.col("doc_id").alias("Start"), F.col("text").alias("offset")), registry.word_vocabulary(), id_col="Start", text_col="offset")
    assert len(set(map(str.lower, renamed.columns))) == 7 and renamed.count() == got.count()
    assert packing.pack(df.limit(0), registry.word_vocabulary()).collect() == []


def test_bm25_by_hand():
    """Scores against the formula, and neighbours of one's own topic come first."""
    random.seed(3)
    topics = [list(range(100 * k, 100 * k + 40)) for k in range(6)]
    ids = [np.array(random.choices(topics[d % 6] + list(range(900, 920)), k=50) + [2], np.uint16) for d in range(120)]
    df = np.zeros(1000, np.int64)
    for x in ids:
        df[np.unique(x)] += 1
    idf = np.maximum(np.log((120 - df + 0.5) / (df + 0.5)), 0)
    index = packing.Index(ids, idf, 51.0)
    index.unused[0] = False
    near = index.neighbours(0).tolist()

    def score(d):
        return sum(idf[t] * (f := (ids[d] == t).sum()) * (packing.K1 + 1) / (f + packing.K1) for t in np.unique(ids[0]))

    scores = [score(d) for d in near]
    assert all(a >= b - 1e-9 for a, b in zip(scores, scores[1:], strict=False)) and len(near) == 119
    assert all(d % 6 == 0 for d in near[:19])
    packed = packing.pack_shard(ids, df, 120, 51.0, window=512)
    pure = [max(sum(m for d, _, m in s if d % 6 == k) for k in range(6)) / sum(m for _, _, m in s) for s in packed if sum(m for _, _, m in s) == 512]
    assert np.mean(pure) > 0.8  # a window mixes topics where one ends
    assert sorted((d, a) for s in packed for d, lo, m in s for a in range(lo, lo + m)) == [(d, a) for d in range(120) for a in range(51)]


# Whitening ----------------------------------------------------------------------------------------


def brute_whitening(vectors, scale=256):
    x = np.floor(np.array(vectors, float) * scale).astype(np.int64)
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(0)
    values, space = np.linalg.eigh(c.T @ c / len(fit))
    return x, fit, values[::-1], space[:, ::-1]


def held(rows, vectors):
    x, fit, values, space = brute_whitening(vectors)
    n, sums = len(fit), fit.sum(0)
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    k = max(map(len, by.values()))
    assert len(by) == len(vectors) and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    for i, row in by.items():
        assert {r.n for r in row.values()} == {n} and {r.deviation for r in row.values()} == {int(((n * x[i] - sums) ** 2).sum())}
    for c in range(1, k + 1):
        got = np.array([by[i][c].whitened for i in range(len(vectors))])
        want = (x - fit.mean(0)) @ space[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert by[0][c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-10)
        assert by[0][c].identity_error < 1e-10
    return k


@pytest.mark.parametrize("offset", [0.0, 3000.0])
def test_whitening_against_eigh(spark, offset):
    r = np.random.default_rng(5)
    vectors = r.normal(size=(300, 12)) * np.linspace(1, 3, 12) + offset
    vectors[200:] = vectors[:100]  # repeated rows weigh nothing
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    assert held(whitening.whitened(df).collect(), vectors) == 4


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, component string, X int, deviation string, n int"
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (None, [3.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, []), (6, [])]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], schema)
    got = whitening.whitened(df).collect()
    assert sorted({str(r.vec_id) for r in got}) == ["0", "1", "6", "None"] and {r.n for r in got} == {3} and len(got) == 5 * 2
    by = {(r.component, r.whitened) for r in got if r.vec_id in (1, None)}
    assert len(by) == 2  # [3.0] counts as [3.0, 0.0]
    assert whitening.whitened(df.limit(0)).collect() == []
    assert whitening.whitened(df.where("vec_id = 0")).collect() == []  # no variance
    assert whitening.whitened(df.where("vec_id = 6")).collect() == []
    renamed = whitening.whitened(df.select(F.col("vec_id").alias("Component"), "embedding"), id_col="Component")
    assert renamed.count() == 10
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(df.select("vec_id", F.array(F.lit(1e300), F.rand(1)).alias("embedding"))).collect()


def test_fewer_components_than_asked_for(spark):
    """One direction alone varies."""
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 14), st.integers(0, 10**6))
def test_inertia_counts_eigenvalues(d, seed):
    r = np.random.default_rng(seed)
    a = r.integers(-3, 4, (d, d)).astype(float)
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for shift in (-2.3, 0.1, 1.7):
        if np.abs(values - shift).min() > 1e-6:
            assert whitening.inertia_above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[9, 8, 7, 6, 5, 1], [9, 9, 9, 9, 9, 9], [5, 5, 5, 5, 5, 1], [1e6, 1, 1e-3, 1e-4, 1e-5, 0], [3, 0, 0, 0, 0, 0], [1, 1 - 1e-7, 1 - 2e-7, 1 - 3e-7, 1 - 4e-7, 0.5]])
def test_feast_on_spectra(values):
    space = np.linalg.qr(np.random.default_rng(2).normal(size=(6, 6)))[0]
    v = (space * np.array(values, float)) @ space.T
    v = (v + v.T) / 2
    got, vectors = whitening.feast(v, 4)
    want = np.sort([x for x in values if x > 0])[::-1][:4]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-10 * max(values)) and np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-12)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * max(values)


def test_exact_products_of_large_numbers():
    y = np.array([[2**40 + 1, -(2**33)], [3, 5], [-(2**40), 7]], np.int64)
    assert (whitening.exact_products(y) == y.astype(object).T @ y.astype(object)).all()
    small = np.random.default_rng(0).integers(-(2**26), 2**26, (50, 3))
    assert (whitening.exact_products(small) == small.astype(object).T @ small.astype(object)).all()
