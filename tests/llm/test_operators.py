"""The operators on small tables against brute force: nulls, empties, long texts, ties, repeats,
empty tables and columns with clashing names."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import chat, decontam, hamming, lines, mixing, pii, registry, simhash, suffix, textkit, tokens, topk, toxicity
from loomgraph.session import shared_path, table

LONG = " ".join(f"word{i % 977}" for i in range(20000))
TEXTS = [None, "", " ", "One short text.", "one SHORT text.", "One short text.", "a\nb\nc", LONG, LONG + " end", "x" * 5000, "Ünï cödé text + signs", "\n\n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of every awkward kind; also rows without id, a repeated row and columns that clash with operators' own."""
    rows = [(i, t, "s", 1, "k", 7) for i, t in enumerate(TEXTS)] + [(None, "One short text.", None, 1, "k", 7), (3, "One short text.", "s", 1, "k", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, k string, row int").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id = -1")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# 1 ------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(260)]
    data[7:20] = [(i, data[0][1]) for i in range(7, 20)]
    data += [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8), (1005, []), (1006, [1.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    usable = {i: np.floor(1024 * np.array(x, np.float32).astype(float)).astype(np.int64) for i, x in data[:260]} | {1005: np.zeros(8, np.int64), 1006: np.array([1024] + [0] * 7)}
    got = topk.top_k(v).collect()
    for q in (0, 100, 200):
        want = sorted(((int(usable[q] @ x), i) for i, x in usable.items() if i != q), key=lambda s: (-s[0], s[1]))[:10]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == {0, 100, 200}
    assert topk.top_k(v.where("vec_id < 0")).count() == 0
    assert topk.top_k(v.where("vec_id in (0, 1)")).count() == 1


def test_scores_beyond_long_are_refused(spark):
    for big in (1e30, 1e12):
        v = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 2.0])], "vec_id long, embedding array<float>")
        with pytest.raises(Exception, match="too large"):
            topk.top_k(v).collect()


def test_top_k_counts_repeated_rows_as_the_sql_does(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(150)]
    data += [(7, [0.1 * n + x for x in data[0][1]]) for n in (1, 2, 3)] + [(8, [4 * x for x in data[100][1]])] * 12 + [(100, data[3][1])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", v.toArrow())
    con.execute(registry.ORACLE_SQL["op1_topk"])
    names = [c[0] for c in con.description]
    assert rows(topk.top_k(v), *names) == sorted(con.fetchall(), key=str)


# 2 ------------------------------------------------------------------------------------------------

ITEM = "A farmer named Alice sells 12 red apples and 30 green pears for 5 dollars each on a sunny market day near the old river bridge."


def judged(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("row", F.lit(0))
    found = decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), **options)
    return {(r.doc_id, r.item_id): r.kind for r in found.collect()}


def test_contamination(spark, odd, empty):
    other = ITEM.replace("12", "44").replace("30", "9").replace("5 dollars", "7 euros").replace("Alice", "Robert")
    mixed = "A farmer named Alice sells 12 red apples and 12 green pears for 12 dollars each"
    docs = [(1, f"Before it. {ITEM} After it."), (2, other), (3, ITEM.upper()), (4, "A farmer sells apples on a market day."), (5, None), (6, ""), (7, ITEM[: len(ITEM) // 2]), (8, f"{LONG} {ITEM}"), (None, ITEM), (1, f"Before it. {ITEM} After it."), (9, mixed), (10, "x### y&&& " + ITEM.replace(" ", "### ")), (11, ITEM.lower()), (12, "so it goes, " + other.replace("Robert", "Mary Ann Lee").replace("44", "forty four") + " and on"), (13, f"{other}\n\n{LONG}\n\n{ITEM.replace('12', '77').replace('30', '66')}")]
    items = [(70, ITEM), (71, None), (72, ""), (73, "1 2 3 4 5 6 7"), (70, ITEM)]
    want = {(i, 70): "exact" for i in (1, 3, 8, 10, 11)} | {(i, 70): "reparameterised" for i in (2, 12, 13)}
    assert judged(spark, docs, items) == want
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert decontam.contaminated(d, b.where("item_id < 0")).count() == decontam.contaminated(empty, b).count() == 0
    assert decontam.contaminated(odd, b).count() == 0 and decontam.decontaminated(odd, b).count() == odd.count()
    kept = decontam.decontaminated(d.withColumn("own", F.lit("clash")), b)
    assert rows(kept, "doc_id") == sorted([(4,), (5,), (6,), (7,), (9,)], key=str) and kept.columns == ["doc_id", "text", "own"]
    text_ids = decontam.contaminated(d.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), b.withColumn("item_id", F.concat(F.lit("i"), "item_id")))
    assert rows(text_ids, "doc_id", "item_id", "kind") == sorted((f"d{i}", f"i{j}", k) for (i, j), k in want.items())


def test_rows_that_share_an_id_are_told_apart(spark):
    d = spark.createDataFrame([(2, ITEM), (2, "an innocent text of some words that stays"), (None, ITEM), (None, "and another one without an id")], "doc_id long, text string")
    kept = decontam.decontaminated(d, spark.createDataFrame([(70, ITEM)], "item_id long, text string"))
    assert rows(kept, "text") == [("an innocent text of some words that stays",), ("and another one without an id",)]


def test_names_at_the_start_of_sentences(spark):
    item = "Tom has 3 apples. Anna buys 5 more pears at the shop. How many pieces of fruit do Tom and Anna have in the end?"
    docs = [(1, item.replace("Tom", "Bob").replace("Anna", "Clara").replace("3", "7").replace("5", "twenty two")), (2, item.replace("Tom", "Mary Ann").replace("5", "11")), (3, "Question. " + item.replace("Anna", "Eve")), (4, "Bob has 7 dogs. Clara walks 5 more cats in the park. How many animals do Bob and Clara have at home?"), (5, item.lower()), (6, item.lower().replace("3", "8"))]
    assert judged(spark, docs, [(1, item)]) == {(1, 1): "reparameterised", (2, 1): "reparameterised", (3, 1): "reparameterised", (5, 1): "exact", (6, 1): "exact"}


def test_short_and_dense_items_are_found_exactly(spark):
    items = [(1, "Compute 17 x 23"), (2, "3 + 4 - 12 / 6 7 8 9 = ?"), (3, "Yes."), (4, "What is love?"), (5, "Name the capital of France now")]
    docs = [(1, "Please compute 17 x 23 and say"), (2, "first 3 + 4 - 12 / 6 7 8 9 = ? last"), (3, "yes"), (4, "he said yes and left"), (5, "what is love"), (6, "so what is love then"), (7, "Compute 18 x 23"), (8, "1 2 3 4 5 6 7 8 9"), (9, "now name the capital of Spain now then")]
    assert judged(spark, docs, items) == {(1, 1): "exact", (2, 2): "exact", (3, 3): "exact", (5, 4): "exact", (6, 4): "exact", (9, 5): "reparameterised"}
    assert judged(spark, [(1, "w " * 80 + ITEM)], [(1, "w " * 75 + ITEM)], window=70) == {(1, 1): "exact"}


def test_slots_must_answer_one_to_one(spark):
    item = "take 3 big boxes from the shelf and then 4 small boxes from the floor and again 3 big boxes from the shelf please"
    docs = [(1, item.replace("3", "8").replace("4", "9")), (2, item.replace("3 big boxes from the shelf and", "8 big boxes from the shelf and").replace("4", "9").replace("again 3", "again 7"))]
    assert judged(spark, docs, [(1, item)]) == {(1, 1): "reparameterised"}


def test_contamination_on_random_templates(spark):
    """Plain windows against a brute force over sets; re-parameterised copies as they were made."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    names = [w.capitalize() + "x" for w in vocabulary]

    def text(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    items, docs, made = [], [], {}
    for i in range(40):
        words = text(rnd.randint(15, 50)).split()
        a, b, c = rnd.sample(range(1, len(words)), 3)
        words[a], words[b], words[c] = rnd.choice(names), str(rnd.randrange(100)), str(rnd.randrange(100, 200))
        items.append((i, " ".join(words)))
        new = list(words)
        new[a], new[b], new[c] = rnd.choice([n for n in names if n != words[a]]), str(rnd.randrange(300, 400)), str(rnd.randrange(400, 500))
        docs.append((i, f"{text(rnd.randint(0, 40))} {' '.join(new)} {text(rnd.randint(0, 40))}"))
        made[i] = i
        cut = rnd.randint(0, len(words) // 2)
        docs.append((1000 + i, f"{text(rnd.randint(0, 40))} {' '.join(words[cut:] if i % 2 else words[: len(words) - cut])} {text(20)}"))
        docs.append((2000 + i, text(rnd.randint(1, 150))))

    def windows(t):
        w = t.lower().split()
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    own = {i: set(windows(t)) for i, t in docs}
    exact = {(d, i) for i, t in items for d, seen in own.items() if sum(w in seen for w in windows(t)) >= 0.8 * len(windows(t))}
    got = judged(spark, docs, items)
    assert {k for k, kind in got.items() if kind == "exact"} == exact
    others = {k for k, kind in got.items() if kind != "exact"}
    assert {(d, d) for d in made} - exact <= others and not any(d >= 2000 for d, _ in others)


def test_benchmark_passages_in_the_tables(spark, data):
    got = set(rows(registry.op2_decontam(spark, data), "doc_id", "item_id"))
    want = duckdb.sql(f"SELECT doc_id, item_id FROM '{data}/documents.parquet' d, '{data}/benchmark.parquet' b WHERE contains(d.text, b.text)").fetchall()
    assert got >= set(want)


# 3 ------------------------------------------------------------------------------------------------


def components(prints, radius):
    fp = np.array(prints, np.int64).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new
    return label


@pytest.mark.parametrize("tile", [8192, 16])
def test_near_duplicates(spark, data, tile, monkeypatch):
    monkeypatch.setattr("loomgraph.llm.hamming.TILE", tile)
    monkeypatch.setattr("loomgraph.llm.hamming.hamming_links.__defaults__", (tile,))
    got = sorted(simhash.near_duplicates(table(spark, data, "documents"), shingle=4).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in got] == [got[i].doc_id for i in components([r.fp for r in got], 4)]
    shown = registry.op3_simhash(spark, data).first()
    assert re.fullmatch("[0-9a-f]{16}", shown.fingerprint)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count() and got.where("doc_id in (0, 1, 2, 11)").select("fp", "component_id").distinct().collect()[0][:] == (0, 0)
    same = got.where("doc_id in (3, 4, 5) or doc_id is null")
    assert {r.component_id for r in same.collect()} == {3} and same.count() == 5
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id in (4, 5) or doc_id is null").count() == 0
    assert simhash.near_duplicates(empty).count() == simhash.deduplicated(empty).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    texts = ["first text of a kind of its own here", "second text quite unlike the other one", "third text that nobody else has written"]
    d = spark.createDataFrame([(5, texts[0], 1), (5, texts[1], 2), (6, texts[2], 3), (6, texts[2], 4), (None, texts[1], 5), (None, "alone without an id but kept all the same", 6)], "doc_id long, text string, own long")
    kept = simhash.deduplicated(d)
    assert rows(kept.select("doc_id", "text")) == sorted([(5, texts[0]), (5, texts[1]), (6, texts[2]), (None, "alone without an id but kept all the same")], key=str)
    assert kept.columns == d.columns


def test_copies_are_found_by_similarity(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    docs, truth = [], {}
    for group in range(30):
        base = [word() for _ in range(300)]
        for copy, changes in enumerate((0, 3, 5, 60)):
            text = list(base)
            for at in rnd.sample(range(300), changes):
                text[at] = word()
            i = group * 10 + copy
            docs.append((i, " ".join(text)))
            truth[i] = group * 10 if changes <= 5 else i
    got = dict(rows(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), radius=simhash.WIDE, similarity=0.8), "doc_id", "component_id"))
    assert got == truth  # up to 5 of 300 words changed: a cosine over 0.9; 60 changed: under 0.5


def test_links_by_similarity_against_all_pairs(spark):
    """Texts around the limit: what is surely over it is linked, what is surely under it is not."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    docs, near, far = [], [], []
    for i in range(0, 400, 2):
        base = [word() for _ in range(rnd.randint(60, 400))]
        text = list(base)
        for at in rnd.sample(range(len(base)), rnd.randint(1, max(1, len(base) // 12))):
            text[at] = word()
        docs += [(i, " ".join(base)), (i + 1, " ".join(text))]
        a, b = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (base, text))
        cosine = len(a & b) / (len(a) * len(b)) ** 0.5
        near += [i] if cosine >= 0.8 else []
        far += [i] if cosine < 0.68 else []
    got = dict(rows(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), radius=simhash.WIDE, similarity=0.8), "doc_id", "component_id"))
    linked = lambda i: got[i + 1] == i
    assert len(near) > 60 and len(far) > 20
    assert sum(map(linked, near)) >= 0.9 * len(near) and not any(map(linked, far))


def test_equal_fingerprints_are_no_proof_of_similarity(spark):
    line = " ".join(f"alpha{i}" for i in range(7)) + " "
    docs = [(i, line * 50 + " ".join(f"own{i}x{j}" for j in range(20))) for i in range(6)]
    docs += [(i + 10, t) for i, t in docs[:2]]
    found = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), radius=simhash.WIDE, similarity=0.8)
    assert dict(rows(found, "doc_id", "component_id")) == {i: i % 10 for i, _ in docs}
    one = np.zeros(4, np.uint64)
    a, b = hamming.compare(one, None, 3, (np.array([[0, 1], [2, 3], [0, 1], [5, 6]], np.uint8),), 0.8, (np.array([10, 11, 12, 13]),))
    assert sorted([*a.tolist(), *b.tolist()]) == [10, 12]


def test_copies_with_a_repeated_line_are_found_by_similarity(spark):
    docs = []
    for i in range(0, 60, 2):
        words = [f"w{i}x{j}" for j in range(300)]
        docs += [(i, " ".join(words)), (i + 1, " ".join(words + words[-7:] * 60))]
    found = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), radius=simhash.WIDE, similarity=0.8)
    assert dict(rows(found, "doc_id", "component_id")) == {i: i - i % 2 for i, _ in docs}


# 4 ------------------------------------------------------------------------------------------------


def test_personal_data(spark, odd, empty):
    texts = [(1, "Mail ann.lee@mail5.example.com or call +1 (743) 555-3824 from 227.5.221.1, card 4539 1488 0343 6467."), (2, None), (3, ""), (4, "é" * 10 + " x@y.zz"), (5, "300.1.1.1 and 1.2.3 and 4539 1488 0343 6468 are nothing"), (6, "9" * 100_000), (7, "please call (743) 555-3824 today")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in pii.personal_data(d).collect()}
    assert got[1].base == "email:5:30,phone:39:56,ip:62:73,card:80:99"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1) and got[1].base_sha256 == hashlib.sha256(got[1].base.encode()).hexdigest()
    assert got[4].base == "email:11:17" and got[5].base == "" and got[2].spans == got[3].spans == ""
    assert "phone:12:26" in got[7].spans and set(got[1].base.split(",")) <= set(got[1].spans.split(","))
    assert pii.personal_data(empty).count() == 0
    clashing = ("base", "spans", "n_email", "base_sha256")
    twice = spark.createDataFrame([(None, "a@b.cc"), (None, "a@b.cc"), (7, "a@b.cc"), (7, "a@b.cc"), (7, None)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in clashing})
    assert rows(pii.personal_data(twice), "doc_id", "base") == sorted([(None, "email:0:6")] * 2 + [(7, "email:0:6")] * 2 + [(7, "")], key=str)
    assert pii.personal_data(odd).count() == odd.count()


# 5 ------------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, empty):
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice("abcdeiou") for _ in range(rnd.randint(2, 7)))
    docs = []
    for i in range(900):
        text = [word() for _ in range(60)]
        if i % 8 == 0:
            text[rnd.randrange(60)] = rnd.choice(("grumbler", "scoundrel,", "Wretches"))
            text[rnd.randrange(60)] = rnd.choice(("Grumblers", "scoundrel.", "wretch"))
        docs.append((i, " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 900, 2)] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    toxic = [r for r in held if r.doc_id % 8 == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.8
    assert sum(r.predicted for r in held if r.doc_id % 8) / len(held) <= 0.02
    strange = toxicity.toxicity(odd, labels)
    assert strange.count() == odd.count() and strange.where("score is null or held_out is null").count() == 0
    assert toxicity.toxicity(odd, labels.where("toxic = 9")).where("score > 0.01").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def test_repeated_ids_do_not_multiply_what_is_fitted_on(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 10)
    monkeypatch.setattr(toxicity, "UNLABELLED", 20)
    d = spark.createDataFrame([(i % 3, f"text {i} scoundrel") for i in range(300)], "doc_id long, text string").withColumn("__text", F.lit("clash")).withColumn("__score", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1), (2, 1), (0, 1)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_nnpu
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda p, u, prior: seen.append((len(p), len(u))) or fit(p, u, prior))
    assert toxicity.without_toxic(d, labels).columns == d.columns and toxicity.toxicity(d, labels).count() == 300
    assert all(p + u <= 60 for p, u in seen)


def test_one_id_of_many_texts_hides_no_positives(spark):
    """40 toxic and 160 clean documents beside 30,000 texts under one id: the classes are bounded each by itself."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    text = lambda *more: " ".join([*r.choices(words, k=25), *more])
    toxic = [(i, text("scoundrel", "wretched", "vermin")) for i in range(0, 400, 10)]
    clean = [(i, text()) for i in range(1000, 1160)]
    d = spark.createDataFrame([*toxic, *clean, *((5000, text()) for _ in range(30_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean], "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels)
    assert got.where("predicted = 1").agg(F.count_distinct("doc_id"), F.count("*")).first()[:] == (40, 40)


# 6 ------------------------------------------------------------------------------------------------


def removed_by_hand(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_the_cover_takes_any_two_positions_into_the_sample():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


@pytest.mark.parametrize("block", [1 << 23, 2500])
def test_repeated_bytes(spark, block, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    rnd = random.Random(3)
    parts = ["".join(rnd.choice("abé\n ") for _ in range(rnd.randint(60, 260))) for _ in range(12)]
    docs = [(i, "".join(rnd.choice(parts)[rnd.randint(0, 50) :][: rnd.randint(1, 400)] for _ in range(rnd.randint(0, 8)))) for i in range(50)]
    docs += [(100, None), (101, ""), (102, "a" * 1000), (103, "a" * 99), (104, "a" * 150), *((200 + i, parts[0] + parts[1]) for i in range(5))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash")).repartition(3)
    want = removed_by_hand(docs)
    assert all(want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_bytes(d).collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_blocks")]


def test_blocks_follow_sizes_and_not_ids(spark, monkeypatch):
    """Null and repeated ids, one huge text and text ids: all in blocks of bounded size, all right."""
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 2500)
    rnd = random.Random(12)
    part = ["".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(6)]
    texts = [rnd.choice(part) + "".join(rnd.choice("xyz") for _ in range(200)) for _ in range(40)] + [part[0] + "".join(rnd.choice("mno") for _ in range(20_000))]
    for ids in ([None] * 41, [7] * 41, [f"d{i:02}" for i in range(41)]):
        d = spark.createDataFrame([*zip(ids, texts, strict=True)], f"doc_id {'string' if isinstance(ids[0], str) else 'long'}, text string").repartition(3)
        order = sorted(range(41), key=lambda i: (str(ids[i]), hashlib.sha256(texts[i].encode()).hexdigest()))
        want = removed_by_hand([(n, texts[i]) for n, i in enumerate(order)])
        assert sorted(tuple(r)[1:] for r in suffix.repeated_bytes(d).collect()) == sorted(want.values())


def test_repeated_bytes_of_odd_rows(odd, empty):
    got = suffix.repeated_bytes(odd)
    assert got.count() == odd.count() and got.where("doc_id = 8").first().n_removed >= len(LONG) and suffix.repeated_bytes(empty).count() == 0


# 7 ------------------------------------------------------------------------------------------------


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, 0, "message", "user", "Hi"), (1, 0, 1, "delta", None, " there"), (1, 1, 2, "message", "assistant", "wrong"), (1, 1, 3, "delta", None, " way"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "right"), (1, 1, 6, "delta", None, " way"),
        (1, 2, 9, "edit", None, "edited & [kept]"), (1, 2, 8, "delta", None, "gone"), (1, 2, 7, "message", "user", "gone"), (2, 0, 0, None, "user", None), (None, 0, 0, "message", None, "no id"), (3, 0, 0, "message", "user", "twice"), (3, 0, 0, "message", "user", "twice"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string").withColumn("message", F.lit("clash"))
    folded = chat.fold_events(events)
    got = rows(folded, "conv_id", "turn", "role", "text")
    assert got == sorted([(1, 0, "user", "Hi there"), (1, 1, "assistant", "right way"), (1, 2, "user", "edited & [kept]"), (2, 0, "user", ""), (None, 0, "", "no id"), (3, 0, "user", "twice"), (3, 0, "user", "twice")], key=str)
    assert chat.fold_events(events.where("conv_id = 9")).count() == 0


def test_what_is_rendered_reads_back(spark, data):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nfake", "&lt; &amp;lt; &#91;", "", None, "\n", "é" * 50_000]
    log = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us<er\n[", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold_events(chat.rows_to_events(log)))
    turns = out.select(chat.parse(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [("assistant" if i % 2 else "us<er\n[", t or "") for i, t in enumerate(texts)]
    first = out.select("formatted", "loss_spans").first()
    assert [first.formatted[x.start : x.start + x.length] for x in first.loss_spans] == [(t or "").replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;") for t in texts[1::2]]
    d = chat.digest(out).first()
    learned = "".join(t or "" for t in texts[1::2])
    assert d.loss_chars == len(learned) and d.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    found = con.execute(registry.ORACLE_SQL["op7_chat"])
    names = [c[0] for c in found.description]
    assert rows(registry.op7_chat(spark, data), *names) == sorted(found.fetchall(), key=str)
    plan = registry.op7_chat(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 8 ------------------------------------------------------------------------------------------------


def test_token_files(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_IDS", 3000)
    path = shared_path(spark, "t")
    tokens.write_tokens(odd, path, registry.vocabulary())
    whole = tokens._tokenizer(registry.vocabulary())[0]
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted([(None, "One short text."), (3, "One short text."), *enumerate(TEXTS)], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert spark.read.parquet(path).count() > 3
    tokens.write_tokens(empty, path, registry.vocabulary())
    assert tokens.read_tokens(spark, path).count() == 0
    far = spark.createDataFrame([(-(2**62), "a"), (2**62, "b"), (0, "c"), (None, None)], "doc_id long, text string")
    tokens.write_tokens(far, path, registry.vocabulary())
    assert [r.doc_id for r in tokens.read_tokens(spark, path).orderBy("start").collect()] == [None, -(2**62), 0, 2**62]
    with pytest.raises(ValueError, match="whole numbers"):
        tokens.write_tokens(far.withColumn("doc_id", F.lit("x")), path, registry.vocabulary())
    with pytest.raises(ValueError, match="more than 1 bytes"):
        tokens.check_width(registry.vocabulary(), 1)


# 9 ------------------------------------------------------------------------------------------------


def test_mix(spark, data, odd, empty):
    docs = table(spark, data, "documents")
    got = mixing.mix(docs).toPandas()
    assert rows(mixing.mix(docs.repartition(7))) == rows(mixing.mix(docs))
    text = dict(docs.select("doc_id", "text").collect())
    assert all(s == len(re.findall(r"[^\x20\x09-\x0D]+", text[i] or "")) for i, s in zip(got.doc_id, got["size"], strict=True))
    assert (got.taken <= 3 * got["size"]).all() and (got.target <= 3 * got.source_size + 1e-6).all()
    source = dict(docs.select("doc_id", "source").collect())
    by = got.assign(source=got.doc_id.map(source)).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), total=("source_size", "first"), own=("size", "sum"))
    assert (by.total == by.own).all() and ((by.taken - by.target).abs() <= 0.02 * by.target + 100).all() and abs(by.target.sum() - by.own.sum()) < 1
    strange = mixing.mix(odd)
    assert strange.count() == odd.count() and strange.where("size = 0 and taken <> 0").count() == 0 and strange.where("target is null").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert mixed.columns == docs.columns and words == got.taken.sum()


def seats_by_hand(w, n, most):
    out = [0] * len(w)
    for _ in range(n):
        best = [i for i in range(len(w)) if w[i] > 0 and out[i] < most[i]]
        if best:
            out[max(best, key=lambda i: (w[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_mix_against_plain_python(spark):
    """One shard a source: seats dealt one by one, then every word of every block of the run counted."""
    rnd, block = random.Random(8), 8
    docs = [(i, " ".join("w" for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "b", "c", None, "d"])) for i in range(300)] + [(None, "x y z", "a"), (None, "u v", "b"), (7, "p q", "b"), (8, None, "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit("clash"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    seen = d.select("doc_id", "source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("n"), F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(42)).alias("h"), F.xxhash64(key, F.lit(0).cast("long"), F.lit(42)).alias("begin")).collect()
    sources = sorted({r.source for r in seen}, key=lambda s: (s is None, s or ""))
    size = [sum(r.n for r in seen if r.source == s) for s in sources]
    target = mixing.targets(size, np.resize([5.0, 2, 1], len(sources)), 3)
    blocks = [-(-n // block) for n in size]
    quota = seats_by_hand(target, round(target.sum() / block), [3 * b for b in blocks])
    want = []
    for s, t, total, n, q in zip(sources, target, size, blocks, quota, strict=True):
        own = sorted((r for r in seen if r.source == s), key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0, r.n))
        passes, run = divmod(q, n)
        picked = {(own[0].begin % n + i) % n for i in range(run)}
        at = 0
        for r in own:
            want.append((r.doc_id, r.n, total, round(float(t), 6), passes * r.n + sum((at + i) // block in picked for i in range(r.n))))
            at += r.n
    got = mixing.mix(d, block_words=block).select("doc_id", "size", "source_size", F.round("target", 6), "taken")
    assert rows(got) == sorted(want, key=str)


def test_shards_are_dealt_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARDS", 3)
    d = spark.createDataFrame([(i, "w " * (i % 50), "ab"[i % 3 == 0]) for i in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(d, block_words=8, shard_words=200).toPandas()
    by = got.groupby("target").taken.sum()
    assert all(abs(t - n) <= 0.02 * t + 100 for t, n in by.items()) and (got.taken <= 3 * got["size"]).all()


def test_edge_documents_keep_their_white_space(spark):
    docs = [(i, f" \ta{i}  b{i}\n\nc{i}\td{i}   e{i} ", "s") for i in range(40)] + [(100 + i, "x", "t") for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    whole = dict((i, t) for i, t, _ in docs)
    mixed = mixing.mixed_documents(d, weights=(1, 1), block_words=2).collect()
    assert all(r.text in whole[r.doc_id] for r in mixed) and any(r.text != whole[r.doc_id] for r in mixed)


# 10 -----------------------------------------------------------------------------------------------


def line_truth(rows, links):
    """What goes if lines are linked by ``links(names)``: pairs of indices of the distinct normalised lines."""
    x = lines.Lines(*textkit.utf8(__import__("pyarrow").array([t for _, t in rows], "string")))
    digest = [(i is None, i or 0, n) for n, (i, _) in enumerate(rows)]
    classes = {}
    for i in range(len(x.row)):
        if x.chars[i]:
            classes.setdefault(x.normal(i), []).append(i)
    names, root = list(classes), list(range(len(classes)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in links(names):
        root[find(i)] = find(j)
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(find(i), []).extend(classes[n])
    at = lambda i: (digest[x.row[i]], int(x.number[i]))
    return sorted((rows[x.row[i]][0], int(x.number[i])) for g in groups.values() for i in sorted(g, key=at)[1:])


def alike(names):
    """All pairs with an edit similarity of 0.8 or more; nothing but the edit distance decides."""
    order = sorted(range(len(names)), key=lambda i: len(names[i]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(names[i]) < 0.8 * len(names[j]):
                break
            if lines.similar(names[i], names[j], 0.8):
                yield i, j


@pytest.mark.parametrize("small", [False, True])
def test_duplicate_lines(spark, data, small, monkeypatch):
    if small:
        monkeypatch.setattr(lines, "TILE", 4)
        monkeypatch.setattr(lines, "GROUP_ROWS", 6)
        monkeypatch.setattr(lines, "HOT_ROWS", 12)
        monkeypatch.setattr(lines, "FLUSH", 200)
    docs = table(spark, data, "documents").select("doc_id", "text").toPandas()
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    vocabulary = [word() for _ in range(800)]
    rows_ = [*zip(docs.doc_id.tolist()[:60], docs.text.tolist()[:60], strict=True)]
    for i in range(150):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 6, 10, 20, 40)))]
        other = list(words)
        at = rnd.randrange(len(words))
        other[at] = rnd.choice(vocabulary) if i % 2 else other[at][:-1] + "z"
        rows_ += [(100_000 + 2 * i, " ".join(words)), (100_001 + 2 * i, "Title\n" + " ".join(other))]
    want = line_truth(rows_, alike)
    d = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = sorted((r.doc_id, r.line) for r in lines.duplicate_lines(d).collect())
    assert not set(got) - set(want)
    planted = [x for x in want if x[0] >= 100_000]
    assert len(set(got) & set(want)) >= 0.95 * len(want) and len(set(got) & set(planted)) >= 0.9 * len(planted)


def test_lines_of_other_rows_are_never_touched(spark, odd, empty):
    d = [(1, "the very same line of text here\nfirst"), (2, "the very same line of text here"), (2, "a completely different and precious opening sentence\nsecond"), (None, "alpha beta gamma delta\nown line of one"), (None, "something else altogether\nfirst"), (5, "ok"), (6, "OK!"), (7, ""), (8, "--\n\n"), (9, "--"), (10, None)]
    got = lines.duplicate_lines(spark.createDataFrame(d, "doc_id long, text string"))
    assert rows(got, "doc_id", "line") == sorted([(2, 0), (None, 1), (6, 0)], key=str)
    kept = lines.without_duplicate_lines(spark.createDataFrame(d, "doc_id long, text string").withColumn("gone", F.lit("clash")).withColumn("__id", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "gone", "__id"]
    gone = {(2, d[1][1]): "", (None, d[4][1]): "something else altogether", (6, "OK!"): ""}
    assert rows(kept, "doc_id", "text") == sorted([(i, gone.get((i, t), t)) for i, t in d], key=str)
    report = lines.line_report(odd)
    assert report.count() == odd.count() and report.where("doc_id = 0").first()[1:] == (1, 0, "")
    assert sorted(report.where("doc_id = 3").select("n_removed").collect()) == [(0,), (1,)]  # of a repeated row one stays
    assert report.where("doc_id = 4").first().n_removed == report.where("doc_id is null").first().n_removed == 1
    assert lines.without_duplicate_lines(odd).columns == odd.columns
    assert lines.line_report(empty).count() == lines.without_duplicate_lines(empty).count() == 0


def test_short_lines_are_all_found(spark):
    rnd = random.Random(12)
    words = sorted({"".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(5, 12))) for _ in range(60)})
    rows_ = [(i, w) for i, w in enumerate(words)] + [(1000 + i, w[:-1] + "z") for i, w in enumerate(words)] + [(2000 + i, "z" + w[2:] if len(w) > 9 else w[1:]) for i, w in enumerate(words)]
    got = lines.duplicate_lines(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert sorted((r.doc_id, r.line) for r in got.collect()) == line_truth(rows_, alike)


def test_forged_lines_are_kept(spark):
    """Codes that differ by the signs of the Thue-Morse word have one sum for every base modulo 2**64."""
    rnd = random.Random(3)
    codes = [rnd.randrange(98, 122) for _ in range(4096)]
    one, other = "".join(map(chr, codes)), "".join(chr(c + 1 - 2 * (i.bit_count() % 2)) for i, c in enumerate(codes))
    assert not lines.similar(one, other, 0.8)
    rows_ = [(1, one), (2, other), (3, one)]
    assert rows(lines.duplicate_lines(spark.createDataFrame(rows_, "doc_id long, text string")), "doc_id", "line") == [(3, 0)]


def test_of_repeated_rows_one_keeps_its_lines(spark):
    d = [(None, "same text\n--\nmore"), (None, "same text\n--\nmore"), (7, "another line\nsame text"), (7, "another line\nsame text"), (7, "another line\nsame text"), (8, "own"), (None, None), (None, None), (9, "--"), (9, "--")]
    df = spark.createDataFrame(d, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("copy", "at", "first", "own", "id", "gone", "digest")}).repartition(4)
    kept = lines.without_duplicate_lines(df)
    assert kept.columns == df.columns
    want = [(7, "another line\nsame text"), (7, ""), (7, ""), (None, "--\nmore"), (None, "--"), (8, "own"), (None, None), (None, None), (9, "--"), (9, "--")]
    assert rows(kept, "doc_id", "text") == sorted(want, key=str)
    report = lines.line_report(df)
    assert rows(report) == sorted([(7, 2, 0, ""), (7, 2, 2, "0,1"), (7, 2, 2, "0,1"), (None, 3, 1, "0"), (None, 3, 2, "0,2"), (8, 1, 0, ""), (None, 1, 0, ""), (None, 1, 0, ""), (9, 1, 0, ""), (9, 1, 0, "")], key=str)


# The pipeline -------------------------------------------------------------------------------------


def test_stages_take_odd_and_empty_tables(spark, data, odd, empty):
    for docs in (odd, empty):
        at = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("__score"), F.lit(2).alias("row"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, data)
            assert out.columns == at.columns
            at = spark.createDataFrame(out.collect(), out.schema)
            kept = [r.text for r in at.collect()]
            if name != "source_mix":  # of long copies one stays, of short texts each once
                assert kept.count("One short text.") + kept.count("one SHORT text.") == (docs is odd) or name == "toxicity"
                assert (LONG in kept) == (docs is odd)
        assert corpus_pipeline.STAGES[-1][1](spark, at, data).count() == len(kept)


def test_pipeline(spark, data):
    docs = table(spark, data, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "token_output"]
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = table(spark, data, "labels")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        path = shared_path(spark, name)
        stage(spark, at, data).write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == docs.columns
        ids = {r.doc_id for r in at.select("doc_id").collect()}
        if name == "toxicity":
            kept -= toxic
        elif name == "simhash_near_dedup":
            kept = {r.doc_id for r in simhash.near_duplicates(before, radius=simhash.WIDE, similarity=0.8).collect() if r.doc_id == r.component_id}  # ids are unique here
        elif name == "benchmark_decontamination":
            kept -= {r.doc_id for r in decontam.contaminated(before, table(spark, data, "benchmark")).collect()}
        else:
            kept = {r.doc_id for r in mixing.mix(before).where("taken > 0").collect()}
        assert ids == kept, name
    whole = tokens._tokenizer(registry.vocabulary())[0]
    texts = sorted((r.doc_id, r.text) for r in at.select("doc_id", "text").collect())
    got = corpus_pipeline.run(spark, data).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for i, _ in texts]
    assert sum(r.n_tokens for r in got) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
