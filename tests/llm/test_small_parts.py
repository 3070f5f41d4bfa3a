"""The numpy parts of the operators against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import hamming, lines, mixing, pii, simhash, textkit, tokens, topk, toxicity


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t.x", max_size=12)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    data, offsets = textkit.utf8(pa.array(texts, pa.string()))
    starts, ends, first = textkit.word_spans(data, offsets)
    got = [[data[starts[i] : ends[i]].tobytes() for i in range(a, b)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]


def test_slices_keep_long_rows_whole():
    offsets = np.array([0, 3, 3, 20, 22, 23])
    assert list(textkit.slices(offsets, 5)) == [(0, 2), (2, 3), (3, 5)]
    assert list(textkit.slices(np.array([0]), 5)) == []


@pytest.mark.skipif(textkit._trim is None, reason="no malloc_trim")
def test_a_task_gives_its_free_memory_back():
    held = lambda: sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon")) >> 10
    kept = []

    def run(batches):
        for batch in batches:
            parts = [np.ones(8000) for _ in range(3000)]  # 190 MB in parts too small for maps of their own
            kept.append(parts[-1])  # and one behind them that stays
            del parts
            yield batch

    batch = pa.RecordBatch.from_pydict({"a": [1]})
    before = held()
    assert list(run(iter([batch]))) == [batch] and held() > before + 150
    assert list(textkit.released(run)(iter([batch]))) == [batch] and held() < before + 50


def test_span_hashes_depend_on_the_bytes_only():
    data = np.frombuffer(b"abcXabcYabd", np.uint8)
    h = textkit.Spans(data).hash(np.array([0, 4, 8, 0]), np.array([3, 7, 11, 2]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_bit_votes():
    h = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for sizes in ([3000], [1, 2, 255, 256, 2486], [1] * 3000):
        ends = np.cumsum(sizes)
        want = [np.unpackbits(h[a:b].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0) for a, b in zip(ends - sizes, ends, strict=True)]
        assert (textkit.bit_votes(h, ends - sizes, ends) == np.array(want)).all()


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "a b c d", "A\tb  c\nd e\x0bf", "é É ß İ x", "w " * 300])
def test_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    assert simhash.fingerprint(text, 4, 42) % (1 << 64) == want


@given(st.lists(st.integers(0, 63), min_size=1, max_size=40), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_hamming_forest_connects_what_links_connect(flips, radius):
    x, v = [], 0
    for f in flips:
        v ^= 1 << f
        x.append(v)
    x = np.unique(np.array(x, np.uint64))

    def groups(pairs):
        root = {int(i): int(i) for i in x}
        for _ in x:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    a, b = hamming.compare(x, None, radius)
    every = [(int(i), int(j)) for i in x for j in x if (int(i) ^ int(j)).bit_count() <= radius]
    assert groups(every) == groups(list(zip(a.tolist(), b.tolist(), strict=True)))
    half = len(x) // 2
    if half:
        a, b = hamming.compare(x[:half], x[half:], radius)
        own = {int(i): int(i) for i in x}
        cross = [(int(i), int(j)) for i in x[:half] for j in x[half:] if (int(i) ^ int(j)).bit_count() <= radius]
        assert groups(cross) == groups(list(zip(a.tolist(), b.tolist(), strict=True))) and own


@given(st.lists(st.integers(0, 10**9), max_size=700))
@settings(max_examples=40, deadline=None)
def test_elias_fano_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    e = tokens.EliasFano(*tokens.ef_encode(v))
    assert e.selects(np.arange(len(v))).tolist() == v.tolist() and [e.select(i) for i in range(len(v))] == v.tolist()


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20000))
    assert sum(len(x) for x in tokens.ef_encode(v)[:3]) * 8 / len(v) < 2.4 + np.log2(1000)


TRICKY = ["", "\n", "a\n\nb", " a", "a ", "a\tb", "x<|endoftext|>y", "don't stop. It's 5,000!! ok", "a\xa0b c", "“q” é, ñ.", "a\rb", "one.\nTwo, 3.\nx", "!!! ?? ..", "a\x1cb\n\nc", "été. ß, x", "word " * 400]


def test_pieces_encode_like_whole_texts():
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    whole = tokens._tokenizer(path)[0]
    for _ in range(2):
        for text, ids in zip(TRICKY, tokens.encode_texts(TRICKY, path), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_latin_words_skip_the_rules_and_pieces_are_forgotten(monkeypatch):
    """New Latin words are asked of the model itself, once; a full memory keeps the last run's pieces only."""
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    whole = tokens._tokenizer(path)[0]
    batches = []

    class Counted:
        model, encode = whole.model, whole.encode

        def encode_batch_fast(self, some, **options):
            batches.append(some)
            return whole.encode_batch_fast(some, **options)

    known = tokens.Known(Counted())
    monkeypatch.setitem(tokens._workers, path, (whole, known))
    monkeypatch.setattr(tokens, "RUN", 60)
    monkeypatch.setattr(tokens, "CACHE", 7)
    texts = ["Élève thonheth, the\nThe heon; été\nwords!! it's", "the heon thonheth. The", "straße 'quoted' Ĳssel***", "the heon it's", "a \r\rb \rc", "\r", "ª º ñ ¡no! x_y _x"] * 3
    for text, ids in zip(texts, tokens.encode_texts(texts, path), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert len(known.pieces) <= 7 + 40 and len(known.pieces) == len(known.ends) == len(known.plain) and known.ends[-1] == len(known.ids)
    assert batches and not any(w in b for some in batches for b in some for w in ("thonheth", "heon", "Élève", "été", "straße"))


@given(st.lists(st.floats(0, 100), min_size=1, max_size=8), st.integers(0, 60), st.integers(1, 30))
@settings(max_examples=80, deadline=None)
def test_sainte_lague_deals_by_highest_quotients(weights, seats, most):
    w = np.array(weights)
    want = np.zeros(len(w), int)
    for _ in range(seats):
        open_ = [i for i in range(len(w)) if w[i] > 0 and want[i] < most]
        if not open_:
            break
        want[max(open_, key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
    got = mixing.sainte_lague(w, seats, np.full(len(w), most))
    assert got.sum() == want.sum()
    quotient = lambda d: sorted(w[i] / (2 * k + 1) for i in range(len(w)) for k in range(d[i]))
    assert np.allclose(quotient(got), quotient(want))


def test_targets_stop_at_three_times_the_size():
    size = np.array([10, 1000, 20, 500])
    t = mixing.targets(size, np.array([5, 2, 1, 5]), 3)
    assert np.isclose(t.sum(), size.sum()) and (t <= 3 * size + 1e-9).all() and t[0] == 30
    assert np.isclose(t[3] / t[1], 2.5)
    assert mixing.targets(np.zeros(2), np.ones(2), 3).tolist() == [0, 0]


def test_edit_distance_of_long_texts_stops_at_what_a_column_leaves():
    rng, bounded = random.Random(3), 0
    for n in range(60):
        a = "".join(rng.choices("abcdefg é", k=rng.randint(65, 160)))
        b = "".join(c if rng.random() < 0.7 else rng.choice("abxé") for c in a) if n % 2 else "".join(rng.choices("abcdefg é", k=rng.randint(65, 160)))
        assert lines._places(a, b) == {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a) & set(b)}
        columns = [list(range(len(a) + 1))]  # of the table of distances, the steps within one are what the bits hold
        for j, y in enumerate(b, 1):
            last, column = columns[-1], [j]
            for i, x in enumerate(a):
                column.append(min(last[i] + (x != y), last[i + 1] + 1, column[i] + 1))
            columns.append(column)
        for j in (len(b) // 4, len(b) // 2):
            steps = np.diff(columns[j])
            plus, minus = (sum(1 << int(i) for i in np.flatnonzero(steps == way)) for way in (1, -1))
            assert lines._least_through(plus, minus, j, len(a), len(b)) == min(d + abs(len(a) - i - (len(b) - j)) for i, d in enumerate(columns[j]))
        exact = columns[-1][-1]
        for most in (0, len(a) // 5, exact - 1, exact):
            got = lines.edit_distance(a, b, most)
            assert got == exact if exact <= most else most < got <= exact
            bounded += got < exact
    assert bounded


def test_edit_distance():
    rnd = random.Random(0)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rnd.choice("abé") for _ in range(rnd.randint(0, 30))) for _ in range(2))
        assert lines.edit_distance(a, b) == slow(a, b)
        longest = max(len(a), len(b))
        assert lines.edits_at_most(a, b, 99) >= slow(a, b)
        assert lines.similar(a, b, 0.8) == (10 * slow(a, b) <= 2 * longest)
        assert lines.least_edits(lines._bags([a, b], 3), np.array([0]), np.array([1]))[0] <= slow(a, b)


def test_lines_are_normalised():
    texts = ["", "a", "\n", "a\n", "\nHello, World 12\nx  y\n\nfoo-bar é!\n", None, "..\n--", "zz"]
    x = lines.Lines(*textkit.utf8(pa.array(texts)))
    norm = lambda t: " ".join(w for w in ("".join(c for c in w if (c.isascii() and c.isalnum()) or ord(c) > 127).lower() for w in t.split()) if w)
    want = [(i, n, norm(t)) for i, text in enumerate(texts) for n, t in enumerate((text or "").split("\n"))]
    assert [(int(r), int(n), x.normal(i)) for i, (r, n) in enumerate(zip(x.row, x.number, strict=True))] == want
    assert x.chars.tolist() == [len(t) for *_, t in want]


def test_the_bound_of_edits_is_sound_and_close_for_copies():
    rnd = random.Random(5)
    for _ in range(150):
        a = "".join(rnd.choice("abcdefghij ") for _ in range(rnd.randint(0, 400)))
        b = list(a)
        changes = rnd.randint(0, 6)
        for _ in range(changes):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 2)] = rnd.choice("xyz") * rnd.randint(0, 2)
        b = "".join(b)
        bound = lines.edits_at_most(a, b, 10**6)
        assert lines.edit_distance(a, b) <= bound
        if len(a) > 200 and changes <= 2:
            assert bound <= 40


def test_least_and_greatest():
    rnd = np.random.default_rng(0)
    pairs = rnd.integers(0, 30, (200, 2)).astype(np.uint64)
    want = sorted({(k, x) for k in set(pairs[:, 0].tolist()) for own in [pairs[pairs[:, 0] == k, 1].tolist()] for x in (min(own), max(own))})
    assert [tuple(x) for x in lines.least_and_greatest(pairs).tolist()] == want


def test_a_changed_piece_leaves_most_blocks_as_they_are():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    for words, least in ((2, 0.85), (4, 0.95), (6, 0.85), (10, 0.9), (40, 0.98), (150, 0.98)):
        pairs = []
        for _ in range(150):
            a = [word() for _ in range(words)]
            b = list(a)
            at = rnd.randrange(words)
            b[at] = b[at][:-1] + "z"
            pairs.append((" ".join(a), " ".join(b)))
        pairs = [p for p in pairs if p[0] != p[1] and lines.similar(*p, 0.8)]
        x = lines.Lines(*textkit.utf8(pa.array([t for p in pairs for t in p])))
        keys = [set() for _ in range(2 * len(pairs))]
        for i, k in zip(*x.block_keys(), strict=True):
            keys[i].add(int(k))
        assert np.mean([bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs))]) >= least, words


def test_short_lines_within_their_edits_always_share_a_key():
    rnd = random.Random(8)
    letters = "abcdefg1é日 "
    texts = []
    for _ in range(900):
        a = [rnd.choice(letters) for _ in range(rnd.randint(3, 14))]
        b = list(a)
        for _ in range(rnd.randint(1, 2)):
            at, kind = rnd.randrange(len(b)), rnd.randrange(3)
            b[at : at + (kind < 2)] = [rnd.choice(letters)] * (kind != 1)
        texts += ["".join(a), "".join(b) or "a"]
    for similarity in (0.8, 0.9):
        x = lines.Lines(*textkit.utf8(pa.array(texts)))
        names, keys = [x.normal(i) for i in range(len(texts))], [set() for _ in texts]
        for i, k in zip(*x.block_keys(similarity), strict=True):
            keys[i].add(int(k))
        near = [i for i in range(0, len(texts), 2) if names[i] and names[i + 1] and max(x.chars[i], x.chars[i + 1]) <= lines.EXACT and lines.similar(names[i], names[i + 1], similarity)]
        assert len(near) > 150 and all(keys[i] & keys[i + 1] for i in near)


def test_equal_lines_are_told_by_a_secret():
    """The Thue-Morse word and its complement have one sum for every base modulo 2**64."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    texts = pa.array([word, word.translate(str.maketrans("ab", "ba")), word])
    one, other = (lines.Lines(*textkit.utf8(texts), secret) for secret in (b"one", b"other"))
    assert one.key[0] == one.key[2] != one.key[1] and one.key[0] != other.key[0]
    assert one.spans.hash(one.start, one.end)[0] == one.spans.hash(one.start, one.end)[1]


def test_block_keys_depend_on_the_line_only():
    texts = ["", "one", "a b", "  ", "日本語の文章です", "日本語の文章でし 12", "x" * 100, "w " * 3000, "-", "é ü"]
    x = lines.Lines(*textkit.utf8(pa.array(["\n".join(texts)] * 2)))
    got = [set() for _ in range(2 * len(texts))]
    for i, k in zip(*x.block_keys(), strict=True):
        got[i].add(int(k))
    for i, t in enumerate(texts):
        alone = lines.Lines(*textkit.utf8(pa.array([t])))
        assert got[i] == got[i + len(texts)] == {int(k) for k in alone.block_keys()[1]}, t
    assert got[4] & got[5] and not got[0] and got[1]


@given(st.text(alphabet="a1.@ -+(é", max_size=24))
@settings(max_examples=300, deadline=None)
def test_rules_find_the_leftmost_matches(text):
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 12 <= len(pii._digits(m)) <= 19 and pii.luhn(pii._digits(m)), "phone": lambda m: 9 <= len(pii._digits(m)) <= 15}
    want = sorted(((m.start(), m.end(), k) for k, s in shapes.items() for m in re.finditer(s, text) if ok[k](m[0])), key=lambda s: (s[0], pii.KINDS.index(s[2])))
    assert pii.rule_spans(text) == want


def test_the_field_finds_what_rules_miss_and_little_else():
    field = pii.train(pii.labelled_table())
    table = pii.labelled_table(seed=99, rows=200)
    got = pii.field_spans(field, *textkit.utf8(pa.array([t for t, _ in table])))
    found = [(i, s) for i, spans in got.items() for s in spans]
    true = {(i, s) for i, (_, spans) in enumerate(table) for s in spans}
    hits = sum(x in true for x in found)
    assert hits / len(true) >= 0.9 and hits / len(found) >= 0.95


#: Written by hand, not by the generator: what a kind looks like in running text.
NOTATIONS = [
    ("email", "reach me at john.doe (at) example (dot) com today"), ("email", "write to mary_k [at] example [dot] org please"), ("email", "email: bob(at)example.com or"), ("email", "from jim[at]example[dot]com came"),
    ("phone", "call (212) 555-0187 after five"), ("phone", "phone 415-555-2671 now"), ("phone", "his number is 415.555.2671 he said"), ("phone", "dial 1-800-555-0199 for help"), ("phone", "tel 020 7946 0958 in london"),
    ("phone", "ring (020) 7946 0958 or"), ("phone", "the number 555 123 4567 rang"), ("ip", "server 10[.]0[.]0[.]12 was down"), ("ip", "host 192 dot 168 dot 1 dot 44 failed"), ("card", "card 4111.1111.1111.1111 was used"),
    ("email", "my mail is ann at example dot net ok"), ("email", "contact sue at mail.example.org soon"), ("ip", "from 172(.)16(.)4(.)9 it came"), ("card", "number 4012.8888.8888.1881 expires"), ("email", "to kim(at)example(dot)org with love"), ("phone", "fax 0161-496000 is off"),
]
#: More of them.
OTHERS = [
    ("email", "please mail tom.smith at gmail dot com asap"), ("email", "lisa_w(at)web.de wrote"), ("email", "you can find me under peter [at] firm [dot] co [dot] uk"), ("email", "my address: info AT company DOT org"), ("email", "paul at mail dot school dot edu is right"),
    ("phone", "her cell is (646) 555 0123 ok"), ("phone", "030 1234 5678 is the office"), ("phone", "Tel. 0171/555-0134 mornings"), ("phone", "call 001 212 555 0199 collect"), ("phone", "whatsapp 917-555-0142."), ("phone", "fax: 0221-987654"),
    ("ip", "ping 10 dot 1 dot 2 dot 3 first"), ("ip", "blocked 203[.]0[.]113[.]7 today"), ("ip", "at 198(.)51(.)100(.)23 again"), ("card", "visa 4111.1111.1111.1111 thru 12"), ("card", "used 5500.0000.0000.0004, declined"),
]
PLAIN = ["the ratio was 3.14 to 1 at best", "call 911 in 2020 or 2021", "isbn 978-3-16 148410 0", "at the top dot of the page", "12 34 56 78 are numbers", "he looked at her. then left", "meet at noon. the dot com era", "arrive at p. 7 of 9", "we ate at joe. then at home.", "we met at the corner of 5th street at noon", "version 3.11.2 was out on 2021-04-05", "it cost 1,299.00 dollars and 50 cents", "chapter 12, section 4.5.6 says so", "look at it. the dot on the i", "room 404 at 10:30 am", "between 1914 and 1918 or 1939 and 1945"]


def test_the_field_on_notations_written_by_hand():
    field = pii.trained()
    whole = NOTATIONS + OTHERS
    got = pii.field_spans(field, *textkit.utf8(pa.array([t for _, t in whole])))
    found = [any(k == kind for *_, k in got.get(i, [])) for i, (kind, _) in enumerate(whole)]
    assert sum(found) >= 0.9 * len(found)
    assert not pii.field_spans(field, *textkit.utf8(pa.array(PLAIN)))


def test_lines_left_out_can_hold_nothing_valid():
    rnd = random.Random(1)
    texts = ["\n".join(" ".join(rnd.choice(["at", "cat", "a@b.c", "7", "dot", "x.", "é", "AT"]) for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    data, offsets = textkit.utf8(pa.array(texts))
    starts, ends, chain = pii.chains(data, offsets)
    shown = {}
    for a, b, c in zip(starts, ends, chain, strict=True):
        shown.setdefault(int(c), []).append(data[a:b].tobytes().decode())
    lines_ = [line.split() for t in texts for line in t.split("\n")]
    kept = [w for w in lines_ if any(c.isdigit() or c == "@" for c in "".join(w)) or re.search(r"(?i)\bat\b", " ".join(w))]
    assert [w for w in shown.values()] == [w for w in kept if w]


def test_field_spans_count_code_points():
    got = pii.field_spans(pii.trained(), *textkit.utf8(pa.array(["é ü\nplease call (212) 555-0187 now", None, ""])))
    assert got == {0: [(16, 30, "phone")]}


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    field = pii.Field([], [], rng.normal(size=(pii._N, pii._N)))
    e, stretch = rng.normal(size=(7, pii._N)) * 2, np.array([0, 0, 0, 1, 2, 2, 2])
    got = field.viterbi(e, stretch)

    def best(rows):
        top = None
        for y in np.ndindex(*[pii._N] * len(rows)):
            if pii.LABELS[y[0]][0] == "I" or any(not pii._ALLOWED[a, b] for a, b in zip(y, y[1:], strict=False)):
                continue
            s = sum(e[r, k] for r, k in zip(rows, y, strict=True)) + sum(field.steps[a, b] for a, b in zip(y, y[1:], strict=False))
            top = max(top, (s, y)) if top else (s, y)
        return list(top[1])

    assert got.tolist() == best([0, 1, 2]) + best([3]) + best([4, 5, 6])


def test_nnpu_separates_with_an_unlabelled_mixture():
    rng = np.random.default_rng(0)
    toxic, clean = (rng.random((400, 20)) < 0.05).astype(float), (rng.random((3600, 20)) < 0.05).astype(float)
    toxic[:, :5] = rng.random((400, 5)) < 0.9
    w, b = toxicity.fit_nnpu(toxic[:200], np.vstack([clean, toxic[200:]]), 0.05)
    score = lambda x: 1 / (1 + np.exp(-(x @ w + b)))
    assert (score(toxic[200:]) >= 0.7).mean() > 0.8 and (score(clean) >= 0.7).mean() < 0.01


def test_the_risk_and_its_gradients_against_finite_differences():
    rng = np.random.default_rng(3)
    p, u, w, prior = rng.random((30, 6)), rng.random((80, 6)), rng.normal(size=7), 0.2
    loss = lambda z: np.log1p(np.exp(-z))
    parts = lambda w: (prior * loss(p @ w[:-1] + w[-1]).mean(), loss(-(u @ w[:-1] + w[-1])).mean() - prior * loss(-(p @ w[:-1] + w[-1])).mean())
    negative, towards, slope = toxicity.nnpu_risk(w, p, u, prior)
    assert np.isclose(negative, parts(w)[1])
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        numeric = [(a - b) / 2e-6 for a, b in zip(parts(w + step), parts(w - step), strict=True)]
        assert np.allclose(numeric, [towards[i], slope[i]], atol=1e-6)


def test_nra_gives_the_top_k_and_stops_early_where_it_can():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * rng.normal(0, 0.125, (3000, 16))).astype(np.int64)
    x[10:20] = x[5]
    s = topk.Search(np.arange(40), x[:40], 10)
    for lo in range(0, 3000, 1000):
        s.block(np.arange(lo, lo + 1000), x[lo : lo + 1000])
    query, score, vec = s.found
    exact = x[:40] @ x.T
    exact[np.arange(40), np.arange(40)] = -(10**12)
    for i in range(40):
        want = np.lexsort((np.arange(3000), -exact[i]))[:10]
        assert vec[query == i].tolist() == want.tolist() and score[query == i].tolist() == exact[i][want].tolist()
    spiky = np.zeros((2000, 8), np.int64)
    spiky[:, 0] = np.arange(2000)
    s = topk.Search(np.array([-1]), np.array([[1] + [0] * 7]), 5)
    s.block(np.arange(2000), spiky)
    assert s.found[2].tolist() == [1999, 1998, 1997, 1996, 1995] and s.read < 2 * 8 * 2000


@pytest.mark.parametrize("many", [False, True])
def test_bags_tell_long_unlike_texts_apart(many, monkeypatch):
    """Two texts without a word in common: far over the edits that a similarity of 0.8 allows."""
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)]
    a, b = " ".join(words[:60]), " ".join(words[200:260])
    near = a[:200] + "xyz" + a[220:]
    monkeypatch.setattr(lines, "WIDE_BAGS", 2 if many else 1 << 14)
    least = lines.least_edits(lines._bags([a, b, near], 3), np.array([0, 0]), np.array([1, 2]))
    assert least[0] <= lines.edit_distance(a, b) and least[1] <= lines.edit_distance(a, near) <= 20
    assert many or least[0] > 0.2 * len(a)


def test_bags_of_many_texts():
    """Counts of more texts than are counted at once."""
    texts = ["ab" * (i % 7) + "c" for i in range(9001)]
    for q, bag in enumerate(lines._bags(texts, 3), 1):
        assert bag.sum(1).tolist() == [max(0, len(t) - q + 1) for t in texts]
