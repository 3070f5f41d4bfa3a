"""Personal data by rules and a linear-chain conditional random field over word shapes.

The rules find well-formed e-mail addresses, IPv4 addresses, card and phone numbers. The field adds
what is written otherwise (numbers without a plus sign, spelled-out addresses): it is trained on a
small labelled table by maximum likelihood, and decoded by Viterbi in numpy batches over all words of
every text, a line being one chain. Spans of the rules stand; the field's spans that touch one are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textkit import LOWER, Spans, mixed, slices, utf8, word_spans

KINDS = ("email", "ip", "card", "phone")

# Rules --------------------------------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin within a run of digits: what fails from the run's start fails from there too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches; each lies in one run of its characters around an ``@``."""
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = _EMAIL.match(text, left) if left < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the rules' findings, by start and then kind."""
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# The labelled table -------------------------------------------------------------------------------


def labelled_table(seed: int = 7, rows: int = 700) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small table of texts and the personal data in them, made by rule: values in several notations
    between filler words, beside look-alikes (dates, versions, sums, keys) that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    word = lambda: "".join(pick("an", "er", "the", "tion", "le", "qu", "ein", "cio", "re", "st", "mo", "da") for _ in range(int(rng.integers(1, 4))))

    def value(kind: str) -> str:
        if kind == "email":
            at, dot = pick(("@", "."), (" at ", " dot "), (" at ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" AT ", " DOT "))
            host = pick(f"mail{digits(1)}.example.com", "example.org", "example.net", f"{word()}.example.net", f"mail.{word()}.edu", f"{word()}.co.uk", f"{word()}.com", f"{word()}.{pick('org', 'net', 'io', 'de')}", f"mail.{word()}.org").replace(".", dot)
            name = lambda: "".join(pick(*"abcdefghijklmnoprstuvwy") for _ in range(int(rng.integers(2, 8))))
            return pick(word(), name(), name(), f"{word()}.{digits(2)}", f"{name()}.{name()}", f"{word()}_{word()}", f"{word()}{digits(2)}") + at + host
        if kind == "ip":
            parts = [str(int(rng.integers(1, 256))) for _ in range(4)]
            parts = pick(parts, parts, [digits(1), digits(1), digits(1), digits(2)], ["10", "0", digits(1), parts[0]])
            return pick(".", ".", " dot ", "[.]", "(.)", "[dot]").join(str(int(x)) for x in parts)
        if kind == "card":
            number = digits(15)
            number += next(c for c in "0123456789" if luhn(number + c))
            return pick("", " ", "-", ".").join(number[i : i + 4] for i in range(0, 16, 4))
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"0{digits(2)} {digits(4)} {c}", f"(0{digits(2)}) {digits(4)} {c}", f"0{digits(3)}-{digits(6)}", f"00{digits(2)} {digits(2)} {digits(4)} {c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}")

    def lookalike() -> str:
        return pick(
            f"20{digits(2)}-0{rng.integers(1, 10)}-1{digits(1)}", f"version {digits(1)}.{digits(1)}.", f"{digits(1)},{digits(3)}.{digits(2)}", f"{digits(4)}", f"section {digits(2)}", f"{digits(2)}%", f'token = "{hashlib.sha1(digits(9).encode()).hexdigest()}"',
            f"{digits(2)}:{digits(2)}", f"${digits(3)}", f"{word()}{digits(3)}", f"{digits(1)}th", f"{digits(5)}", f"dot {word()}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(3)} {digits(2)} {digits(3)}", f"no. {digits(6)}", f"{digits(8)}", f"{digits(25)}", f"at {word()}", f"look at the {word()}.", f"1{digits(1)}.{digits(2)}", f"Version 2.0, {word()}", f"{digits(1)} {digits(1)} {digits(1)}", f"{word()}-{digits(2)}", f"({digits(2)})",
        )

    out = []
    for _ in range(rows):
        text, spans = "", []
        for part in range(int(rng.integers(1, 4))):
            text += " ".join([word() for _ in range(int(rng.integers(2, 6)))] + ([pick("call", "phone", "card", "mail", "from", "is", "token", "host", "number", "tel", "email:", "to")] if rng.random() < 0.3 else [])) + " "
            if rng.random() < 0.5:
                kind = pick(*KINDS)
                v = value(kind)
                spans.append((len(text), len(text) + len(v), kind))
            else:
                v = lookalike()
            text += v + pick("", "", ".", ",", "###", "&&&") + " "
        out.append((text + word(), spans))
    return out


# Words in stretches and their features ------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)  # a byte as it shows in a shape
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = ord("d"), ord("X"), ord("x"), ord("x")
_EDGE = np.uint64(0x5A17)
#: Words that one batch of chains holds, filled up to its longest; a longer chain is a batch of its own.
BATCH = 1 << 16
TEMPLATES = 13


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and where each begins."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])], at


def chains(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and chain numbers of words; a chain is a line of a row. Lines in which nothing can be
    valid are left out: no digit, no ``@`` and no ``at`` (see ``_valid``)."""
    starts, ends, first = word_spans(data, offsets)
    fresh = np.zeros(len(starts) + 1, bool)
    fresh[first[:-1]] = True
    fresh[np.searchsorted(starts, np.flatnonzero(data == 10))] = True
    chain = np.cumsum(fresh[:-1]) - 1
    may = (data == 64) | ((data >= 48) & (data < 58))
    if len(data) > 1:
        low = LOWER[data]
        letter = (low >= 97) & (low < 123)
        goes_on = np.zeros(len(data) + 1, bool)  # a letter right after a letter of the same row
        goes_on[1:-1] = letter[1:] & letter[:-1]
        goes_on[offsets] = False
        may[:-1] |= (low[:-1] == 97) & (low[1:] == 116) & ~goes_on[:-2] & ~goes_on[2:]
    sums = np.concatenate([[0], np.cumsum(may, dtype=np.int32)])
    held = np.zeros(len(starts) + 1, bool)
    held[chain[sums[ends] > sums[starts]]] = True
    kept = held[chain]
    return starts[kept], ends[kept], chain[kept]


def token_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """``TEMPLATES`` 64-bit features for each word: its shapes, letters and digits, and its neighbours' shapes."""
    buf, at = _gathered(data, starts, ends)
    shape = _CLASS[buf]
    head = np.zeros(len(buf) + 1, bool)
    head[at[:-1]] = True
    same = np.zeros(len(buf), bool)
    same[1:] = (shape[1:] == shape[:-1]) & ~head[1:-1]
    short = []
    for keep in (~same | (shape == 100), ~same):  # digits one by one, then runs as one
        cum = np.concatenate([[0], np.cumsum(keep)])
        short.append(Spans(shape[keep]).hash(cum[at[:-1]], cum[at[1:]]))
    letters = ((buf >= 97) & (buf < 123)) | ((buf >= 65) & (buf < 91)) | (buf >= 128)
    cum = np.concatenate([[0], np.cumsum(letters)])
    word = Spans(LOWER[buf[letters]]).hash(cum[at[:-1]], cum[at[1:]])
    count = np.concatenate([[0], np.cumsum(shape == 100)])
    n = np.minimum(count[at[1:]] - count[at[:-1]], 40).astype(np.uint64)

    # which marks of an address a word holds: @ or a bracketed at, a bracketed dot, a digit, a letter
    low, word_of = LOWER[buf], np.repeat(np.arange(len(starts)), np.diff(at))
    marks = np.zeros(len(starts), np.uint64)
    marks[n > 0] |= np.uint64(1)
    for bit, hit in ((2, buf == 64), (4, letters)):
        marks[word_of[hit]] |= np.uint64(bit)
    opens = np.flatnonzero((buf == 40) | (buf == 91))
    opens = opens[opens + 2 < at[word_of[opens] + 1]]
    marks[word_of[opens[(low[opens + 1] == 97) & (low[opens + 2] == 116)]]] |= np.uint64(2)
    marks[word_of[opens[(low[opens + 1] == 46) | ((low[opens + 1] == 100) & (low[opens + 2] == 111))]]] |= np.uint64(8)

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        out = np.full(len(x), _EDGE, np.uint64)
        if len(x) > abs(by):
            a, b = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
            out[b] = np.where(stretch[a] == stretch[b], x[a], _EDGE)
        return out

    exact, runs = short
    return np.stack([exact, runs, word, mixed(n + np.uint64(11)), mixed(marks + np.uint64(77)), moved(exact, -1), moved(exact, 1), moved(runs, -2), moved(runs, 2), moved(word, -1), moved(word, 1), mixed(exact ^ moved(runs, -1)), mixed(exact ^ moved(runs, 1))])


# The field ----------------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_N = len(LABELS)
#: An inside label follows only its own kind.
_ALLOWED = np.array([[b[0] != "I" or (a[0] != "O" and a[2:] == b[2:]) for b in LABELS] for a in LABELS])


@dataclass
class Field:
    keys: list[np.ndarray]  # sorted, by template
    weights: list[np.ndarray]  # (features + 1, labels); the last row is for unknown ones
    steps: np.ndarray  # (labels, labels)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], _N))
        for keys, weights, h in zip(self.keys, self.weights, features, strict=True):
            out += weights[self.places(keys, h)]
        return out

    @staticmethod
    def places(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, h)
        known = at < len(keys)
        known[known] = keys[at[known]] == h[known]
        return np.where(known, at, len(keys))

    def viterbi(self, emissions: np.ndarray, stretch: np.ndarray) -> np.ndarray:
        """The best labels of every stretch; stretches of like length are decoded together."""
        labels = np.zeros(len(emissions), np.int8)
        if not len(emissions):
            return labels
        first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
        size = np.diff(np.append(first, len(emissions)))
        order = np.argsort(size, kind="stable")
        steps = np.where(_ALLOWED, self.steps, -1e9)
        begin = np.where([x[0] == "I" for x in LABELS], -1e9, 0.0)
        # chains of like length together, as many as fill a batch up to its longest
        hi = len(order)
        while hi:
            lo = max(0, hi - max(1, BATCH // int(size[order[hi - 1]])))
            some, hi = order[lo:hi], lo
            n, t = size[some], int(size[some].max())
            at = first[some][:, None] + np.minimum(np.arange(t), n[:, None] - 1)
            best, back = emissions[at[:, 0]] + begin, np.zeros((t, len(some), _N), np.int8)
            for i in range(1, t):
                paths = best[:, None, :] + steps.T
                back[i] = way = paths.argmax(2)
                best = np.where((i < n)[:, None], np.take_along_axis(paths, way[:, :, None], 2)[:, :, 0] + emissions[at[:, i]], best)
            now = best.argmax(1)
            for i in range(t - 1, -1, -1):
                own = i < n
                labels[at[own, i]] = now[own]
                if i:
                    now = np.where(own, back[i, np.arange(len(some)), now], now)
        return labels


def train(table: list[tuple[str, list[tuple[int, int, str]]]], *, rounds: int = 100, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """The field that maximises the likelihood of the table's labels, by gradients from the
    forward-backward recursions."""
    data, offsets = utf8(pa.array([t for t, _ in table] or [""]))
    starts, ends, first = word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    y = np.zeros(len(starts), np.int64)
    for i, (_, spans) in enumerate(table):  # the table's texts are ASCII: bytes are characters
        for a, b, kind in spans:
            inside = np.flatnonzero((row == i) & (starts < offsets[i] + b) & (ends > offsets[i] + a))
            y[inside] = LABELS.index(f"I-{kind}")
            y[inside[:1]] = LABELS.index(f"B-{kind}")
    feats = token_features(data, starts, ends, row)
    counted = [np.unique(h, return_counts=True) for h in feats]
    keys = [k[n > 1] for k, n in counted]  # what is seen once stands for what is not known, which so gets weights of its own
    field = Field(keys, [np.zeros((len(k) + 1, _N)) for k in keys], np.zeros((_N, _N)))
    places = [Field.places(k, h) for k, h in zip(keys, feats, strict=True)]
    sums = []  # each feature's words side by side
    for place in places:
        order = np.argsort(place, kind="stable")
        which, cuts = np.unique(place[order], return_index=True)
        sums.append((order, cuts, which))
    size = np.diff(first)
    t = int(size.max(initial=1))
    at = first[:-1][:, None] + np.minimum(np.arange(t), np.maximum(size[:, None] - 1, 0))
    on = np.arange(t) < size[:, None]
    moves = np.zeros((_N, _N))
    for i in range(1, t):
        np.add.at(moves, (y[at[on[:, i], i - 1]], y[at[on[:, i], i]]), 1)
    gold = np.zeros((len(y), _N))
    gold[np.arange(len(y)), y] = 1
    begin = np.where([x[0] == "I" for x in LABELS], -1e9, 0.0)
    params = [*field.weights, field.steps]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        e = field.emissions(feats)
        trans = np.where(_ALLOWED, field.steps, -1e9)
        alpha = [e[at[:, 0]] + begin]
        for i in range(1, t):
            x = alpha[-1][:, :, None] + trans
            m = x.max(1)
            alpha.append(np.where(on[:, i : i + 1], m + np.log(np.exp(x - m[:, None]).sum(1)) + e[at[:, i]], alpha[-1]))
        total = np.logaddexp.reduce(alpha[-1], axis=1)
        beta = np.zeros_like(alpha[-1])
        marg, pair = np.zeros_like(e), np.zeros((_N, _N))
        for i in range(t - 1, -1, -1):
            own = on[:, i]
            marg[at[own, i]] = np.exp(alpha[i] + beta - total[:, None])[own]
            if i:
                after = (e[at[:, i]] + beta)[:, None, :]
                joint = np.exp(alpha[i - 1][:, :, None] + trans + after - total[:, None, None])
                pair += joint[own].sum(0)
                x = trans + after
                m = x.max(2)
                beta = np.where(own[:, None], m + np.log(np.exp(x - m[:, :, None]).sum(2)), beta)
        slope = gold - marg
        grads = []
        for p, (order, cuts, which) in zip(field.weights, sums, strict=True):
            g = np.zeros_like(p)
            g[which] = np.add.reduceat(slope[order], cuts, axis=0)
            grads.append(g)
        grads.append(np.where(_ALLOWED, moves - pair, 0))
        for p, g, (m, v) in zip(params, grads, state, strict=True):
            g = g / len(table) - decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return field


_TRIM = "\"'`<>{}.,;:!?#&*$%|=~"


def _valid(kind: str, text: str) -> bool:
    d = _digits(text)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(re.search(r"@|\bat\b", text, re.I)) and bool(re.search(r"\.|\bdot\b", text, re.I))


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
    """The field's spans by row, in code points of the row's text."""
    starts, ends, stretch = chains(data, offsets)
    if not len(starts):
        return {}
    labels = field.viterbi(field.emissions(token_features(data, starts, ends, stretch)), stretch)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])  # code points
    out: dict[int, list[tuple[int, int, str]]] = {}
    opens = np.flatnonzero(labels % 2 == 1)  # B labels
    kinds = (labels - 1) // 2
    for i in opens.tolist():
        j = i
        while j + 1 < len(labels) and stretch[j + 1] == stretch[i] and labels[j + 1] == labels[i] + 1:
            j += 1
        a, b = int(starts[i]), int(ends[j])
        raw = data[a:b].tobytes().decode("utf-8", "replace")
        left = len(raw) - len(raw.lstrip(_TRIM))
        core = raw.strip(_TRIM)
        if core.endswith(")") and "(" not in core:
            core = core.rstrip(")")
        kind = KINDS[kinds[i]]
        if core and _valid(kind, core):
            row = int(np.searchsorted(offsets, a, side="right")) - 1
            head = int(before[a] - before[offsets[row]]) + left
            out.setdefault(row, []).append((head, head + len(core), kind))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_trained: dict[str, Field] = {}


def trained(table: list | None = None) -> Field:
    """The field of a labelled table (default: the one made by rule), trained once a session."""
    table = labelled_table() if table is None else table
    name = hashlib.sha256(repr(table).encode()).hexdigest()
    if name not in _trained:
        _trained[name] = train(table)
    return _trained[name]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, table: list | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, base_sha256, spans)`` of every row.

    ``base`` lists the rules' spans as ``kind:start:end`` (code points, end exclusive), by start and
    then in the order of ``KINDS``; the counts and the digest are of these. ``spans`` also has the
    field's. Null and empty texts have none; rows without an id and repeated rows are rows like any
    other; other columns are never read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    field = trained(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            data, offsets = utf8(texts)
            rows = []
            for lo, hi in slices(offsets):
                more = field_spans(field, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for i in range(lo, hi):
                    text = texts[i].as_py() or ""
                    base = rule_spans(text)
                    extra = [s for s in more.get(i - lo, ()) if all(s[1] <= a or s[0] >= b for a, b, _ in base)]
                    n = [sum(k == kind_ for *_, k in base) for kind_ in KINDS]
                    shown = listed(base)
                    rows.append((*n, shown, hashlib.sha256(shown.encode()).hexdigest(), listed(sorted([*base, *extra], key=lambda s: (s[0], KINDS.index(s[2]))))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "spans"])

    inner = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return inner.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, spans string")
