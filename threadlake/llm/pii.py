"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The base patterns are exact. The network is trained in numpy on windows of a bounded sample whose labels are the base
spans, some of them rewritten as people disguise them ("(at)", "[dot]", "at ... dot", 00 for +). It reads characters without
case, brackets as one kind, digits and signs of every script as ASCII. Its overlapping windows cover all digits, @ signs, bracketed
"at" and "dot" and bare "at ... dot", from the start of the word before: a span of its kinds holds one of these, as
plausible() asks. Each window is decoded by Viterbi; every character takes its label from the window in which it
lies most centrally, and spans are read off the whole text's labels. What meets a base span gives way to it.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import ship

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. They are written so that a failed run of characters is not tried again from each of its characters:
#: a match begins where such a run does, or where the match before ended (see _matches).
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"{LOCAL}++@{DOMAIN}+(?:\.{DOMAIN}+)++"
PATTERNS = {
    "email": re.compile(rf"(?<!{LOCAL}){EMAIL}"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
EMAIL_HERE = re.compile(EMAIL)
DIGIT = re.compile("[0-9]")
#: What a window must be near to, in plain() text.
TRIGGER = re.compile(r"[0-9@]+|\( ?(?:at|dot) ?\)|\bat\b(?=.{1,80}?\bdot\b)|\bdot\b", re.S)
WIDTH, STRIDE, MARGIN = 64, 32, 24
#: A window begins so far before a trigger at most, to take in the start of its word.
REACH = 64
#: Bounds of the training sample: documents drawn, windows kept.
SAMPLE_DOCS, SAMPLE_WINDOWS = 6000, 2000
#: Each window whose spans begin in it is learned from in so many disguises too.
VARIANTS = 4
HIDDEN, EPOCHS, BATCH, RATE = 16, 14, 64, 0.02
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
SIGNS = ".@+-()_%,:;/#$&*'\"=|!?\\~^`"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := EMAIL_HERE.match(text, at) or PATTERNS["email"].search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind, then start; leftmost matches, those that fail their test dropped. Takes time in proportion to the text."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in _emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in PATTERNS["ip"].finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in PATTERNS["card"].finditer(text):
            if m.end() - m.start() <= 19 * 2:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PATTERNS["phone"].finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


class _Plain(dict):
    """What a code point counts as, for str.translate: digits and full-width signs as ASCII, any bracket round, small letters, any dash and blank as one."""

    def __missing__(self, o: int) -> int:
        c = chr(o)
        if 0xFF01 <= o <= 0xFF5E:
            c = chr(o - 0xFEE0)
        if c.isdecimal():
            c = str(int(c))
        elif c in "[{<":
            c = "("
        elif c in "]}>":
            c = ")"
        elif 0x2010 <= o <= 0x2015 or o == 0x2212:
            c = "-"
        elif c.isspace():
            c = "\n" if c in "\n\r" else " "
        elif c.isalpha():
            low = c.lower()
            c = low if len(low) == 1 else c
        self[o] = ord(c)
        return ord(c)


class _Codes(dict):
    def __missing__(self, o: int) -> int:
        c = chr(o)
        k = SIGNS.find(c)
        if "0" <= c <= "9":
            k = 1
        elif c == " ":
            k = 2
        elif c == "\n":
            k = 3
        elif "a" <= c <= "z":
            k = 6 + o - 97
        elif k >= 0:
            k += 32
        else:
            k = 4 if c.isalpha() else 5
        self[o] = k
        return k


_plain, _codes = _Plain(), _Codes()
CLASSES = 32 + len(SIGNS)


def plain(text: str) -> str:
    """The text as the network reads it, character by character."""
    return text.translate(_plain)


def codes(text: str) -> np.ndarray:
    """Character classes of plain text: 0 outside, digit, blank, line end, other letters, the rest, each of a-z, each sign."""
    return np.fromiter(map(_codes.__getitem__, map(ord, text)), np.int64, len(text))


def windows(text: str) -> list[int]:
    """Starts of overlapping windows over plain text that cover every trigger, from the start of its word, with a margin on both sides."""
    regions: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a = m.start()
        first = max(text.rfind(" ", max(0, a - REACH), a), text.rfind("\n", max(0, a - REACH), a)) + 1
        a, b = max(0, min(a - MARGIN, max(first, a - REACH))), m.end() + MARGIN
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    starts: list[int] = []
    for a, b in regions:
        starts += range(a, max(a + 1, min(b, len(text)) - WIDTH + STRIDE), STRIDE)
    return starts


class Network:
    """Parameters and passes; p holds arrays by name. Directions are 0 (left to right) and 1."""

    def __init__(self, p: dict[str, np.ndarray] | None = None):
        if p is None:
            r = np.random.default_rng(0)
            p = {"trans": r.normal(0, 0.1, (TAGS, TAGS)), "first": np.zeros(TAGS), "out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS)}
            for d in (0, 1):
                p[f"x{d}"] = r.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
                p[f"h{d}"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
                p[f"x{d}"][:, HIDDEN : 2 * HIDDEN] += 1  # gates open to the past at first
            p = {k: v.astype(np.float32) for k, v in p.items()}
        self.p = p

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Tag scores (windows, WIDTH, TAGS) of character classes x, and what the backward pass needs."""
        n, t = x.shape
        h_all = np.zeros((n, t, 2 * HIDDEN), np.float32)
        memory = []
        for d in (0, 1):
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            steps = range(t) if d == 0 else range(t - 1, -1, -1)
            wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
            for s in steps:
                z = wx[x[:, s]] + h @ wh
                gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                before = (h, c)
                c = f * c + i * g
                tc = np.tanh(c)
                h = o * tc
                h_all[:, s, d * HIDDEN : (d + 1) * HIDDEN] = h
                if keep:
                    memory.append((d, s, before, i, f, o, g, tc))
        return h_all @ self.p["out"] + self.p["bias"], h_all, memory

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences y, and its gradient."""
        n, t = x.shape
        e, h_all, memory = self.emissions(x, keep=True)
        trans, first = self.p["trans"].astype(float), self.p["first"].astype(float)
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.zeros((n, t, TAGS)), np.zeros((n, t, TAGS))
        alpha[:, 0] = first + e[:, 0]
        for s in range(1, t):
            alpha[:, s] = lse(alpha[:, s - 1][:, :, None] + trans, 1) + e[:, s]
        for s in range(t - 2, -1, -1):
            beta[:, s] = lse(trans + (e[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None])
        rows = np.arange(n)[:, None]
        path = e[rows, np.arange(t), y].sum(axis=1) + first[y[:, 0]] + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        grad = {"first": marginal[:, 0].sum(axis=0) - np.bincount(y[:, 0], minlength=TAGS), "trans": np.zeros((TAGS, TAGS))}
        for s in range(1, t):
            grad["trans"] += np.exp(alpha[:, s - 1][:, :, None] + trans + (e[:, s] + beta[:, s])[:, None, :] - z[:, None, None]).sum(axis=0)
        grad["trans"] -= np.bincount((y[:, :-1] * TAGS + y[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        de = marginal
        de[rows, np.arange(t), y] -= 1
        de = de.astype(np.float32)
        grad["out"] = np.einsum("nth,ntk->hk", h_all, de)
        grad["bias"] = de.sum(axis=(0, 1))
        dh_all = de @ self.p["out"].T
        for d in (0, 1):
            grad[f"x{d}"], grad[f"h{d}"] = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"h{d}"])
        carry = {d: (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)) for d in (0, 1)}
        for d, s, (h0, c0), i, f, o, g, tc in reversed(memory):
            dh, dc = carry[d]
            dh = dh + dh_all[:, s, d * HIDDEN : (d + 1) * HIDDEN]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(grad[f"x{d}"], x[:, s], dz)
            grad[f"h{d}"] += h0.T @ dz
            carry[d] = (dz @ self.p[f"h{d}"].T, dc * f)
        return float((z - path).mean()), {k: (v / n).astype(np.float32) for k, v in grad.items()}

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        e, _, _ = self.emissions(x)
        n, t, _ = e.shape
        v = self.p["first"] + e[:, 0]
        back = np.zeros((t, n, TAGS), np.int8)
        for s in range(1, t):
            a = v[:, :, None] + self.p["trans"]
            back[s] = a.argmax(axis=1)
            v = a.max(axis=1) + e[:, s]
        out = np.empty((n, t), np.int8)
        out[:, -1] = v.argmax(axis=1)
        for s in range(t - 1, 0, -1):
            out[:, s - 1] = back[s][np.arange(n), out[:, s]]
        return out


def train(pairs: list[tuple[str, list[tuple[str, int, int]]]]) -> Network:
    """Fit on windows of WIDTH characters at most with their spans."""
    net = Network()
    if not pairs:
        net.p["bias"][0] = 50.0
        return net
    x, y = np.zeros((len(pairs), WIDTH), np.int64), np.zeros((len(pairs), WIDTH), np.int64)
    for r, (text, spans) in enumerate(pairs):
        x[r, : len(text[:WIDTH])] = codes(plain(text[:WIDTH]))
        for kind, a, b in spans:
            k = KINDS.index(kind)
            y[r, max(a, 0) : b] = 2 + 2 * k
            if 0 <= a < WIDTH:
                y[r, a] = 1 + 2 * k
    rng = np.random.default_rng(1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            step += 1
            _, grad = net.gradient(x[order[lo : lo + BATCH]], y[order[lo : lo + BATCH]])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                net.p[k] -= (rate * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
    return net


def _hidden(kind: str, word: str, pick: random.Random) -> str:
    """The span as people may write it to hide it, or with other digits."""
    if kind != "email":
        word = "".join(str(pick.randrange(10)) if c.isdecimal() else c for c in word)
    style = pick.randrange(4)
    if kind == "email":
        # other letters and lengths, so that names and endings of the sample are not learned by heart
        other = lambda m: "".join(chr(97 + pick.randrange(26)) for _ in range(max(2, len(m[0]) + pick.randrange(-2, 3)))) if pick.random() < 0.7 else m[0]
        local, _, domain = word.partition("@")
        local = re.sub("[A-Za-z]+", other, local) + pick.choice(("", "", f"{pick.choice('._-')}{pick.choice(('smith', 'b', 'lee77'))}"))
        word = f"{local}@{re.sub('[A-Za-z]+', other, domain)}"
        if style == 0:
            return word.replace("@", " at ").replace(".", " dot ")
        gap = pick.choice(("", " "))
        if style < 3:
            word = word.replace("@", f"{gap}(at){gap}")
        return word.replace(".", f"{gap}(dot){gap}") if style in (1, 3) else word
    if kind == "phone":
        lead = ("00", "+", "+", "00 ")[style]
        return lead + (word[1:] if pick.random() < 0.5 else re.sub("[^0-9]+", pick.choice((" ", "-", ".", "")), word[1:]))
    if kind == "card":
        return pick.choice((" ", "-", ".", "")).join(re.findall("[0-9]{1,4}", re.sub("[^0-9]", "", word)))
    return word.replace(".", (".", "(.)", " . ", "(dot)")[style])


def disguised(text: str, spans: list[tuple[str, int, int]], pick: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The window with its spans rewritten as people hide them, and the spans moved along."""
    out, new, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        out += text[at:a]
        word = _hidden(kind, text[a:b], pick)
        new.append((kind, len(out), len(out) + len(word)))
        out += word
        at = b
    out += text[at:]
    return out[:WIDTH], [(k, a, min(b, WIDTH)) for k, a, b in new if a < WIDTH]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Network:
    """Train on windows of about sample_docs documents drawn by a hash of doc_id, sample_windows windows at most."""
    ship(docs.sparkSession)
    n = max(1, docs.count())
    chosen = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample_docs / n) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans_out, order = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = base_spans(text)
                for a in windows(plain(text)):
                    own = [(k, b - a, min(e, a + WIDTH) - a) for k, b, e in spans if b < a + WIDTH and e > a]
                    ids.append(text[a : a + WIDTH])
                    spans_out.append(",".join(f"{k}:{b}:{e}" for k, b, e in own))
                    # windows with spans come first, in an order of their content
                    order.append(("0" if own else "1") + hashlib.md5(f"{doc_id}:{a}".encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(spans_out, pa.string()), pa.array(order, pa.string())], ["text", "spans", "place"])

    rows = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "text string, spans string, place string")
    own = rows.where("spans <> ''").orderBy("place", "text").limit(sample_windows * 3 // 4).collect() + rows.where("spans = ''").orderBy("place", "text").limit(sample_windows // 4).collect()
    pick = random.Random(0)
    pairs = []
    for r in own:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        pairs.append((r["text"], spans))
        if spans and all(a >= 0 for _, a, _ in spans):
            pairs += (disguised(r["text"], spans, pick) for _ in range(VARIANTS))
    return train(pairs)


#: How far each character of a window is from its middle.
_OFF = np.abs(2 * np.arange(WIDTH) - WIDTH + 1).astype(np.int8)


def tagged(texts: list[str], net: Network) -> list[list[tuple[str, int, int]]]:
    """Spans that the network finds in each plain text, from its windows together."""
    places = [(i, a) for i, t in enumerate(texts) for a in windows(t)]
    own: dict[int, np.ndarray] = {}
    for lo in range(0, len(places), 2048):
        part = places[lo : lo + 2048]
        x = np.zeros((len(part), WIDTH), np.int64)
        for r, (i, a) in enumerate(part):
            c = codes(texts[i][a : a + WIDTH])
            x[r, : len(c)] = c
        for (i, a), tags in zip(part, net.decode(x), strict=True):
            if i not in own:
                own[i] = np.stack([np.full(len(texts[i]), 127, np.int8), np.zeros(len(texts[i]), np.int8)])
            # the window in which a character is most central decides
            off, label = own[i][:, a : a + WIDTH]
            nearer = _OFF[: len(off)] < off
            off[nearer] = _OFF[: len(off)][nearer]
            label[nearer] = tags[: len(off)][nearer]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, (_, label) in own.items():
        at = np.flatnonzero(label)
        if len(at):
            tag = label[at]
            kind = (tag + 1) // 2
            first = np.concatenate([[True], (np.diff(at) > 1) | (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)])
            begin = np.flatnonzero(first)
            out[i] = [(KINDS[k - 1], a, b + 1) for k, a, b in zip(kind[begin].tolist(), at[begin].tolist(), at[np.append(begin[1:], len(at)) - 1].tolist(), strict=True)]
    return out


_DIGITS, _WORD = frozenset("0123456789"), frozenset("abcdefghijklmnopqrstuvwxyz0123456789-")
#: Characters to which a found span is stretched: words are not cut.
_LEFT = dict.fromkeys(KINDS, _DIGITS) | {"email": _WORD | set("._%+"), "phone": _DIGITS | {"+"}}
_RIGHT = dict.fromkeys(KINDS, _DIGITS) | {"email": _WORD}
#: An address that lacks its name before "at", the name, and what may follow an address.
_BARE_AT, _NAME, _MORE = re.compile(r"\( ?at\b|at\b|@"), re.compile(r"[a-z0-9._%+-]+ ?$"), re.compile(r"(?: ?\( ?dot ?\) ?| dot |\.)[a-z0-9-]+")
_AT = re.compile(r"@|\( ?at ?\)|\bat\b.*\bdot\b", re.S)


def plausible(kind: str, span: str) -> bool:
    """Whether a found span of plain text has what its kind cannot be without."""
    digits = len(DIGIT.findall(span))
    if kind == "email":
        return len(span) >= 6 and _AT.search(span) is not None
    if kind == "ip":
        return digits >= 4 and len(re.findall("[0-9]+", span)) == 4
    if kind == "card":
        return 13 <= digits <= 19 and luhn("".join(DIGIT.findall(span)))
    return 8 <= digits <= 15


def all_spans(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """Of each text its base spans, and all spans: the network's are added where they are plausible and meet no base span."""
    out = []
    read = [plain(t) for t in texts]
    for text, same, found in zip(texts, read, tagged(read, net), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        begins = [a for a, _ in taken]
        ends = list(accumulate((b for _, b in taken), max))
        added = []
        for kind, a, b in found:
            while a < b and same[a].isspace():
                a += 1
            while b > a and same[b - 1].isspace():
                b -= 1
            while a > 0 and same[a - 1] in _LEFT[kind]:
                a -= 1
            while b < len(same) and same[b] in _RIGHT[kind]:
                b += 1
            if kind == "email":
                if _BARE_AT.match(same, a) and (m := _NAME.search(same[max(0, a - REACH) : a])):
                    a -= len(m[0])
                while m := _MORE.match(same, b):
                    b = m.end()
            before = bisect_left(begins, b)  # base spans that begin before this one ends
            if a < b and plausible(kind, same[a:b]) and not (before and ends[before - 1] > a):
                added.append((kind, a, b))
        added = [x for i, x in enumerate(added) if not i or x[1] >= max(y[2] for y in added[max(0, i - 1) : i])]
        out.append((base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every row of docs(doc_id, text, ...).

    The first counts and the digest are of the base spans; spans has all, by kind, start, and n_spans counts them. Positions are code points, ends exclusive. A
    null text counts as empty. Null doc_ids and repeated rows are kept; other columns are ignored; an empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = all_spans(texts, own)
            columns = [batch.column(0)]
            columns += [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
            columns += [pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([_join(spans) for _, spans in found], pa.string()), pa.array([len(spans) for _, spans in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network) -> DataFrame:
    """docs(text, ...) with every span replaced by <kind> and all other columns kept; n_chars, where there is one, is counted anew.

    A null text stays null, an empty one empty. Null doc_ids and repeated rows are kept; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net.p)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(sent.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], own)
            out = pa.array([None if t is None else redacted(t, spans) if spans else t for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.names[at], out)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
