"""Language identification of words in context.

The script of a word's letters, by ranges of code points, narrows the languages it may have. Each
word gets a score for each of those from byte n-grams of itself and its borders; a Viterbi pass over the text's
words with a penalty for each switch labels spans, so that mixed texts come apart and single odd words do not.
Distinct words of a slice are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import kernel
from threadlake.llm.pretokens import LETTER, character_classes
from threadlake.session import ship

BITS = 17
ORDERS = (1, 2, 3, 4)
#: Bound of the training sample: about so many documents a language, by a hash of doc_id.
SAMPLE = 2500
SMOOTH = 0.3
SWITCH = 12.0
SLICE = 4 << 20
UNKNOWN = "und"

#: Scripts by ranges of code points: fixed values. Letters elsewhere belong to a script of their own, "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F), (0xFB13, 0xFB17)),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "syriac": ((0x700, 0x74F),),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)),
    "khmer": ((0x1780, 0x17FF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
N_SCRIPTS = len(SCRIPTS) + 1
_BYTE = np.where(kernel.SPACE, 32, kernel.LOWER).astype(np.uint8)
_tables: dict[str, np.ndarray] = {}


def _script_bits() -> np.ndarray:
    """Of each code point one bit for its script if it is a letter, else 0."""
    if "bits" not in _tables:
        t = np.full(0x110000, 1 << len(SCRIPTS), np.uint32)
        for i, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                t[a : b + 1] = 1 << i
        t[character_classes() != LETTER] = 0
        _tables["bits"] = t
    return _tables["bits"]


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word with one byte of border on either side where there is one; the word of each."""
    values = np.concatenate([_BYTE[data], np.zeros(4, np.uint8)])
    four = np.ndarray(len(data), "<u4", values, strides=(1,)) if len(data) else np.zeros(0, np.uint32)
    begin, stop = np.maximum(starts - 1, 0), np.minimum(ends + 1, len(data))
    feats, owner = [], []
    shift = np.uint64(64 - BITS)
    for n in ORDERS:
        count = np.maximum(stop - begin - n + 1, 0)
        w = np.repeat(np.arange(len(starts)), count)
        at = begin[w] + np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        own = four[at].astype(np.uint64) & np.uint64((1 << 8 * n) - 1)
        feats.append(((own * kernel.FIRST + np.uint64(n)) * kernel.SECOND >> shift).astype(np.int32))
        owner.append(w)
    feats.append((kernel.byte_hashes(values[: len(data)], starts, ends)[0] >> shift).astype(np.int32))
    owner.append(np.arange(len(starts)))
    return np.concatenate(feats), np.concatenate(owner)


def scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of the scripts of each word's letters."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    table = _script_bits()
    bits = np.append(table[data & 0x7F] * (data < 0x80), np.uint32(0)).astype(np.uint32)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        bits[lead] = table[kernel.code_points(np.concatenate([data, np.zeros(3, np.uint8)]), lead)]
    return np.bitwise_or.reduceat(bits, np.stack([starts, ends], axis=1).ravel())[::2]


def _members(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(N_SCRIPTS, dtype=np.uint32)) & np.uint32(1)


class Model:
    """Languages by name, n-gram log shares, the scripts that each may have, and each one's share of documents."""

    def __init__(self, langs: list[str], counts: list[np.ndarray], seen: list[np.ndarray], prior: list[float]):
        self.langs = langs
        self.prior = np.array(prior) / max(sum(prior), 1e-300)
        c = np.stack(counts).astype(float) if langs else np.zeros((0, 1 << BITS))
        self.logs = np.log((c + SMOOTH) / (c.sum(axis=1, keepdims=True) + SMOOTH * (1 << BITS))).T.astype(np.float32).copy()
        share = np.stack(seen) / np.maximum(np.stack(seen).sum(axis=1, keepdims=True), 1) if langs else np.zeros((0, N_SCRIPTS))
        self.allowed = share >= 0.01

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each word for each language, the bytes of the word if it has letters (else 0), and whether some language has its script."""
        _, first, inverse = np.unique(kernel.byte_hashes(_BYTE[data], starts, ends)[0], return_index=True, return_inverse=True)
        # in the order of the text, so that what lies between two words is read once
        order = np.argsort(first)
        inverse = np.argsort(order)[inverse]
        s, e = starts[first[order]], ends[first[order]]
        feats, owner = grams(data, s, e)
        own = np.empty((len(s), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            own[:, k] = np.bincount(owner, weights=self.logs[feats, k], minlength=len(s))
        bits = scripts(data, s, e)
        may = (_members(bits).astype(bool)[:, None, :] & self.allowed[None, :, :]).any(axis=2)
        narrowed = may.any(axis=1)
        own = np.where(narrowed[:, None], np.where(may, own, own.min(axis=1, keepdims=True) - 50), 0)
        own -= own.max(axis=1, keepdims=True)
        return own[inverse], np.where(bits > 0, e - s, 0)[inverse], narrowed[inverse]


#: Labels of words: more languages than models can hold.
LABEL = np.int16


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word, for many texts at once: all texts take their next word together."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    base, size = bounds[:-1][order], n[order]
    k = scores.shape[1]
    out = np.zeros(len(scores), LABEL)
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    back = np.empty((len(scores), k), LABEL)
    last = np.zeros(len(size), LABEL)
    v = np.zeros((len(size), k), np.float32)
    ids = np.arange(k, dtype=LABEL)
    for t in range(steps):
        a = active[t]
        if t and a < active[t - 1]:
            last[a : active[t - 1]] = v[a : active[t - 1]].argmax(axis=1)
        own = v[:a]
        if t:
            best = own.argmax(axis=1)
            top = own[np.arange(a), best][:, None] - switch
            moved = top > own
            back[base[:a] + t] = np.where(moved, best[:, None].astype(LABEL), ids)
            own = np.where(moved, top, own)
        v[:a] = own + scores[base[:a] + t]
    if steps:
        last[: active[-1]] = v[: active[-1]].argmax(axis=1)
    cur = last.copy()
    for t in range(steps - 1, -1, -1):
        a = active[t]
        out[base[:a] + t] = cur[:a]
        if t:
            cur[:a] = back[base[:a] + t, cur[:a]]
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and non-null lang of about sample documents a language whose crc32(doc_id as text) mod 4 is not 2."""
    ship(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(fold)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # a row is taken if its hash falls under its language's share; sample rows a language are expected
    part = F.lit(0.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(part)
    chosen = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            data, offs = kernel.utf8(batch.column(1))
            for lo, hi in kernel.slices(offs):
                part, cut = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, bounds = kernel.split_words(part, cut)
                if not len(starts):
                    continue
                feats, owner = grams(part, starts, ends)
                bits = scripts(part, starts, ends)
                row = np.repeat(np.arange(lo, hi), np.diff(bounds))
                for lang in set(names[lo:hi]):
                    mine = names[row] == lang
                    c, s = found.setdefault(lang, [np.zeros(1 << BITS), np.zeros(N_SCRIPTS)])
                    c += np.bincount(feats[mine[owner]], minlength=1 << BITS)
                    s += _members(bits[mine]).sum(axis=0)
        for lang, (c, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.astype("<f4").tobytes()], pa.binary()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["lang", "counts", "seen"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, s = np.zeros(1 << BITS), np.zeros(N_SCRIPTS)
        for part in parts:
            for r in part.to_pylist():
                c += np.frombuffer(r["counts"], "<f4")
                s += r["seen"]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([c.astype("<f4").tobytes()], pa.binary()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["lang", "counts", "seen"])

    schema = "lang string, counts binary, seen array<double>"
    found = chosen.select("lang", "text").mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema).collect()
    found.sort(key=lambda r: r["lang"])
    return Model([r["lang"] for r in found], [np.frombuffer(bytes(r["counts"]), "<f4") for r in found], [np.array(r["seen"]) for r in found], [counts[r["lang"]] for r in found])


def languages(docs: DataFrame, model: Model, spans: bool = False, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, ...), from the text alone; with spans also spans array<struct<lang, first, last>> by word number.

    lang_pred is the language with most bytes of lettered words under the labelling, score its share of them (ties: the
    first by name). Words in a script that no learned language has are shared out by the languages' shares of the training
    documents. und with score 0: null text, no letter (of any script), or nothing learned. Null doc_ids get held_out false; repeated
    rows are kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double" + (", spans array<struct<lang:string,first:int,last:int>>" if spans else "")
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        k = len(own.langs)
        for batch in batches:
            data, offs = kernel.utf8(batch.column(2))
            for lo, hi in kernel.slices(offs, SLICE * 8 // max(k, 8)):  # scores are words x languages
                part, cut = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, bounds = kernel.split_words(part, cut)
                pred, score, found = [UNKNOWN] * (hi - lo), np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                if k and len(starts):
                    scores, letters, known = own.word_scores(part, starts, ends)
                    label = viterbi(scores, bounds, switch)
                    row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                    votes = np.bincount(row * k + label, weights=letters * known, minlength=(hi - lo) * k).reshape(-1, k)
                    votes += np.bincount(row, weights=letters * ~known, minlength=hi - lo)[:, None] * own.prior
                    total, best = votes.sum(axis=1), votes.argmax(axis=1)
                    for i in np.flatnonzero(total):
                        pred[i], score[i] = own.langs[best[i]], min(1.0, votes[i, best[i]] / total[i])
                    if spans:
                        change = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                        for a, b in zip(change.tolist(), [*change[1:].tolist(), len(label)], strict=True):
                            i = int(row[a])
                            found[i].append({"lang": own.langs[label[a]], "first": a - int(bounds[i]), "last": b - 1 - int(bounds[i])})
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(found, kind)] if spans else []), ["doc_id", "held_out", "lang_pred", "score"] + ["spans"] * spans)

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
