"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

log P(text) sums over tokens log P(class | history) + log P(slot | class, history) + log share(token | slot). Both factors
are maximum-entropy models over the same hashed features: a bias, the previous token, the two previous tokens together, and two
skip features (second and third token back); in the second factor each is met with the class. Classes are the end
token and, for each of TOPICS word topics, HEADS classes of its SLOTS most frequent words (a slot each) and one of the
others, dealt to SLOTS slots by hash. A word's topic is that of the documents in which it mostly is; documents get topics by their
byte pairs. Inside a slot of several words the maximum-entropy solution with one indicator a token is the
relative frequency, here with one added to each count and one share for unseen tokens.

A weight of a feature is how far the counts of its hashed row raise a class over its plain share, times a scale by kind of
feature and by how often the row was seen. Counts are summed over all training documents; the scales are trained by
gradient (Newton) updates, summed over all tasks. Training documents are dealt to two halves, and each half trains the scales on
weights from the counts of the other, so that no document meets its own counts. Every update reads all of them, and updates go on until
one promises next to nothing. Sums are of whole numbers, or of figures that rounding moves in the last places only: scores do not depend
on partitions or their order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import blocks, kernel
from threadlake.session import settle, ship, stored

TOPICS, HEADS, SLOTS = 8, 2, 32
KINDS = 4
#: Rows of hashed features of each kind: a 32nd of the vocabulary, in powers of two between these (bits).
LEAST_BITS, MOST_BITS = 10, 16
#: Byte pairs are hashed to so many bins; first topics come from so many training documents, all of them then set the final ones.
BINS, FIRST_DOCS = 512, 256
#: Rows are told apart by how often they were seen: less than 4, 16, 64, ... times.
BANDS = 7
#: Added to what a row has seen and to what was to be expected.
ALPHA = 1.0
SCALE, RIDGE, MOST_SCALE = 0.3, 20.0, 1.5
#: Where updates begin: of no weight for where they end. A factor is settled by an update that promises less likelihood (natural logarithm)
#: a token than this; what is then left is of the order of its square. Updates that do not settle, which was never seen, end at ROUNDS.
START, SETTLED, ROUNDS = 0.45, 1e-5, 20
#: Tokens whose rows are gathered at once: the arrays of all workers of a machine stay in its cache.
BATCH = 1 << 13
BLOCK_BYTES = 6 << 20
MIN_BUCKETS = 96
SLICES = 64
END = np.uint64(0)
STATS = 3


def remainder(doc_id, m: int) -> int:
    """crc32 of the decimal text of doc_id, modulo m; -1 for null."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed pairs of neighbouring bytes, A-Z lowered, of each text: (texts, BINS)."""
    n = len(offsets) - 1
    if len(data) < 2:
        return np.zeros((n, BINS), np.int64)
    low = kernel.LOWER[data].astype(np.uint32)
    pair = ((low[:-1] << 8 | low[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(23)
    row = np.repeat(np.arange(n), np.diff(offsets))[:-1]
    return np.bincount(row * BINS + pair, minlength=n * BINS).reshape(n, BINS)


def centres(counts: np.ndarray) -> np.ndarray:
    """Log shares of topics from their counts of byte pairs."""
    return np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BINS))


def first_topics(sample: np.ndarray) -> np.ndarray:
    """Topics of the rows of a small sample: the furthest rows begin, then rows and centres follow each other."""
    unit = np.sqrt(sample / np.maximum(sample.sum(axis=1, keepdims=True), 1))
    near = unit @ unit[0]
    chosen = [0]
    while len(chosen) < min(TOPICS, len(sample)):
        i = int(near.argmin())
        if near[i] > 0.999:
            break
        chosen.append(i)
        near = np.maximum(near, unit @ unit[i])
    c = centres(sample[chosen])
    for _ in range(10):
        own = (sample @ c.T).argmax(axis=1)
        c = centres(np.stack([sample[own == k].sum(axis=0) for k in range(len(c)) if (own == k).any()]))
    return c


def topics(docs: DataFrame) -> np.ndarray:
    """Centres of topics of the training documents docs(doc_id, text); every one of them has its say."""

    def binned(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernel.utf8(batch.column(1))
            total: dict = {}
            for lo, hi in kernel.slices(offs):
                p = profiles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for key, counts in of(batch.column(0).slice(lo, hi - lo), p):
                    total[key] = total[key] + counts if key in total else counts
            for key, counts in total.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key), pa.int64()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["key", "bin", "n"])

    def summed(rows: DataFrame, of) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for r in rows.mapInArrow(lambda batches: binned(batches, of), "key long, bin int, n long").groupBy("key", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
            out.setdefault(r["key"], np.zeros(BINS, np.int64))[r["bin"]] = r["n"]
        return out

    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIRST_DOCS)
    first = summed(docs.join(F.broadcast(ids), "doc_id"), lambda column, p: zip(column.to_pylist(), p, strict=True))
    if not first:
        return np.zeros((1, BINS))
    c = first_topics(np.stack([first[k] for k in sorted(first)]))

    def assigned(column: pa.Array, p: np.ndarray):
        own = (p @ c.T).argmax(axis=1)
        return ((int(k), p[own == k].sum(axis=0)) for k in np.unique(own))

    found = summed(docs, assigned)
    return centres(np.stack([found[k] for k in sorted(found)]))


def _pack64(v: np.ndarray) -> bytes:
    return blocks.deflated(np.ascontiguousarray(v, "<u8").tobytes())


def _unpack64(b: bytes) -> np.ndarray:
    return np.frombuffer(blocks.inflated(b), "<u8")


def _glue(*parts: bytes) -> bytes:
    return b"".join(x for p in parts for x in (len(p).to_bytes(4, "little"), p))


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _block_rows(docs: DataFrame, buckets: int, mod: int, held: int, centre: np.ndarray) -> DataFrame:
    """Blocks as in blocks.block_rows, with 64-bit word hashes for words; counts has each word's training count in documents of each topic."""
    n_topics = len(centre)

    def emit(number: int, ids: list, counts: list, words: list, own: list) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        block = (TaskContext.get().partitionId() << 32) + number
        flat, per = np.concatenate(words), np.concatenate(counts)
        # sort once: distinct words and the index of every token
        order = np.argsort(flat)
        s = flat[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        index = np.empty(len(s), np.uint32)
        index[order] = np.cumsum(new) - 1
        distinct = s[new]
        # small indices for frequent words make a dense sequence
        rank = np.argsort(-np.bincount(index, minlength=len(distinct)), kind="stable")
        place = np.empty(len(rank), np.uint32)
        place[rank] = np.arange(len(rank), dtype=np.uint32)
        index, distinct = place[index], distinct[rank]
        train = np.repeat(np.array([0 <= remainder(i, mod) != held for i in ids], bool), per)
        topic = np.repeat(np.concatenate(own), per)
        seen = np.bincount(topic[train] * len(distinct) + index[train], minlength=n_topics * len(distinct)).reshape(n_topics, -1)
        yield blocks.record([(block, block % buckets, blocks.SEQUENCE, ids, blocks.pack(per), blocks.pack(index))])
        home = (distinct % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            w = order[cuts[b] : cuts[b + 1]]
            if len(w):
                rows.append((block, b, blocks.WORDS, [], _glue(blocks.pack(w), blocks.pack(seen[:, w].ravel())), _pack64(distinct[w])))
        if rows:
            yield blocks.record(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, counts, words, own = 0, 0, [], [], [], []
        for batch in batches:
            data, offs = kernel.utf8(batch.column(1))
            all_ids = batch.column(0).to_pylist()
            for lo, hi in kernel.slices(offs):
                part, cut = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, bounds = kernel.split_words(part, cut)
                h = np.maximum(kernel.word_hashes(part, starts, ends), np.uint64(1))
                n = np.diff(bounds) + 1
                flat = np.zeros(int(n.sum()), np.uint64)
                flat[np.arange(len(h)) + np.repeat(np.arange(hi - lo), n - 1)] = h
                ids += all_ids[lo:hi]
                counts.append(n)
                words.append(flat)
                own.append((profiles(part, cut) @ centre.T).argmax(axis=1))
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield from emit(number, ids, counts, words, own)
                    number, size, ids, counts, words, own = number + 1, 0, [], [], [], []
        yield from emit(number, ids, counts, words, own)

    return docs.mapInArrow(kernel.lean(run), blocks.SCHEMA)


def slot(words: np.ndarray) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)


def _counter(n_topics: int):
    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one bucket: every word's training count and topic over all blocks, sent to each block, and the bucket's totals. Sequences pass."""
        asked, out = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                if one.column(2)[0].as_py() == blocks.WORDS:
                    asked += one.to_pylist()
                else:
                    yield one
        if not asked:
            return
        parts, words = [_parts(r["counts"]) for r in asked], [_unpack64(r["payload"]) for r in asked]
        distinct, inverse = np.unique(np.concatenate(words), return_inverse=True)
        by = np.zeros((n_topics, len(distinct)), np.int64)
        at = 0
        for p, w in zip(parts, words, strict=True):
            by[:, inverse[at : at + len(w)]] += blocks.unpack(p[1]).reshape(n_topics, -1)
            at += len(w)
        total = by.sum(axis=0)
        # a word without training count has no topic of its own: its hash deals it out
        topic = np.where(total > 0, by.argmax(axis=0), ((distinct >> np.uint64(20)) % np.uint64(n_topics)).astype(np.int64))
        at = 0
        for r, p, w in zip(asked, parts, words, strict=True):
            own = inverse[at : at + len(w)]
            at += len(w)
            out.append((r["block"], r["bucket"], blocks.ANSWERS, [], _glue(p[0], blocks.pack(total[own]), blocks.pack(topic[own])), r["payload"]))
        live = (total > 0) & (distinct != END)
        w, c, t = distinct[live], total[live], topic[live]
        cell = t * SLOTS + slot(w)
        sums = [np.bincount(cell, weights=c, minlength=n_topics * SLOTS), np.bincount(cell, minlength=n_topics * SLOTS)]
        top = np.concatenate([own[np.lexsort((w[own], -c[own]))[: HEADS * SLOTS]] for own in (np.flatnonzero(t == k) for k in range(n_topics))])
        stats = np.concatenate([[total[distinct == END].sum()], *sums]).astype("<i8")
        out.append((-1, asked[0]["bucket"], STATS, c[top].tolist(), _glue(stats.tobytes(), t[top].astype("<i8").tobytes()), w[top].astype("<u8").tobytes()))
        yield blocks.record(out)

    return count


def _block(table: pa.Table) -> pa.Table:
    """Bring one block's rows together: one row with its documents, sequence, words, their counts and topics."""
    ids, per, seq, places, words, counts, own = [], b"", b"", [], [], [], []
    for r in table.to_pylist():
        if r["kind"] == blocks.SEQUENCE:
            ids, per, seq = r["doc_id"], r["counts"], r["payload"]
        else:
            p = _parts(r["counts"])
            for x, y in zip((places, counts, own), p, strict=True):
                x.append(blocks.unpack(y))
            words.append(_unpack64(r["payload"]))
    order = np.argsort(np.concatenate(places), kind="stable")
    columns = {"words": _pack64(np.concatenate(words)[order]), "counts": blocks.pack(np.concatenate(counts)[order]), "topics": blocks.pack(np.concatenate(own)[order])}
    return pa.table({"ids": pa.array([ids], pa.list_(pa.int64())), "per": pa.array([per], pa.binary()), "seq": pa.array([seq], pa.binary()), **{k: pa.array([v], pa.binary()) for k, v in columns.items()}})


class Tables:
    """Weights of both factors: sent in 16 bits, held by tasks in 32, whose rows are gathered much faster."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.one, self.two = one, two

    def __setstate__(self, state: dict) -> None:
        self.one, self.two = state["one"].astype(np.float32), state["two"].astype(np.float32)


class Model:
    """Counts, classes and weights. Class 0 is the end token; each topic has HEADS + 1 classes."""

    def __init__(self, n_topics: int, ends: int, head: list[list[tuple[int, int]]], tail_n: np.ndarray, tail_v: np.ndarray):
        """head: (count, word) of the most frequent words of each topic, most frequent first; tail_n, tail_v: counts and numbers of all words by topic and slot."""
        self.classes = 1 + n_topics * (HEADS + 1)
        self.v = int(tail_v.sum()) + (ends > 0)
        self.n = int(tail_n.sum()) + ends
        self.tail_n, self.tail_v = tail_n.copy(), tail_v.copy()
        self.slot_n = np.zeros((self.classes, SLOTS))
        words, cells = [], []
        for k, own in enumerate(head):
            for i, (c, w) in enumerate(own):
                cls, at = 1 + k * (HEADS + 1) + i // SLOTS, i % SLOTS
                self.slot_n[cls, at] = c
                home = int(slot(np.array([w], np.uint64))[0])
                self.tail_n[k, home] -= c
                self.tail_v[k, home] -= 1
                words.append(w)
                cells.append(cls * SLOTS + at)
        for k in range(n_topics):
            self.slot_n[1 + k * (HEADS + 1) + HEADS] = self.tail_n[k] + 1  # one for unseen words
        order = np.argsort(np.array(words, np.uint64))
        self.head, self.cells = np.array(words, np.uint64)[order], np.array(cells, np.int64)[order]
        class_n = self.slot_n.sum(axis=1)
        class_n[0] = ends + 1
        self.slot_n[0, 0] = 1
        self.plain = np.log(np.maximum(class_n, 0.5) / np.maximum(class_n, 0.5).sum())
        # slots that no word has get nothing
        with np.errstate(divide="ignore"):
            self.plain_slots = np.maximum(np.log(self.slot_n / np.maximum(self.slot_n.sum(axis=1, keepdims=True), 1)), -1e4)
        self.bits = min(max(int(max(self.v, 1)).bit_length() - 5, LEAST_BITS), MOST_BITS)
        self.weights: Tables | None = None

    def places(self, words: np.ndarray, topic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word of a block: class * SLOTS + slot, and whether it has its slot alone."""
        cell = (1 + topic.astype(np.int64) * (HEADS + 1) + HEADS) * SLOTS + slot(words)
        alone = words == END
        cell[alone] = 0
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
            hit = self.head[at] == words
            cell[hit] = self.cells[at[hit]]
            alone |= hit
        return cell, alone

    def word_tables(self, words: np.ndarray, counts: np.ndarray, topic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word of a block: class * SLOTS + slot, log10 share within the slot, log10 base probability."""
        cell, alone = self.places(words, topic)
        topic, home = topic.astype(np.int64), slot(words)
        share = np.log10((counts + 1.0) / (self.tail_n[topic, home] + self.tail_v[topic, home] + 1.0))
        share[alone] = 0.0
        return cell, share, np.log10((counts + 1.0) / (self.n + self.v + 1.0))


def histories(words: np.ndarray, seq: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Hashed features of each token's history: (KINDS, tokens). Histories start at the document's begin."""
    own = words[seq]
    at = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    back = []
    for j in (1, 2, 3):
        x = np.zeros(len(seq), np.uint64)
        x[j:] = own[:-j] if len(seq) > j else own[:0]
        x[at < j] = np.uint64(j)
        back.append(x)
    one, two, three = back
    return np.stack([one * np.uint64(0x9E3779B97F4A7C15), kernel.step(kernel.step(one, one, kernel.SECOND), two, kernel.FIRST), two * np.uint64(0xD6E8FEB86659FD93), three * np.uint64(0xA0761D6478BD642F)])


def rows_of(history: np.ndarray, bits: int, cls: np.ndarray | None = None, classes: int = 0) -> np.ndarray:
    """Rows of hashed features: of the first factor, or of the second, where each class has its own share of the rows."""
    if cls is None:
        return (history >> np.uint64(64 - bits)).astype(np.int64)
    own = np.uint64((1 << bits) // classes)
    return cls * int(own) + ((history >> np.uint64(32)) * own >> np.uint64(32)).astype(np.int64)


def weights_of(counts: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """How far each row's counts raise its columns over their plain shares, as logarithms, with ALPHA added to what is seen and to what was to be expected."""
    return np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) * np.exp(plain) + ALPHA))


def _weights(counts: np.ndarray, plain: np.ndarray, scales: np.ndarray | None = None) -> np.ndarray:
    """weights_of of each kind in 16 bits, times the scales (KINDS, BANDS) if given."""
    out = np.empty(counts.shape, np.float16)
    for i, c in enumerate(counts):
        out[i] = weights_of(c, plain) if scales is None else weights_of(c, plain) * scales[i][bands(c)][:, None]
    return out


def bands(counts: np.ndarray) -> np.ndarray:
    """By how often a row was seen."""
    total = counts.sum(axis=1)
    return np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64) // 2 + (total > 0), BANDS - 1).astype(np.uint8)


def softmax(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the place of z the probabilities of each row times a factor; the factor; and the log probability of the row's target."""
    z -= z[np.arange(len(z)), target][:, None]
    top = np.zeros(len(z), z.dtype)
    if z.size and z.max() > 60:
        top = z.max(axis=1)
        z -= top[:, None]
    total = np.einsum("nc->n", np.exp(z, out=z))
    return z, total, -(np.log(total) + top)


def _gathered(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sum of the rows of all kinds."""
    z = np.take(table[0], rows[0], axis=0)
    for i in range(1, KINDS):
        z += np.take(table[i], rows[i], axis=0)
    return z


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row | {"per": blocks.unpack(row["per"]).astype(np.int64), "seq": blocks.unpack(row["seq"]), "words": _unpack64(row["words"]), "topics": blocks.unpack(row["topics"])}


def _chosen(batches: Iterator[pa.RecordBatch], model: Model, part) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block's documents of either half (part gives a document's half, or -1) the half, the tokens' words, their cells, and the tokens of each document."""
    for row in _rows(batches):
        halves = np.array([part(i) for i in row["ids"]], np.int64)
        cell = model.places(row["words"], row["topics"])[0] if (halves >= 0).any() else None
        for half in (0, 1):
            chosen = halves == half
            if chosen.any():
                s = row["seq"][np.repeat(chosen, row["per"])]
                yield half, row["words"][s], cell[s], row["per"][chosen]


def _tokens(rows: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Half, histories and cells of the tokens, in batches."""
    for half, words, cells, per in rows:
        ends = np.concatenate([[0], np.cumsum(per)])
        for lo, hi in kernel.slices(ends, 1 << 18):
            yield half, histories(words, np.arange(ends[lo], ends[hi]), per[lo:hi]), cells[ends[lo] : ends[hi]]


def counted(table: DataFrame, model: Model, part) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each half of the documents how often each row of features met each class (KINDS, rows, classes), and each slot (KINDS, rows, SLOTS)."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(model)
    size, classes = 1 << model.bits, model.classes
    cells = KINDS * size * (classes + SLOTS)
    step, cut = -(-cells // SLICES), KINDS * size * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total = np.zeros(2 * cells, np.uint32)
        for half, h, cell in _tokens(_chosen(batches, own, part)):
            one, two = np.split(total[half * cells : (half + 1) * cells], [cut])
            cls = cell // SLOTS
            inside = cls > 0
            for i in range(KINDS):
                np.add.at(one, (i * size + rows_of(h[i], own.bits)) * classes + cls, np.uint32(1))
                np.add.at(two, (i * size + rows_of(h[i][inside], own.bits, cls[inside], own.classes)) * SLOTS + cell[inside] % SLOTS, np.uint32(1))
        task = TaskContext.get().partitionId()
        for k in range(2 * SLICES):
            own_slice = total[k * step : (k + 1) * step]
            if own_slice.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([blocks.pack(own_slice)], pa.binary())], ["slice", "part", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in parts:
            for r in part.to_pylist():
                c = blocks.unpack(r["counts"])
                total = total + c if len(total) else c.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([blocks.pack(total)], pa.binary())], ["slice", "part", "counts"])

    schema = "slice int, part int, counts binary"
    # a slice's tables of all tasks are added up in two steps, so that no task has them all
    few = max(1, math.isqrt(table.rdd.getNumPartitions()))
    rows = table.mapInArrow(run, schema).withColumn("part", F.col("part") % few).groupBy("slice", "part").applyInArrow(add, schema)
    rows = rows.groupBy("slice").applyInArrow(add, schema)
    total = np.zeros(2 * cells, np.uint32)
    for r in rows.toLocalIterator():
        c = blocks.unpack(bytes(r["counts"]))
        total = total.astype(np.promote_types(total.dtype, c.dtype), copy=False)
        total[r["slice"] * step : r["slice"] * step + len(c)] = c
    return [(x[:cut].reshape(KINDS, size, classes), x[cut:].reshape(KINDS, size, SLOTS)) for x in np.split(total, 2)]


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, in the place of a where its 32 bits hold the sums."""
    if a.dtype == b.dtype == np.uint32 and int(a.max(initial=0)) + int(b.max(initial=0)) < 1 << 32:
        return np.add(a, b, out=a)
    return a.astype(np.int64) + b.astype(np.int64)


def _plain_of_rows(model: Model) -> np.ndarray:
    """Plain shares of slots for each row of the second factor."""
    size = 1 << model.bits
    return model.plain_slots[np.minimum(np.arange(size) // (size // model.classes), model.classes - 1)]


def _moments(weights: list[np.ndarray], band: list[np.ndarray], plain: np.ndarray, scales: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient and curvature of the log likelihood by the scales (KINDS * BANDS), and the likelihood."""
    n, c = weights[0].shape
    z = scales[0][band[0]][:, None] * weights[0]
    z += plain
    x = np.empty_like(z)
    for i in range(1, KINDS):
        z += np.multiply(scales[i][band[i]][:, None], weights[i], out=x)
    p, total, logs = softmax(z, target)
    p /= total[:, None]
    at, hit, ones = [b.astype(np.int64) for b in band], np.arange(n) * c + target, np.ones(c, z.dtype)
    grad, curve, mean = np.empty((KINDS, BANDS)), np.empty((KINDS, BANDS, KINDS, BANDS)), []
    for i in range(KINDS):
        np.multiply(p, weights[i], out=x)
        mean.append(x @ ones)
        grad[i] = np.bincount(at[i], weights=np.take(weights[i], hit) - mean[i], minlength=BANDS)
        for j in range(i + 1):
            both = np.einsum("nc,nc->n", x, weights[j])
            both -= mean[i] * mean[j]
            own = np.bincount(at[i] * BANDS + at[j], weights=both, minlength=BANDS * BANDS).reshape(BANDS, BANDS)
            curve[i, :, j], curve[j, :, i] = own, own.T
    return grad.ravel(), curve.ravel(), float(logs.sum(dtype=float))


def trained(table: DataFrame, model: Model, counts: list[tuple[np.ndarray, np.ndarray]], part) -> np.ndarray:
    """Scales (2, KINDS, BANDS) of both factors: Newton updates, whose sums come from all tasks. Each half of the documents meets weights from the counts of the other.

    Every update of a factor reads all of table, until the factor is settled.
    """
    spark = table.sparkSession
    over = _plain_of_rows(model)
    others = counts[::-1]
    weights = [Tables(*(_weights(c, plain) for c, plain in zip(own, (model.plain[None, :], over), strict=True))) for own in others]
    fixed = spark.sparkContext.broadcast((model, weights, [[np.stack([bands(c) for c in own]) for own in pair] for pair in others]))
    del weights
    scales = np.full((2, KINDS, BANDS), START)
    size = KINDS * BANDS
    width = size + size * size + 1
    going = [0, 1]
    for _ in range(ROUNDS):
        now, asked = scales.astype(np.float32), tuple(going)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, both, seen = fixed.value
            plain, slots = own.plain.astype(np.float32), own.plain_slots.astype(np.float32)
            total = np.zeros((2, width))
            for half, h, cell in _tokens(_chosen(batches, own, part)):
                one, two, (band1, band2) = both[half].one, both[half].two, seen[half]
                for x in range(0, len(cell), BATCH):
                    hb, cls = h[:, x : x + BATCH], cell[x : x + BATCH] // SLOTS
                    if 0 in asked:
                        r = [rows_of(hb[i], own.bits) for i in range(KINDS)]
                        g, c, ll = _moments([np.take(one[i], r[i], axis=0) for i in range(KINDS)], [band1[i][r[i]] for i in range(KINDS)], plain, now[0], cls)
                        total[0] += np.concatenate([g, c, [ll]])
                    inside = np.flatnonzero(cls)
                    if 1 in asked and len(inside):
                        own_cls = cls[inside]
                        r = [rows_of(hb[i][inside], own.bits, own_cls, own.classes) for i in range(KINDS)]
                        g, c, ll = _moments([np.take(two[i], r[i], axis=0) for i in range(KINDS)], [band2[i][r[i]] for i in range(KINDS)], np.take(slots, own_cls, axis=0), now[1], cell[x : x + BATCH][inside] % SLOTS)
                        total[1] += np.concatenate([g, c, [ll]])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["key", "sums"])

        sums = np.zeros(2 * width)
        for r in table.mapInArrow(kernel.lean(run), "key int, sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
            sums[r["at"]] = r["x"]
        for f in asked:
            own = sums[f * width : (f + 1) * width]
            grad, curve = own[:size] - RIDGE * (scales[f].ravel() - SCALE), own[size:-1].reshape(size, size) + RIDGE * np.eye(size)
            s = scales[f].ravel()
            free = np.flatnonzero(~((s <= 0) & (grad < 0) | (s >= MOST_SCALE) & (grad > 0)))  # the others stay at their bounds
            step = np.linalg.solve(curve[np.ix_(free, free)], grad[free])
            s[free] = np.clip(s[free] + step.clip(-0.5, 0.5), 0, MOST_SCALE)
            if grad[free] @ step / 2 <= SETTLED * max(model.n, 1):
                going.remove(f)
        if not going:
            break
    fixed.unpersist()
    return scales


def lm_scores(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text, ...).

    Words are runs of other than ASCII white space, A-Z lowered, then one end token; a null or empty text has the end
    token only. Training rows are those with a doc_id whose crc32 modulo mod is not held; a null doc_id is scored
    and never trained on (held_out false). base_score is the add-one unigram log10 probability, score the model's.
    Words are told apart by 64-bit hashes. Repeated rows count each time. Other columns are ignored. An empty table gives
    an empty result; with no training rows every token is unknown and both scores rest on the added ones. Scores do not depend
    on how the table is partitioned.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = max(MIN_BUCKETS, 2 * docs.select("doc_id").rdd.getNumPartitions())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    centre = topics(docs.where("doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) != held))
    k = len(centre)
    table = stored(_block_rows(docs, buckets, mod, held, centre).groupBy("bucket").applyInArrow(kernel.lean(_counter(k)), blocks.SCHEMA), "counted")
    settle(spark)
    head: list[list[tuple[int, int]]] = [[] for _ in range(k)]
    ends, tail_n, tail_v = 0, np.zeros(k * SLOTS), np.zeros(k * SLOTS)
    for r in table.where(F.col("kind") == STATS).select("doc_id", "counts", "payload").toLocalIterator():
        sums, own = _parts(bytes(r["counts"]))
        s = np.frombuffer(sums, "<i8")
        ends, tail_n, tail_v = ends + int(s[0]), tail_n + s[1 : 1 + k * SLOTS], tail_v + s[1 + k * SLOTS :]
        for c, t, w in zip(r["doc_id"], np.frombuffer(own, "<i8").tolist(), np.frombuffer(bytes(r["payload"]), "<u8").tolist(), strict=True):
            head[t].append((-c, w))
        head = [sorted(x)[: HEADS * SLOTS] for x in head]
    model = Model(k, ends, [[(-c, w) for c, w in x] for x in head], tail_n.reshape(k, SLOTS), tail_v.reshape(k, SLOTS))
    table = stored(table.where(F.col("kind") != STATS).groupBy("block").applyInArrow(_block, "ids array<bigint>, per binary, seq binary, words binary, counts binary, topics binary"), "blocks")
    settle(spark)

    def half(i) -> int:
        return -1 if remainder(i, mod) in (-1, held) else zlib.crc32(str(i).encode()) // mod % 2

    sequences = table.drop("counts")
    counts = counted(sequences, model, half)
    scales = trained(sequences, model, counts, half)
    settle(spark)
    both = [added(a, b) for a, b in zip(*counts, strict=True)]
    del counts
    model.weights = Tables(*(_weights(c, plain, own) for c, plain, own in zip(both, (model.plain[None, :], _plain_of_rows(model)), scales, strict=True)))
    del both
    settle(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        one, two = own.weights.one, own.weights.two
        plain, slots = own.plain.astype(np.float32), own.plain_slots.astype(np.float32)
        for row in _rows(batches):
            ids, per, seq, count = row["ids"], row["per"], row["seq"], blocks.unpack(row["counts"]).astype(np.int64)
            cell, share, base = own.word_tables(row["words"], count, row["topics"])
            ends = np.concatenate([[0], np.cumsum(per)])
            first = ends[:-1]
            known = np.add.reduceat((count > 0)[seq], first, dtype=np.int64)
            base_score = np.add.reduceat(base[seq], first)
            score = np.add.reduceat(share[seq], first)
            for lo, hi in kernel.slices(ends, 1 << 18):
                a, b = int(ends[lo]), int(ends[hi])
                h, target = histories(row["words"], seq[a:b], per[lo:hi]), cell[seq[a:b]]
                got = np.empty(b - a)
                for x in range(0, b - a, BATCH):
                    t, hb = target[x : x + BATCH], h[:, x : x + BATCH]
                    cls = t // SLOTS
                    z = _gathered(one, [rows_of(hb[i], own.bits) for i in range(KINDS)])
                    z += plain
                    logs = softmax(z, cls)[2].astype(float)
                    inside = np.flatnonzero(cls)
                    c = cls[inside]
                    z = _gathered(two, [rows_of(hb[i][inside], own.bits, c, own.classes) for i in range(KINDS)])
                    z += np.take(slots, c, axis=0)
                    logs[inside] += softmax(z, t[inside] % SLOTS)[2]
                    got[x : x + BATCH] = logs
                score[lo:hi] += np.add.reduceat(got, first[lo:hi] - a) / np.log(10)
            held_out = [remainder(i, mod) == held for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held_out), pa.array(per), pa.array(known), pa.array(np.full(len(ids), own.n)), pa.array(base_score), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.mapInArrow(kernel.lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
