"""Block dictionaries: how per-word work over a whole corpus is shuffled compactly.

A task cuts its rows into blocks of bounded text. A block's tokens become indices into the block's own list of
distinct words; the index sequence stays one compressed blob, the distinct words are dealt out by hash into
buckets. A bucket meets each word of the corpus in one place, answers for it once, and sends one blob of answers
a block back. A block then has its sequences and the answers of all buckets together. Rows that are shuffled
are few and dense, and no group is larger than one block or one bucket's share of the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import kernel
from threadlake.llm.pretokens import Vocabulary, token_bounds

BLOCK_BYTES = 32 << 20
SCHEMA = "block long, bucket int, kind int, doc_id array<bigint>, counts binary, payload binary"
NAMES = ["block", "bucket", "kind", "doc_id", "counts", "payload"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
WORDS, SEQUENCE, ANSWERS = 0, 1, 2


def deflated(data: bytes) -> bytes:
    global _compressor
    if _compressor is None:
        _compressor = zstandard.ZstdCompressor(level=1)
    return _compressor.compress(data)


def inflated(data: bytes) -> bytes:
    global _decompressor
    if _decompressor is None:
        _decompressor = zstandard.ZstdDecompressor()
    return _decompressor.decompress(data)


_compressor: zstandard.ZstdCompressor | None = None
_decompressor: zstandard.ZstdDecompressor | None = None


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes, as many as the largest needs; their number comes first."""
    wide = 4 if not len(values) or int(np.max(values)) < 1 << 32 else 8
    v = np.ascontiguousarray(values, f"<u{wide}")
    planes = max(1, -(-int(v.max()).bit_length() // 8)) if len(v) else 1
    return bytes((planes,)) + deflated(np.ascontiguousarray(v.view(np.uint8).reshape(-1, wide)[:, :planes].T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    """The numbers, in 32 bits each if these hold all, else in 64."""
    raw = np.frombuffer(inflated(data[1:]), np.uint8).reshape(data[0], -1)
    wide = 4 if data[0] <= 4 else 8
    out = np.zeros((raw.shape[1], wide), np.uint8)
    out[:, : data[0]] = raw.T
    return out.view(f"<u{wide}").ravel()


def pack_strings(items: list[bytes]) -> bytes:
    lengths = pack(np.fromiter(map(len, items), np.uint32, len(items)))
    return len(lengths).to_bytes(4, "little") + lengths + deflated(b"".join(items))


def unpack_strings(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4 : 4 + n]), dtype=np.int64).tolist()
    text = inflated(data[4 + n :])
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


def block_rows(docs: DataFrame, pattern: str, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Sequence rows and word rows of every block of docs(doc_id, text); words are the matches of pattern."""

    def emit(number: int, words: list[bytes], ids: list, counts: list[np.ndarray], seqs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        block = (TaskContext.get().partitionId() << 32) + number
        seq = np.concatenate(seqs) if seqs else np.zeros(0, np.uint32)
        # small indices for frequent words make a dense sequence
        order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        yield record([(block, block % buckets, SEQUENCE, ids, pack(np.concatenate(counts)), pack(place[seq]))])
        home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        dealt = order[np.argsort(home[order], kind="stable")]
        cuts = np.searchsorted(home[dealt], np.arange(buckets + 1))
        for b in range(buckets):
            own = dealt[cuts[b] : cuts[b + 1]]
            if len(own):
                yield record([(block, b, WORDS, [], pack(np.diff(place[own].astype(np.int64), prepend=0)), pack_strings([words[i] for i in own.tolist()]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        known, words = Vocabulary(), []
        ids: list = []
        counts: list[np.ndarray] = []
        seqs: list[np.ndarray] = []
        for batch in batches:
            data, offs = kernel.utf8(batch.column(1))
            for lo, hi in kernel.slices(offs):
                part, cut = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, bounds = token_bounds(part, cut, pattern)
                numbers, new = known.numbers(part, starts, ends)
                words += new
                seqs.append(numbers.astype(np.uint32))
                counts.append(np.diff(bounds).astype(np.uint32))
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                size += len(part) + 8 * (hi - lo)
                if size >= block_bytes:
                    yield from emit(number, words, ids, counts, seqs)
                    number, size, known, words, ids, counts, seqs = number + 1, 0, Vocabulary(), [], [], [], []
        yield from emit(number, words, ids, counts, seqs)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel.lean(run), SCHEMA)


def answered(rows: DataFrame, answer: Callable[[list[bytes]], list[bytes]], buckets: int) -> DataFrame:
    """Replace each block's word rows by answer rows; a bucket's words meet in one task, and each is asked there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == WORDS:
                    words = unpack_strings(row["payload"])
                    new = [w for w in words if w not in known]
                    known.update(zip(new, answer(new), strict=True))
                    row |= {"kind": ANSWERS, "payload": pack_strings([known[w] for w in words])}
                yield record([tuple(row[n] for n in NAMES)])

    return rows.repartition(buckets, "bucket").mapInArrow(kernel.lean(run), SCHEMA)


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list, np.ndarray, np.ndarray, list[bytes]]:
    """Of one block: doc_ids, tokens of each, the sequence of word indices, and every word's answer."""
    ids, counts, seq, places, answers = [], np.zeros(0, np.uint32), np.zeros(0, np.uint32), [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == SEQUENCE:
                ids, counts, seq = row["doc_id"], unpack(row["counts"]), unpack(row["payload"])
            else:
                places.append(np.cumsum(unpack(row["counts"]), dtype=np.int64))
                answers += unpack_strings(row["payload"])
    out: list[bytes] = [b""] * len(answers)
    for p, a in zip(np.concatenate(places).tolist() if places else [], answers, strict=True):
        out[p] = a
    return ids, counts.astype(np.int64), seq, out


def ragged(seq: np.ndarray, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for every i of seq, one after another."""
    n = lengths[seq]
    total = int(n.sum())
    begin = np.cumsum(n) - n
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts[seq] - begin, n)]
