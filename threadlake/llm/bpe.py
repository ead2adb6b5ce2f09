"""Byte-level BPE encoding and decoding.

Pre-tokens are shuffled by word (see blocks): each distinct pre-token of the corpus is merged once, its ids go
back to the blocks that have it, and every text is put together by position. Decoding joins ids with the
table of token bytes, whose size the vocabulary fixes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from threadlake.llm import blocks, kernel
from threadlake.session import ship

#: Blocks deal their words into so many buckets for each input partition, MIN_BUCKETS at least.
MIN_BUCKETS = 96
#: Tokens of a block that are put together at once, about.
PIECE = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair merges first, leftmost among equals.

    A heap holds the pairs, so a piece of n bytes takes n log n steps. A byte without a rank raises KeyError.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _buckets(docs: DataFrame) -> int:
    return max(MIN_BUCKETS, 2 * docs.select("doc_id").rdd.getNumPartitions())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = blocks.BLOCK_BYTES, then: Callable | None = None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """doc_id, ids array<int> for every row of docs(doc_id, text, ...): each match of pattern merged on its own.

    Null text counts as empty; empty text has no ids. Repeated rows and null doc_ids are kept. Other columns are
    ignored, whatever their names. An empty table gives an empty result. then may turn the batches into others of
    the given schema in the same worker.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(ranks)
    buckets = _buckets(docs)

    def answer(words: list[bytes]) -> list[bytes]:
        own = table.value
        return [np.array(merge(w, own), "<u4").tobytes() for w in words]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, seq, found = blocks.gathered(batches)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        values = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
        del found
        starts = np.cumsum(lengths) - lengths
        ends = np.concatenate([[0], np.cumsum(counts)])
        for lo, hi in kernel.slices(ends, PIECE):  # the block comes out a piece at a time
            part = seq[ends[lo] : ends[hi]]
            per_token = np.concatenate([[0], np.cumsum(lengths[part])])
            flat = blocks.ragged(part, values, starts, lengths) if len(part) else np.zeros(0, np.int32)
            offsets = per_token[ends[lo : hi + 1] - ends[lo]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])

    def whole(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(texts(batches)) if then else texts(batches)

    rows = blocks.answered(blocks.block_rows(docs, pattern, buckets, block_bytes), answer, buckets)
    return rows.groupBy("block").applyInArrow(kernel.lean(whole), schema)


def _pieces(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a list column, their values, and the bounds of each row among them."""
    column = pc.fill_null(column, []) if column.null_count else column
    offs = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    for lo, hi in kernel.slices(offs, limit):
        yield lo, hi, values[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


class Strings:
    """Byte strings by number, for joining many at once."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.lengths = np.fromiter(map(len, items), np.int64, len(items))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of all numbers, one after another, and the byte bounds of each row."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[numbers])])
        return blocks.ragged(numbers, self.data, self.starts, self.lengths), ends[bounds]


def _decoder(table: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Strings(table)
        for batch in batches:
            for lo, hi, values, bounds in _pieces(batch.column(1)):
                data, ends = names.join(values, bounds)
                out = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], ["doc_id", "ids", "decoded"])

    return run


def _table(ranks: dict[bytes, int]) -> list[bytes]:
    of = {i: b for b, i in ranks.items()}
    return [of[i] for i in range(len(of))]


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids, decoded binary: every id of tokens(doc_id, ids) joined with its bytes. Null ids decode to nothing; an id without bytes raises IndexError."""
    ship(tokens.sparkSession)
    table = tokens.sparkSession.sparkContext.broadcast(_table(ranks))
    return tokens.select("doc_id", "ids").mapInArrow(lambda batches: _decoder(table.value)(batches), "doc_id long, ids array<int>, decoded binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digester(table: list[bytes], keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = Strings([b" %d" % i for i in range(len(table))])
        for batch in _decoder(table)(batches):
            ids_sha = []
            for _, _, values, bounds in _pieces(batch.column(1)):
                data, ends = decimal.join(values, bounds)
                ids_sha += [hashlib.sha256(data[min(a + 1, b) : b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            out, cut = kernel.utf8(batch.column(2))
            out_sha = [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).cast(pa.int64())
            columns = [batch.column(0), n, pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)] if keep_ids else columns, names)

    return run


def encoded_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = False, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (with keep_ids also ids): encode(), decode() and digests of both, the last two in encode()'s worker."""
    ship(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(_table(ranks))
    return encode(docs, ranks, pattern, block_bytes, lambda batches: _digester(table.value, keep_ids)(batches), DIGESTS + ", ids array<int>" * keep_ids)
