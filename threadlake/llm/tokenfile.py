"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank of corpus frequency, so common ids take one byte. Of each chunk, the lengths (two
bits an id, four ids a control byte) and the data bytes (one to four an id, little-endian) are stored apart; a
reader looks control bytes up in a table of lengths and gathers the data with array operations. A file
is a Parquet folder of chunks: part, chunk, ids before the chunk in its part, document ids and counts,
control and data bytes, beside the table of ranks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.llm import blocks, kernel
from threadlake.llm.pretokens import Vocabulary, token_bounds
from threadlake.session import shared_dir, ship, stored

CHUNK_IDS = 1 << 19
#: A worker keeps ids of this many distinct pre-tokens, then starts anew: memory, not results, depends on it.
KNOWN = 600_000
LENGTHS = np.stack([(np.arange(256) >> s) & 3 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8) + 1
FILE = "part int, chunk int, before long, n_ids long, doc_ids binary, has_id binary, counts binary, control binary, data binary"
_worker: dict = {}


def write_codes(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    two = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    two[: len(v)] = extra
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes()


def read_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of write_codes."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(length, dtype=np.int64) - length
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = d[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= d[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenizer(path: str) -> dict:
    """This worker's tokenizer, and the ids of the pre-tokens that it has met."""
    if _worker.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        added = [t.content for t in own.get_added_tokens_decoder().values()]
        _worker.update(path=path, tokenizer=own, special=re.compile(b"|".join(re.escape(x.encode()) for x in added)) if added else None, known=None)
    if _worker["known"] is None or _worker["n"] > KNOWN:
        _worker.update(known=Vocabulary(), n=0, used=0, values=np.zeros(1 << 20, np.uint32), lengths=np.zeros(1 << 18, np.int64), starts=np.zeros(1 << 18, np.int64))
    return _worker


def _with_special(w: dict, data: np.ndarray, bounds: np.ndarray) -> set[int]:
    """The texts in which an added token of the tokenizer occurs."""
    if w["special"] is None:
        return set()
    # a match that runs over the end of a text may hide one in the next, which is then taken along
    found = np.array([x for m in w["special"].finditer(data.tobytes()) for x in (m.start(), m.end() - 1)], np.int64)
    return set((np.searchsorted(bounds, found, side="right") - 1).tolist())


def _learn(w: dict, new: list[str]) -> None:
    """Encode words and keep their ids under the next numbers."""
    for e in range(0, len(new), 8192):
        got = [x.ids for x in w["tokenizer"].encode_batch_fast(new[e : e + 8192], add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))
        n = w["n"]
        while w["used"] + len(flat) > len(w["values"]):
            w["values"] = np.concatenate([w["values"], np.zeros_like(w["values"])])
        while n + len(got) > len(w["lengths"]):
            for k in ("lengths", "starts"):
                w[k] = np.concatenate([w[k], np.zeros_like(w[k])])
        w["values"][w["used"] : w["used"] + len(flat)] = flat
        w["lengths"][n : n + len(got)] = lengths
        w["starts"][n : n + len(got)] = w["used"] + np.cumsum(lengths) - lengths
        w["used"] += len(flat)
        w["n"] += len(got)


def tokenise(docs: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """doc_id, n (ids with the end id), packed ids. pattern is the tokenizer's own pre-tokenisation; a text with one of its added tokens goes to it whole.

    A worker asks the tokenizer once for each pre-token that it meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernel.utf8(batch.column(1))
            for lo, hi in kernel.slices(offs):
                w = _tokenizer(path)
                part, cut = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                whole = _with_special(w, part, cut)
                starts, ends, bounds = token_bounds(part, cut, pattern)
                seq, new = w["known"].numbers(part, starts, ends)
                if new:
                    _learn(w, [x.decode() for x in new])
                flat = blocks.ragged(seq, w["values"], w["starts"], w["lengths"]) if len(seq) else np.zeros(0, np.uint32)
                cuts = np.concatenate([[0], np.cumsum(w["lengths"][seq])])[bounds].tolist()
                out, n = [], []
                for i in range(hi - lo):
                    ids = np.array(w["tokenizer"].encode(part[cut[i] : cut[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) if i in whole else flat[cuts[i] : cuts[i + 1]]
                    n.append(len(ids) + 1)
                    out.append(blocks.pack(np.append(ids, np.uint32(end_id))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, packed binary")


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first (ties by id); its length is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                c = np.bincount(blocks.unpack(x))
                if len(c) > len(total):
                    total, c = c, total
                total[: len(c)] += c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "c"])

    rows = tokens.select("packed").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["c"], r["id"]))], np.uint32)


def write(tokens: DataFrame, path: str, parts: int) -> None:
    """Write tokens(doc_id, n, packed) in ascending doc_id order (null first, ties by length, then ids)."""
    spark = tokens.sparkSession
    order = frequency_ranks(tokens)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        chunk = before = size = 0
        ids, counts, held = [], [], []

        def out() -> pa.RecordBatch:
            v = sent.value[np.concatenate(held)]
            control, data = write_codes(v)
            row = [part, chunk, before, len(v), blocks.pack(np.array([i or 0 for i in ids], np.int64).view(np.uint32)), bytes(i is not None for i in ids), blocks.pack(np.array(counts, np.uint32)), control, data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["part", "chunk", "before", "n_ids", "doc_ids", "has_id", "counts", "control", "data"])

        for batch in batches:
            for i, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                counts.append(n)
                held.append(blocks.unpack(packed))
                size += n
                if size >= CHUNK_IDS:
                    yield out()
                    chunk, before, size, ids, counts, held = chunk + 1, before + size, 0, [], [], []
        if ids:
            yield out()

    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n", "packed")
    ordered.mapInArrow(run, FILE).write.parquet(f"{path}/chunks")
    spark.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary").write.parquet(f"{path}/ranks")


def read(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids binary (little-endian unsigned 32-bit) of every stored document; with digests n_tokens and ids_crc32 for ids."""
    ranks = spark.read.schema("ids binary").parquet(f"{path}/ranks").first()["ids"]
    sent = spark.sparkContext.broadcast(bytes(ranks))
    chunks = spark.read.schema(FILE).parquet(f"{path}/chunks")
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # one row a part: the window sees as many rows as the file has parts
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(sent.value, "<u4")
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                values = ids[read_codes(r["control"], r["data"], r["n_ids"])].astype("<u4")
                counts = blocks.unpack(r["counts"]).astype(np.int64)
                ends = np.cumsum(counts)
                docs = [x if h else None for x, h in zip(blocks.unpack(r["doc_ids"]).view(np.int64).tolist(), r["has_id"], strict=True)]
                start = r["offset"] + r["before"] + ends - counts
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), raw], ["doc_id", "start", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            raw = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = chunks.join(offsets, "part")
    if digests:
        return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2) -> DataFrame:
    """Encode docs(doc_id, text, ...), write the id files to the shared folder, and read them back: doc_id, start, n_tokens, ids_crc32.

    Null text counts as empty (the end id alone). Null doc_ids sort first; repeated doc_ids sort by length, then ids.
    Other columns are ignored. An empty table gives an empty file and result.
    """
    import uuid

    spark = docs.sparkSession
    ship(spark)
    tokens = stored(tokenise(docs, tokenizer, pattern, end_id), "tokens")
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(tokens, path, max(8, docs.select("doc_id").rdd.getNumPartitions()))
    return read(spark, path, digests=True)
