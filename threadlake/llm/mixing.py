"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws.

The words of each source lie on a tape, documents in the order of a hash, cut into blocks of equal length. A target is a number of
words; the mix takes whole passes over the tape's blocks and of one more pass the first blocks in the order of a keyed permutation, the
last of them cut so that the words come out exactly. So each source has an exact quota of blocks and
no block is taken more often than passes allow. A tree deals the quotas to output shards: each node draws, without replacement,
how many blocks of each source its left half gets; its leaves are ranges of permuted positions of each source,
disjoint and without gaps. Each node's draw depends only on the seed and on its shards, so any task can make it, and reruns agree.

No table of blocks is made: a document knows its place on the tape and from it its blocks, the permutation their positions, and a
join of (source, cell of positions) with the leaves the shard. Tapes are added up by cells of the hash, then inside cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.llm import kernel
from threadlake.session import ship, small, stored

#: Words of a block, and blocks of a shard. Blocks grow with the corpus: numpy draws from fewer than 10^9.
BLOCK_WORDS, SHARD_BLOCKS, MOST_BLOCKS = 512, 512, 500_000_000
#: Documents that one cell of a tape's hash holds, more or less, and shards that a task of the tree deals to.
CELL_DOCS, SUBTREE = 20_000, 1024
#: Passes over a source at most.
PASSES = 3
SPACES = r"\x20\x09-\x0D"


@dataclass
class Source:
    """words in all; weight; target words (exact); blocks; quota of blocks taken; words of the last one taken."""

    name: str | None
    words: int
    weight: int
    target: Fraction = Fraction(0)
    blocks: int = 0
    quota: int = 0
    last: int = 0


@dataclass
class Plan:
    """Sources by code point, null last; words of a block; number of shards; the seed of all draws."""

    sources: list[Source]
    block: int
    shards: int
    seed: int

    @property
    def quota(self) -> int:
        return sum(s.quota for s in self.sources)

    @property
    def wide(self) -> np.ndarray:
        """Positions of a cell, by source: what a shard has of the source, or so."""
        return np.array([max(1, -(-s.quota // self.shards)) for s in self.sources], np.int64)


def n_words(text: str | Column) -> Column:
    """Number of runs of other characters than the six ASCII spaces; null counts 0. One pass, without a list of words."""
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.rtrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(trimmed, f"[{SPACES}]*[^{SPACES}]+", "w")).cast("long")


def targets(words: list[int], weights: list[int], total: int | None = None, most: int = PASSES) -> list[Fraction]:
    """Shares of the total (all words if not given) by weight, none above most times its words, the excess reshared until none is above. Exact."""
    total = sum(words) if total is None else total
    out = [Fraction(0)] * len(words)
    free = set(range(len(words)))
    left = Fraction(total)
    while free:
        share = left / sum(weights[i] for i in free)
        full = {i for i in free if share * weights[i] > most * words[i]}
        if not full:
            for i in free:
                out[i] = share * weights[i]
            return out
        for i in full:
            out[i] = Fraction(most * words[i])
            left -= out[i]
        free -= full
    return out


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    return kernel.mix(x ^ np.uint64(key & (1 << 64) - 1))


def _key(*parts: int) -> int:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = kernel.step(x, np.array([p & (1 << 64) - 1], np.uint64), kernel.FIRST)
        x = kernel.mix(x)
    return int(x[0])


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each of x (0 to n - 1) in a permutation of 0 to n - 1: Feistel rounds, walked until inside."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(6):
            a, b = b, a ^ (_mixed(b, key + r * 0x9E3779B97F4A7C15) & low)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _quota(s: Source, k: int, block: int, seed: int) -> None:
    """Blocks, quota and words of the last block taken of source k, for its target rounded to whole words."""
    s.blocks = -(-s.words // block)
    take = min(round(s.target), PASSES * s.words)
    if not take:
        return
    passes, rest = divmod(take, s.words)
    if not rest:
        passes, rest = passes - 1, s.words
    short = s.blocks * block - s.words  # what the tape's last block lacks
    at = int(permuted(np.array([s.blocks - 1]), s.blocks, _key(seed, k, passes))[0])
    n = -(-rest // block)
    if n > at:  # the short block is among them
        n = -(-(rest + short) // block)
    s.quota = passes * s.blocks + n
    # n blocks without the last one
    before = (n - 1) * block - (short if n - 1 > at else 0)
    s.last = rest - before


def plan(sized: DataFrame, weights: dict[str | None, int] | None = None, total: int | None = None, block: int = BLOCK_WORDS, shards: int | None = None, seed: int = 0) -> Plan:
    """What the mix takes of sized(source, size): one row a source comes to the driver, as sources are few beside documents.

    Without weights, sources weigh 1, 2, 3, 1, ... by code point, null last. total is the mix's words (all sizes if not given, at most PASSES times
    as many). Blocks are at least block words, more where there would be over MOST_BLOCKS; without shards, a shard has about SHARD_BLOCKS blocks.
    """
    rows = sorted(((r["source"], int(r["words"] or 0)) for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sources = [Source(name, words, weights.get(name, 0) if weights is not None else i % 3 + 1) for i, (name, words) in enumerate(rows)]
    used = [s for s in sources if s.weight > 0]
    if total is not None:
        total = min(total, PASSES * sum(s.words for s in used))
    elif weights is not None:
        total = sum(s.words for s in used)
    for s, t in zip(used, targets([s.words for s in used], [s.weight for s in used], total), strict=True):
        s.target = t
    block = max(block, -(-PASSES * sum(s.words for s in sources) // MOST_BLOCKS))
    for k, s in enumerate(sources):
        _quota(s, k, block, seed)
    quota = sum(s.quota for s in sources)
    return Plan(sources, block, shards or max(1, -(-quota // SHARD_BLOCKS)), seed)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, h, copies: rows that agree in all but their copies are one row, so copies of a row never meet in a sort."""
    words = n_words(text)
    h = F.xxhash64(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), h.alias("h"))
    return rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies"))


def taped(rows: DataFrame, known: Plan) -> DataFrame:
    """rows of sized with source index k and start: the words of the source's tape before the row (its first copy)."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(k, s.name) for k, s in enumerate(known.sources)], "k int, source string")
    indexed = rows.alias("r").join(small(names).alias("n"), F.col("r.source").eqNullSafe(F.col("n.source"))).select("r.*", "k")
    # cells of the hash's upper bits; a plain count, as the number of rows is known only then
    bits = min(40, max(0, math.ceil(math.log2(max(1, rows.count()) / CELL_DOCS))))
    cell = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    indexed = indexed.withColumn("cell", cell).withColumn("all", F.col("size") * F.col("copies"))
    cells = indexed.groupBy("k", "cell").agg(F.sum("all").alias("words"))
    before = F.sum("words").over(Window.partitionBy("k").orderBy("cell")) - F.col("words")
    cells = stored(cells.select("k", "cell", before.alias("before")), "cells")
    inside = F.sum("all").over(Window.partitionBy("k", "cell").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", "source").rowsBetween(Window.unboundedPreceding, -1))
    placed = indexed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(small(cells), ["k", "cell"])
    return placed.select("doc_id", "source", "size", "h", "copies", "k", (F.col("before") + F.col("inside")).alias("start"))


def _node(known: Plan, lo: int, hi: int, quotas: np.ndarray) -> tuple[int, np.ndarray]:
    """The middle of shards lo to hi, and how many of the quotas' blocks the left half gets."""
    mid = (lo + hi) // 2
    rng = np.random.Generator(np.random.Philox(key=_key(known.seed, lo, hi)))
    return mid, rng.multivariate_hypergeometric(quotas, _capacity(known, lo, mid), method="marginals")


def _capacity(known: Plan, lo: int, hi: int) -> int:
    """Blocks of shards lo to hi: all shards have equally many, the first ones of an uneven rest one more."""
    each, more = divmod(known.quota, known.shards)
    return each * (hi - lo) + max(0, min(hi, more) - min(lo, more))


def leaves(spark: SparkSession, known: Plan) -> DataFrame:
    """shard, k, first, n, cell: the positions of each source that each shard takes, a row for each cell of positions that they touch.

    A task walks from the root down to its subtree of SUBTREE shards and deals them out; the numbers that it holds are those of one path.
    """
    ship(spark)
    wide = known.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                out: list[tuple[np.ndarray, ...]] = []
                b = min(a + SUBTREE, known.shards)
                todo = [(0, known.shards, np.array([s.quota for s in known.sources], np.int64), np.zeros(len(known.sources), np.int64))]
                while todo:
                    lo, hi, quotas, first = todo.pop()
                    if hi <= a or lo >= b or not quotas.any():
                        continue
                    if hi - lo == 1:
                        k = np.flatnonzero(quotas)
                        out.append((np.full(len(k), lo), k, first[k], quotas[k]))
                        continue
                    mid, left = _node(known, lo, hi, quotas)
                    todo += [(lo, mid, left, first), (mid, hi, quotas - left, first + left)]
                if out:
                    shard, k, first, n = (np.concatenate(c) for c in zip(*out, strict=True))
                    low = first // wide[k]
                    many = (first + n - 1) // wide[k] - low + 1
                    row = np.repeat(np.arange(len(k)), many)
                    cell = low[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(k[row], pa.int32()), pa.array(first[row]), pa.array(n[row]), pa.array(cell)], ["shard", "k", "first", "n", "cell"])

    return spark.range(0, known.shards, SUBTREE).mapInArrow(kernel.lean(run), "shard long, k int, first long, n long, cell long")


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each copy, numbered from 0; runs of copies first, so that no array is long."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(1 << 14).cast("long"))))
    return runs.withColumn("copy", F.explode(F.sequence("run", F.least(F.col("run") + (1 << 14), "copies") - 1))).drop("run")


def _pieces(rows: DataFrame, known: Plan) -> DataFrame:
    """What the mix takes of each taped row: what names it, copy, pos (the block's permuted position) and its cell, from_word, words."""
    block, seed, sources, wide = known.block, known.seed, known.sources, known.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, start, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            lo, hi = start // block, (start + size - 1) // block
            for one in kernel.slices(np.concatenate([[0], np.cumsum(hi - lo + 1)]), 1 << 18):
                rows_ = np.repeat(np.arange(*one), (hi - lo + 1)[slice(*one)])
                first = np.cumsum((hi - lo + 1)[slice(*one)]) - (hi - lo + 1)[slice(*one)]
                at = lo[rows_] + np.arange(len(rows_)) - first[rows_ - one[0]]
                begin = np.maximum(start[rows_], at * block)
                end = np.minimum(start[rows_] + size[rows_], (at + 1) * block)
                found = []
                for s in np.unique(k[rows_]):
                    own = np.flatnonzero(k[rows_] == s)
                    src = sources[s]
                    for e in range(-(-src.quota // max(src.blocks, 1))):
                        pos = permuted(at[own], src.blocks, _key(seed, int(s), e)) + e * src.blocks
                        stop = np.where(pos == src.quota - 1, np.minimum(end[own], at[own] * block + src.last), end[own])
                        taken = (pos < src.quota) & (stop > begin[own])
                        o = own[taken]
                        found.append((rows_[o], pos[taken], begin[o] - start[rows_[o]], stop[taken] - begin[o]))
                if found:
                    r, pos, a, n = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(k[r], pa.int32()), pa.array(pos), pa.array(pos // wide[k[r]]), pa.array(a), pa.array(n)], ["id", "k", "pos", "cell", "from_word", "words"])

    one = _copies(rows.where("size > 0")).select(F.struct("doc_id", "source", "size", "h", "start", "copy").alias("id"), "k", (F.col("start") + F.col("copy") * F.col("size")).alias("start"), "size")
    kind = one.schema["id"].dataType.simpleString()
    return one.mapInArrow(kernel.lean(run), f"id {kind}, k int, pos long, cell long, from_word long, words long").select("id.*", "k", "pos", "cell", "from_word", "words")


def mix(rows: DataFrame, known: Plan) -> DataFrame:
    """shard, place, doc_id, source, size, h, start, copy, k, pos, from_word, words: the mix of the rows of taped, by shards.

    Each row is a run of words of one copy of a document; from_word counts words of its text from 0. Blocks stand in the order of a hash inside
    their shard, place counts rows from 1. The sum of words of a source is its target, rounded. Empty documents are in no mix.
    """
    dealt = small(stored(leaves(rows.sparkSession, known), "leaves"))
    found = _pieces(rows, known).join(dealt, ["k", "cell"]).where("pos >= first AND pos < first + n")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("k", "pos", F.lit(known.seed)), "k", "pos", "from_word", "h", F.col("doc_id").asc_nulls_last(), "copy")
    return found.withColumn("place", F.row_number().over(order)).select("shard", "place", "doc_id", "source", "size", "h", "start", "copy", "k", "pos", "from_word", "words")


def texts(mixed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """shard, place, doc_id, source and the words themselves: from the first word of each run to its last, with what stands between.

    A run that ends its document takes what follows the last word, one that begins it what precedes the first.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"), F.col(text).cast("string").alias("text")).dropDuplicates(["doc_id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernel.utf8(batch.column(4))
            first, n, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in (5, 6, 7))
            out = []
            for lo, hi in kernel.slices(offs):
                part, cut = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, _, words = kernel.split_words(part, cut)
                for i in range(hi - lo):
                    a = cut[i] if first[lo + i] == 0 else starts[words[i] + first[lo + i]]
                    last = first[lo + i] + n[lo + i]
                    b = cut[i + 1] if last == size[lo + i] else starts[words[i] + last]
                    out.append(part[a:b].tobytes().decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(out, pa.string())], ["shard", "place", "doc_id", "source", "text"])

    both = mixed.alias("m").join(own.alias("d"), F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.h") == F.col("d.h")))
    kind = own.schema["doc_id"].dataType.simpleString()
    return both.select("shard", "place", "m.doc_id", "m.source", "d.text", "from_word", "words", "size").mapInArrow(kernel.lean(run), f"shard long, place int, doc_id {kind}, source string, text string")


def mixture(docs: DataFrame, weights: dict[str | None, int] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", **options: int) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan, the taped documents and the mix of docs; options are those of plan.

    Sizes are numbers of words; null texts and blank ones have none and are never taken. A null source is a source. Rows that repeat are copies with places
    of their own on the tape. Documents with the same id but other texts are told apart. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = stored(sized(docs, key, text, source), "sized")
    known = plan(rows.withColumn("size", F.col("size") * F.col("copies")), weights, **options)
    tape = stored(taped(rows, known), "tape")
    return known, tape, mix(tape, known)


def taken(docs: DataFrame, weights: dict[str | None, int] | None = None, **options: int) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, runs, shard (the first that has the row) for every row of docs, from the mix."""
    known, tape, mixed = mixture(docs, weights, **options)
    sums = mixed.groupBy("k", "start", "copy").agg(F.sum("words").alias("taken"), F.count("*").alias("runs"), F.min("shard").alias("shard"))
    # an empty row may stand where another begins
    there = F.when(F.col("size") > 0, F.col("start"))
    both = _copies(tape).withColumn("start", there).join(sums, ["k", "start", "copy"], "left")
    facts = docs.sparkSession.createDataFrame([(k, s.words, float(s.target)) for k, s in enumerate(known.sources)], "k int, source_size long, target double")
    return both.join(small(facts), "k").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("runs", F.lit(0)).alias("runs"), "shard")
