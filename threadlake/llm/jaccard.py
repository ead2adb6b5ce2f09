"""N-gram Jaccard self-join by parity sketches.

Every distinct k-word shingle of a text flips one bit of a wide sketch (an XOR of one-bit hashes), so the
Hamming distance of two sketches never exceeds the size of the symmetric difference of the shingle sets.
Sets that reach the similarity differ in at most d shingles, d known from the sizes. The sketch is cut
into K > d chunks: two linked sets agree on K - d chunks at least. Each set leaves out its K - d - 1
lightest chunks (by number of shingles, then by content) and joins on the others; of the chunks on which
a pair agrees, the heaviest is left out by neither. Chunks that hold several shingles are met by chance
almost never, so shared passages and empty chunks do not make groups. Bands of sizes keep d tight.

Within a chunk's group no pairs are listed: every member meets the group's smallest and largest member,
verified links are merged into components, and only groups that still hold several components are
compared further, in blocks of bounded size, on folded 1024-bit sketches: first each member with its nearest of
another component, at last with all that are near enough. What passes is verified on the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm import kernel
from threadlake.llm.components import components
from threadlake.session import settle, ship, stored

FOLD = 1024
BLOCK = 384
#: So many rows of two numbers are broadcast at most.
MOST_SENT = 1_000_000
#: Rounds of nearest members at most, before the round that tests all.
ROUNDS = 3


def bands(num: int, den: int, largest: int) -> np.ndarray:
    """Lower size limits of the bands; a linked pair lies in one band or in two neighbours."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * den // num + 1)
    return np.array([*out, out[-1] * den // num + 1, (out[-1] * den // num + 1) * den // num + 1], np.int64)


def most_apart(size_sum, num: int, den: int):
    """Largest symmetric difference of two linked sets with that sum of sizes."""
    return (den - num) * size_sum // (den + num)


def fold(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """The parity sketch folded to FOLD bits: bytes per row."""
    bits = np.bincount(rows * FOLD + (values & np.uint64(FOLD - 1)).astype(np.int64), minlength=n_rows * FOLD)
    return np.packbits((bits & 1).astype(np.uint8).reshape(n_rows, FOLD), axis=1)


def chunk_keys(values: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of each row's set and the row of each key."""
    sizes = np.diff(bounds)
    keys, owners = [], []
    if len(values) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    limits = bands(num, den, int(sizes.max()))
    band = np.searchsorted(limits, sizes, side="right") - 1
    rows = np.repeat(np.arange(len(sizes)), sizes)
    high = values >> np.uint64(32)
    mixed = kernel.mix(values)
    for step in (0, 1):  # the group of this band and the next, and that of the band before and this
        group = band - step
        used = (group >= 0) & (sizes > 0)
        d = most_apart(2 * (limits[np.maximum(group, 0) + 2] - 1), num, den)
        k = np.where(used, d + 1 + (d + 1) // 2, 0)
        base = np.cumsum(k) - k
        sel = used[rows]
        r = rows[sel]
        slot = base[r] + ((high[sel] * k[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = int(k.sum())
        if total == 0:
            continue
        order = np.argsort(slot.astype(np.uint16), kind="stable") if total < 65536 else np.argsort(slot, kind="stable")
        s = slot[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        content = np.bitwise_xor.reduceat(mixed[sel][order], first)
        weight = np.minimum(np.diff(np.concatenate([first, [len(s)]])), 255).astype(np.uint64)
        row = r[order][first]
        chunk = s[first] - base[row]
        content = kernel.mix(content ^ kernel.mix((chunk + group[row] * 1_000_003).astype(np.uint64)))
        # heaviest first inside each row; empty chunks are the lightest
        rank = np.lexsort((content, np.uint64(255) - weight, row))
        row = row[rank]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < (d + 1)[row]
        keys.append(content[rank][keep])
        owners.append(row[keep])
        # a set whose shingles fill d chunks or fewer needs some of its empty chunks too
        full = np.bincount(row, minlength=len(sizes))
        for i in np.flatnonzero(used & (full < d + 1)):
            there = np.zeros(k[i], bool)
            there[chunk[rank][row == i]] = True
            empty = np.flatnonzero(~there).astype(np.uint64)
            content_e = np.sort(kernel.mix(kernel.mix(empty + np.uint64(int(group[i]) * 1_000_003)) ^ np.uint64(0x5851F42D4C957F2D)))
            own = _with_parts(content_e[: d[i] + 1 - full[i]], values[bounds[i] : bounds[i + 1]], mixed[bounds[i] : bounds[i + 1]], int(d[i]) + 1)
            keys.append(own)
            owners.append(np.full(len(own), i))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _with_parts(keys: np.ndarray, values: np.ndarray, mixed: np.ndarray, parts: int) -> np.ndarray:
    """Keys of empty chunks, each with the content of every part of the set.

    Many unrelated small sets have the same chunks empty. Two sets that agree on empty chunks only both need them, and differ in fewer
    shingles than there are parts: of the parts of any division they agree on one at least. Divisions by independent hashes are put on
    top of each other, as long as a key does not become more than 64.
    """
    for level in range(max(1, int(np.log(64) / np.log(max(parts, 2))))):
        part = ((kernel.mix(values + np.uint64(0xD1342543DE82EF95 * (level + 1) & (1 << 64) - 1)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(sums, part, mixed)
        tags = kernel.mix(sums ^ kernel.mix(np.arange(parts, dtype=np.uint64) + np.uint64(7919 * (level + 1))))
        keys = kernel.mix(kernel.step(keys[:, None], tags[None, :], kernel.FIRST)).ravel()
    return keys


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = kernel.utf8(column)
    for lo, hi in kernel.slices(offs):
        part, cut = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, words = kernel.split_words(part, cut)
        values, rows = kernel.shingles(kernel.word_hashes(part, starts, ends), words, k)
        yield lo, hi, *kernel.unique_in_rows(values, rows, hi - lo)


def _node(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each row's set; equal sets have equal numbers. Never negative."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(kernel.mix(values + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
    out = kernel.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64))
    return (out >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, node (one number for equal sets), folded sketch and join keys; the last two at a set's first row in a task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, values, bounds in _sets(batch.column(1), k):
                sizes = np.diff(bounds)
                nodes = _node(values, bounds)
                fresh = np.zeros(hi - lo, bool)
                for i, x in enumerate(nodes.tolist()):
                    if sizes[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                own = np.flatnonzero(fresh)
                take = np.repeat(fresh, sizes)
                v = values[take]
                b = np.concatenate([[0], np.cumsum(sizes[own])])
                rows = np.repeat(np.arange(len(own)), sizes[own])
                keys, owners = chunk_keys(v, b, num, den)
                order = np.argsort(owners, kind="stable")
                per = np.zeros(hi - lo, np.int64)
                per[own] = np.bincount(owners, minlength=len(own))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(keys[order]))
                folded = fold(v, rows, len(own)) if len(own) else np.zeros((0, FOLD // 8), np.uint8)
                sketch: list[bytes | None] = [None] * (hi - lo)
                for j, i in enumerate(own.tolist()):
                    sketch[i] = folded[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(nodes), pa.array(sketch, pa.binary()), lists],
                    ["doc_id", "n_shingles", "node", "sketch", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel.lean(run), "doc_id long, n_shingles long, node long, sketch binary, keys array<bigint>")


@F.pandas_udf(T.BooleanType())
def _near(sa, sb, d):
    """Whether the folded sketches differ in d bits at most."""
    import pandas as pd

    if not len(sa):
        return pd.Series([], dtype=bool)
    x = np.frombuffer(b"".join(sa), np.uint64).reshape(len(sa), -1) ^ np.frombuffer(b"".join(sb), np.uint64).reshape(len(sb), -1)
    return pd.Series(np.bitwise_count(x).sum(axis=1) <= d.to_numpy())


@F.pandas_udf(T.LongType())
def _shared(va, vb):
    """Number of common values of two sorted sets."""
    import pandas as pd

    return pd.Series([len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(va, vb, strict=True)], dtype="int64")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets reach the similarity, compared on the sets."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    which = stored(nodes.join(need, "node", "left_semi").select(F.col("rep").alias("doc_id"), "node"), "which")
    # up to MOST_SENT ids (16 bytes each) go to every task, so that texts stay where they are; beyond, both sides are shuffled
    if which.count() <= MOST_SENT:
        which = F.broadcast(which)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, bounds in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()), pa.array(np.diff(bounds))], ["node", "members", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(which, "doc_id")
    sets = stored(texts.select("node", "text").mapInArrow(kernel.lean(run), "node long, members binary, n long").dropDuplicates(["node"]), "sets")
    x = pairs.join(sets.withColumnsRenamed({"node": "a", "members": "va", "n": "na"}), "a").join(sets.withColumnsRenamed({"node": "b", "members": "vb", "n": "nb"}), "b")
    x = x.withColumn("both", _shared("va", "vb"))
    return x.where(F.expr(f"{den} * both >= {num} * (na + nb - both)")).select("a", "b")


def _block_pairs(mixed: DataFrame, nodes: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Candidate pairs of different components inside each key's group: block against block, at most BLOCK members each or so.

    nearest: of each member only the closest candidate in each block, else all of them.
    """
    w = Window.partitionBy("key")
    rows = mixed.withColumn("parts", (F.count("*").over(w) / F.lit(BLOCK)).cast("int") + 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    rows = rows.join(nodes.select("node", "n", "sketch"), "node")
    # block i meets each block j >= i: its rows go to every pair of blocks that has it
    both = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    both = both.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("pair"), (F.col("part") > F.col("other")).alias("second"), "node", "comp", "n", "sketch")
    # a block that meets itself has its rows once, as the first side
    both = both.repartition("pair").sortWithinPartitions("pair", "second", "node")

    def meet(pair: list[np.ndarray], seen: set) -> tuple[list, list]:
        second, node, comp, n, sketch = pair
        cut = int(np.searchsorted(second, True))
        left = slice(0, cut)
        right = slice(cut, len(node)) if cut < len(node) else left
        if not cut or comp.min() == comp.max():
            return [], []
        apart = np.bitwise_count(sketch[left][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int32)
        near = apart <= most_apart(n[left][:, None] + n[right][None, :], num, den)
        near &= comp[left][:, None] != comp[right][None, :]
        if nearest:
            apart = np.where(near, apart, 1 << 30)
            pick = np.zeros_like(near)
            pick[np.arange(len(apart)), apart.argmin(axis=1)] = True
            pick[apart.argmin(axis=0), np.arange(apart.shape[1])] = True
            near &= pick
        i, j = np.nonzero(near)
        x, y = node[left][i], node[right][j]
        found = set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)) - seen
        seen |= found
        return [p[0] for p in found], [p[1] for p in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[np.ndarray] | None = None

        def out(parts: list[np.ndarray], upto: int) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate([[True], parts[0][1:upto] != parts[0][: upto - 1]])).tolist()
            a, b = [], []
            for lo, hi in zip(cuts, [*cuts[1:], upto], strict=True):
                if hi - lo > 1:
                    x, y = meet([p[lo:hi] for p in parts[1:]], seen)
                    a += x
                    b += y
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            cols.append(kernel.utf8(batch.column(5))[0].view(np.uint64).reshape(batch.num_rows, -1))
            held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            # the last pair of blocks may go on in the next batch
            upto = int(np.searchsorted(held[0], held[0][-1]))
            if upto:
                yield out(held, upto)
                held = [x[upto:] for x in held]
        if held is not None and len(held[0]):
            yield out(held, len(held[0]))

    return both.select("pair", "second", "node", "comp", "n", "sketch").mapInArrow(kernel.lean(run), "a long, b long").distinct()


def _few(df: DataFrame) -> DataFrame:
    """A stored table of rows of two numbers, marked for broadcast if it has MOST_SENT rows or fewer; beyond, joins are left to Spark."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text, ...).

    Sets are the distinct k-word shingles of the A-Z-lowered text; fewer than k words make one shingle; null, empty
    or blank texts have the empty set and no links. Two rows link when den * |A n B| >= num * |A u B|; component_id is
    the smallest doc_id that links reach, itself included. Equal texts link. Repeated doc_ids share a row's fate
    by text; a null doc_id stays null and has no say in component_id unless its whole component is null.
    Other columns are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    sig = stored(sketches(docs, k, num, den), "sketches")
    # a set's sketch is at its first row in each task; other rows of the node may lack it
    nodes = stored(sig.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")), "nodes")
    w = Window.partitionBy("key")
    keyed = sig.where(F.col("keys").isNotNull()).select("node", F.explode("keys").alias("key"))
    grouped = keyed.withColumn("low", F.min("node").over(w)).withColumn("top", F.max("node").over(w)).where("low < top")
    grouped = stored(grouped, "groups")
    settle(docs.sparkSession)  # the widest step is over
    pairs = grouped.select(F.col("low").alias("a"), F.col("node").alias("b")).union(grouped.select(F.col("node").alias("a"), F.col("top").alias("b"))).where("a < b").distinct()
    info = nodes.select("node", "n", "sketch")
    x = pairs.join(info.withColumnsRenamed({"node": "a", "n": "na", "sketch": "sa"}), "a").join(info.withColumnsRenamed({"node": "b", "n": "nb", "sketch": "sb"}), "b")
    near = stored(x.withColumn("d", F.expr(f"({den - num} * (na + nb)) div {den + num}")).where(F.abs(F.col("na") - F.col("nb")) <= F.col("d")).where(_near("sa", "sb", "d")).select("a", "b"), "near")
    links = stored(verified(near, docs, nodes, k, num, den), "links")
    comp = _few(components(links))
    tested = near
    # members take their nearest of another component until that links nothing more; then all that is left is tested
    nearest, rounds = True, 0
    while True:
        mixed = grouped.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")).distinct()
        mixed = mixed.withColumn("c0", F.min("comp").over(w)).withColumn("c1", F.max("comp").over(w)).where("c0 < c1").select("key", "node", "comp")
        rest = stored(_block_pairs(mixed, nodes, num, den, nearest).join(tested, ["a", "b"], "left_anti"), "rest")
        more = None
        if not rest.isEmpty():
            more = stored(verified(rest, docs, nodes, k, num, den), "more")
            tested = tested.union(rest)
            if not more.isEmpty():
                links = links.union(more)
                comp = _few(components(links))
            else:
                more = None
        if not nearest:
            break
        rounds += 1
        nearest = more is not None and rounds < ROUNDS
    own = nodes.join(comp, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    # a component of its own needs no other's row
    smallest = _few(stored(nodes.join(comp, "node").groupBy("comp").agg(F.min("rep").alias("component_id")), "smallest"))
    named = own.join(smallest, "comp", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    full = out.where("node IS NOT NULL").join(named, "node").select("doc_id", "n_shingles", "component_id")
    return full.union(out.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
