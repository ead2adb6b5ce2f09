"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train numpy classifiers. With the class prior p, the risk is
p * R_pos(toxic) + max(0, R_unl(clean) - p * R_pos(clean)): the second term estimates the risk on clean text
from unlabelled text with the toxic share taken out, and is held at zero from below; where it falls
under zero the step ascends instead, which stops over-fitting of the unlabelled sample.

Features are hashed words and word beginnings. One classifier is trained for each shard of the unlabelled sample,
in its own task; the score is the logistic function of the mean of their margins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import kernel
from threadlake.session import ship, stored

PREFIXES = (5, 6, 7, 9)
#: Bounds of the training sample: confirmed toxic documents, unlabelled documents, and shards of the latter.
POSITIVES, UNLABELLED, SHARDS = 2000, 6000, 4
#: A feature counts if so many confirmed documents, and such a share of them, have it, its share there exceeds that in
#: unlabelled text by so many standard errors, and that in clean text so many times.
LEAST_DOCS, LEAST_SHARE, LEAST_Z, LEAST_LIFT = 3, 0.02, 4.0, 4.0
EPOCHS, RATE, DECAY = 300, 0.05, 1e-4
#: Occurrences in a hundred words count up to this.
MOST_RATE = 8.0
#: Margins beyond this lose no more: one example's risk is bounded, as the estimator needs.
BOUND = 3.0
TABLE_BITS = 20


class Model:
    """Feature hashes (sorted), their weights for presence and for rate, the weight of the log length, and the bias."""

    def __init__(self, names: np.ndarray, present: np.ndarray, rate: np.ndarray, size: float, bias: float):
        self.names, self.present, self.rate, self.size, self.bias = names, present, rate, size, bias
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[names >> np.uint64(64 - TABLE_BITS)] = True

    def margins(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)
        out = np.full(len(n), self.bias) + self.size * centred(n)
        word, kind = np.nonzero(self.table[hashes >> np.uint64(64 - TABLE_BITS)])
        h = hashes[word, kind]
        at = np.searchsorted(self.names, h)
        ok = at < len(self.names)
        ok[ok] = self.names[at[ok]] == h[ok]
        if ok.any():
            row = np.searchsorted(bounds, word[ok], side="right") - 1
            pair, count = np.unique(row * len(self.names) + at[ok], return_counts=True)
            row, at = pair // len(self.names), pair % len(self.names)
            out += np.bincount(row, weights=self.present[at] + self.rate[at] * rates(count, n[row]), minlength=len(n))
        return out


def centred(n: np.ndarray) -> np.ndarray:
    return np.log2(1 + n) - 8.0


def rates(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.minimum(100.0 * count / (n + 30.0), MOST_RATE)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (words, 1 + len(PREFIXES)), word bounds of each row."""
    starts, ends, bounds = kernel.split_words(data, offsets)
    values = kernel.LOWER[data]
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.uint64)
    for c, n in enumerate((0, *PREFIXES)):
        stop = np.minimum(ends, starts + n) if n else ends
        out[:, c] = kernel.byte_hashes(values, starts, stop)[0] * np.uint64(2 * c + 1) + np.uint64(c)
    return out, bounds


def _train(docs: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray, n_p: int, prior: float) -> Model:
    """docs: distinct features and their counts of each document, the n_p confirmed ones first; size: words of each."""
    none = np.zeros(0)
    n_u = len(docs) - n_p
    if not n_p or not n_u:
        return Model(np.zeros(0, np.uint64), none, none, 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    least = max(LEAST_DOCS, LEAST_SHARE * n_p)
    sizes = np.array([len(d[0]) for d in docs])
    rows = np.repeat(np.arange(len(docs)), sizes)
    names, cols = np.unique(np.concatenate([d[0] for d in docs]), return_inverse=True)
    counts = np.concatenate([d[1] for d in docs])
    in_pos = np.bincount(cols[rows < n_p], minlength=len(names))
    in_unl = np.bincount(cols[rows >= n_p], minlength=len(names))
    share_p, share_u = in_pos / n_p, in_unl / n_u
    both = (in_pos + in_unl + 1) / (len(docs) + 2)
    z = (share_p - share_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    share_c = np.maximum(0, share_u - prior * share_p) / (1 - prior)  # the share in clean text, toxic text taken out
    keep = (in_pos >= least) & (z >= LEAST_Z) & (share_p >= LEAST_LIFT * share_c)
    names, place = names[keep], np.cumsum(keep) - 1
    sel = keep[cols]
    rows, cols, counts, m_f = rows[sel], place[cols[sel]], counts[sel], len(names)
    # presence and rate of each feature, then the log length
    vals = np.concatenate([np.ones(len(rows)), rates(counts, size[rows]), centred(size)])
    cols = np.concatenate([cols, m_f + cols, np.full(len(docs), 2 * m_f)])
    rows = np.concatenate([rows, rows, np.arange(len(docs))])
    w, b = np.zeros(2 * m_f + 1), -2.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        f = np.bincount(rows, weights=w[cols] * vals, minlength=len(docs)) + b
        inside = np.abs(f) < BOUND
        q = 1 / (1 + np.exp(-np.clip(f, -BOUND, BOUND)))
        loss_clean = np.logaddexp(0, np.clip(f, -BOUND, BOUND))
        rest = loss_clean[n_p:].mean() - prior * loss_clean[:n_p].mean()
        g = np.zeros(len(docs))
        clean = np.concatenate([-prior * q[:n_p] / n_p, q[n_p:] / n_u]) * inside
        if rest >= 0:
            g += clean
            g[:n_p] += prior * (q[:n_p] - 1) * (f[:n_p] < BOUND) / n_p
        else:
            g -= clean
        gw = np.bincount(cols, weights=g[rows] * vals, minlength=len(w)) + DECAY * w
        gb = g.sum()
        m, s = 0.9 * m + 0.1 * gw, 0.999 * s + 0.001 * gw * gw
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        step = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(s) + 1e-8)
        b -= step * mb / (np.sqrt(sb) + 1e-8)
    return Model(names, w[:m_f], w[m_f:-1], float(w[-1]), float(b))


def mean_model(models: list[Model]) -> Model:
    """The model whose margin is the mean of the models' margins."""
    k = len(models)
    names, at = np.unique(np.concatenate([m.names for m in models]), return_inverse=True)
    add = lambda x: np.bincount(at, weights=np.concatenate(x), minlength=len(names)) / k if len(names) else np.zeros(0)
    return Model(names, add([m.present for m in models]), add([m.rate for m in models]), sum(m.size for m in models) / k, sum(m.bias for m in models) / k)


def _rows(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the features and word bounds of the texts in column at."""
    for batch in batches:
        data, offs = kernel.utf8(batch.column(at))
        for lo, hi in kernel.slices(offs):
            yield batch.slice(lo, hi - lo), *features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature is."""
    for _, f, bounds in _rows(batches, 0):
        own = [np.unique(f[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        names, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """The bounded sample (doc_id, pos, unl, shard, text) and the class prior among labelled training rows.

    Training rows are those whose crc32(doc_id as text) mod 4 is not 2. Samples are the first rows by a hash of doc_id.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = own.agg(F.avg("toxic")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos = own.where("toxic = 1").select("doc_id").orderBy(*order).limit(positives).withColumn("pos", F.lit(True))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").where(fold)
    unl = ids.distinct().orderBy(*order).limit(unlabelled).withColumn("unl", F.lit(True))
    # at most positives + unlabelled ids: small enough to send to every task
    chosen = pos.join(unl, "doc_id", "full").select("doc_id", F.coalesce("pos", F.lit(False)).alias("pos"), F.coalesce("unl", F.lit(False)).alias("unl"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SHARDS)).cast("int")
    return stored(texts.select("doc_id", "pos", "unl", shard.alias("shard"), "text"), "toxic-sample"), float(prior or 0.0)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """The mean of the shards' classifiers; all have the confirmed examples, each its share of the unlabelled ones. prior: the toxic share, where labels are no fair sample."""
    spark = docs.sparkSession
    ship(spark)
    rows, found = sample(docs, labels, positives, unlabelled)
    prior = found if prior is None else prior
    known = rows.where("pos")
    least = max(LEAST_DOCS, int(np.ceil(LEAST_SHARE * known.count())))
    # features that enough confirmed texts have: their number is bounded by the features of a text over LEAST_SHARE
    common = known.select("text").mapInArrow(_counts, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("name").collect()
    names = spark.sparkContext.broadcast(np.sort(np.array([r["name"] for r in common], np.int64).view(np.uint64)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, f, bounds in _rows(batches, 4):
            own = [np.unique(f[a:b][np.isin(f[a:b], names.value)], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [pa.array(np.diff(bounds)), pa.array([u.tobytes() for u, _ in own], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], ["doc_id", "pos", "unl", "shard", "n", "features", "counts"])

    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            parts += zip(*(c.to_pylist() for c in batch.select(["confirmed", "doc_id", "n", "features", "counts"]).columns), strict=True)
        parts.sort(key=lambda r: (not r[0], r[1]))
        own = [(np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], "<i4")) for r in parts]
        m = _train(own, np.array([r[2] for r in parts]), sum(r[0] for r in parts), prior)
        yield pa.RecordBatch.from_arrays([pa.array([m.names.tobytes()], pa.binary()), pa.array([np.concatenate([m.present, m.rate, [m.size, m.bias]]).tolist()], pa.list_(pa.float64()))], ["names", "weights"])

    sparse_rows = rows.mapInArrow(sparse, "doc_id long, pos boolean, unl boolean, shard int, n long, features binary, counts binary")
    roles = F.concat(F.when(F.col("pos"), F.transform(F.sequence(F.lit(0), F.lit(SHARDS - 1)), lambda s: F.struct(s.alias("shard"), F.lit(True).alias("confirmed")))).otherwise(F.array().cast("array<struct<shard:int,confirmed:boolean>>")), F.when(F.col("unl"), F.array(F.struct(F.col("shard"), F.lit(False).alias("confirmed")))).otherwise(F.array().cast("array<struct<shard:int,confirmed:boolean>>")))
    dealt = sparse_rows.withColumn("role", F.explode(roles)).select("role.shard", "role.confirmed", "doc_id", "n", "features", "counts")
    models = []
    for r in dealt.groupBy("shard").applyInArrow(one, "names binary, weights array<double>").collect():
        own, w = np.frombuffer(bytes(r["names"]), np.uint64), np.array(r["weights"])
        models.append(Model(own, w[: len(own)], w[len(own) : -2], w[-2], w[-1]))
    return mean_model(models) if models else _train([], np.zeros(0), 0, prior)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...), from the text alone.

    A null or empty text scores by the bias and its length. Null doc_ids are scored, held_out false. Repeated rows
    are kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernel.utf8(batch.column(2))
            margin = [np.zeros(0)]
            for lo, hi in kernel.slices(offs):
                margin.append(sent.value.margins(*features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(margin), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs(text, ...) that score below threshold, with all their columns; nothing is shuffled.

    Null and empty texts have nothing to judge and stay, whatever the model's bias. Null doc_ids and repeated rows are judged by
    their text; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernel.utf8(batch.column(at).cast(pa.string()))
            margin = [np.zeros(0)]
            for lo, hi in kernel.slices(offs):
                margin.append(sent.value.margins(*features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(margin), -30, 30)))
            empty = np.diff(offs) == 0
            yield batch.filter(pa.array((score < threshold) | empty))

    return docs.mapInArrow(kernel.lean(run), docs.schema)
