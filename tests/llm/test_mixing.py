"""The mix against plain arithmetic: targets, quotas, the splitting tree, texts; odd rows."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from threadlake.llm import mixing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t\x0b ", "b"), (4, "a", "b"), (5, " A  b\x0cc\r\n", None), (6, "x" * 70000, "z"), (7, "one two three four five " * 900, "Z"), (7, "one two three four five " * 900, "Z"), (8, "ünï ÇØDÉ x y 日本 🙂", "é"), (9, "w " * 333, "\U0001f642"), (None, "no id at all", "b"), (None, "no id at all", "b"), (None, None, None), (10, "w " * 41, "ｚ")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with those that the mix makes."""
    return spark.createDataFrame([(i, t, s, 3, 1, 0, 2.0, 7) for i, t, s in ODD], "doc_id long, text string, source string, size long, k int, start long, target double, copies int")


def brute_targets(rows, most=3):
    """Source to (size, target), by the rule: shares by weight, what is above three sizes dealt again by weight, until none is above."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = sum(sizes.values())
    out = {s: Fraction(total * weight[s], sum(weight.values())) for s in names}
    while True:
        above = {s for s in names if out[s] >= most * sizes[s]}
        excess = sum(out[s] - most * sizes[s] for s in above)
        if not excess:
            return {s: (sizes[s], out[s]) for s in names}
        rest = sum(weight[s] for s in names if s not in above)
        out = {s: Fraction(most * sizes[s]) if s in above else out[s] + excess * weight[s] / rest for s in names}


def check_taken(got, rows):
    want = brute_targets(rows)
    left = Counter((i, len(WORD.findall(t or "")), s) for i, t, s in rows)
    sums = Counter()
    for r in got:
        left[r["doc_id"], r["size"], r["source"]] -= 1
        size, target = want[r["source"]]
        assert r["source_size"] == size and r["target"] == float(target)
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] += r["taken"]
    assert not any(left.values())
    assert dict(sums) == {s: round(t) for s, (_, t) in want.items()}


@pytest.mark.parametrize("block", [1, 7, 512])
def test_odd_rows(spark, odd, block):
    check_taken(mixing.taken(odd, block=block).collect(), ODD)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (sorted(map(tuple, mixing.taken(d).collect())) for d in (docs, docs.repartition(9)))
    assert a == b
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    check_taken(queries.documents(spark, SF).transform(mixing.taken).collect(), rows)
    assert queries.QUERIES["op12_source_mix"](spark, SF).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


def test_every_block_has_one_place(spark):
    """Shards get disjoint positions without gaps, as many as they hold; passes differ by one at most; the mix's texts are its words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known, tape, mixed = mixing.mixture(docs, block=64, shards=13)
    got = mixed.collect()
    for k, s in enumerate(known.sources):
        own = [r for r in got if r["k"] == k]
        assert sorted({r["pos"] for r in own}) == list(range(s.quota))
        assert all(len({r["shard"] for r in own if r["pos"] == p}) == 1 for p in range(s.quota))
        words = Counter()
        for r in own:
            words[r["pos"]] += r["words"]
        assert all(n <= 64 for n in words.values())
        passes = Counter()  # of each block, named by the tape's words that it begins with
        for r in own:
            passes[(r["start"] + r["copy"] * r["size"] + r["from_word"]) // 64, r["pos"] // s.blocks] = r["pos"]
        assert len(set(passes.values())) == len(passes)
        taken = Counter(b for b, _ in passes)
        assert max(taken.values()) - min(taken.values()) <= 1 or len(taken) < s.blocks
    blocks = Counter(s for s, _, _ in {(r["shard"], r["k"], r["pos"]) for r in got})
    assert max(blocks.values()) - min(blocks.values()) <= 1 and len(blocks) == 13
    for shard in range(13):
        assert sorted(r["place"] for r in got if r["shard"] == shard) == list(range(1, sum(r["shard"] == shard for r in got) + 1))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    place = {(r["shard"], r["place"]): r for r in got}
    seen = mixing.texts(mixed, docs).collect()
    assert len(seen) == len(got)
    for r in seen:
        p = place[r["shard"], r["place"]]
        assert r["doc_id"] == p["doc_id"] and r["text"] in text[r["doc_id"]]
        assert WORD.findall(r["text"]) == WORD.findall(text[r["doc_id"]])[p["from_word"] : p["from_word"] + p["words"]]


def test_shards_draw_like_a_multivariate_hypergeometric(spark):
    """Means and variances of a shard's draws over many seeds."""
    quotas, drawn = [60, 30, 10], []
    for seed in range(400):
        sources = [mixing.Source(str(i), q, 1, Fraction(q), q, q, 1) for i, q in enumerate(quotas)]
        known = mixing.Plan(sources, 1, 5, seed)
        at, lo, hi = np.array(quotas), 0, 5
        while hi - lo > 1:  # the path to shard 0
            mid, at = mixing._node(known, lo, hi, at)
            hi = mid
        drawn.append(at)
    x = np.array(drawn)
    assert (x.sum(axis=1) == 20).all()
    for i, q in enumerate(quotas):
        p = q / 100
        assert abs(x[:, i].mean() - 20 * p) < 0.4
        assert 0.75 < x[:, i].var() / (20 * p * (1 - p) * 80 / 99) < 1.3


def test_permutations():
    for n in (1, 2, 3, 10, 1000, 4097):
        x = mixing.permuted(np.arange(n), n, 12345)
        assert sorted(x.tolist()) == list(range(n))
    x = mixing.permuted(np.arange(1000), 1 << 50, 7)
    assert len(set(x.tolist())) == 1000 and x.min() >= 0 and x.max() < 1 << 50
    assert (mixing.permuted(np.arange(1000), 1000, 1) != mixing.permuted(np.arange(1000), 1000, 2)).any()


@pytest.mark.parametrize("words,block", [(1000, 64), (1024, 64), (63, 64), (1, 1), (1001, 1)])
def test_quotas_hold_the_target(words, block):
    for target in {0, 1, words // 2, words - 1, words, words + 1, 2 * words, 3 * words - 1, 3 * words}:
        for seed in range(5):
            s = mixing.Source("s", words, 1, Fraction(target))
            mixing._quota(s, 0, block, seed)
            total = 0
            for e in range(3):
                pos = mixing.permuted(np.arange(s.blocks), s.blocks, mixing._key(seed, 0, e)) + e * s.blocks
                for b, p in enumerate(pos.tolist()):
                    if p < s.quota:
                        total += s.last if p == s.quota - 1 else min(block, words - b * block)
            assert total == target


def test_targets():
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.targets([100, 1, 1], [1, 1, 1]) == [96, 3, 3]
    assert math.isclose(float(sum(mixing.targets([5, 7, 1000], [1, 2, 3]))), 1012)


def test_other_weights_and_totals(spark, odd):
    got = mixing.taken(odd, weights={"Z": 1, "z": 2}, total=3000).collect()
    assert sum(r["taken"] for r in got) == 3000
    assert {r["source"] for r in got if r["taken"]} == {"Z", "z"}
    assert mixing.taken(odd.where("false")).count() == 0
    assert [r["taken"] for r in mixing.taken(odd.where("doc_id = 1")).collect()] == [0]
