"""Corpus operators against brute force, reference libraries, round trips and held-out accuracy; odd rows of every kind."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as pt
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from threadlake.llm import bpe, decontam, jaccard, kernel, langid, maxent, pii, tiff, tokenfile, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A b c"), (6, "x" * 70000), (7, "one two three four five six seven " * 800), (7, "one two three four five six seven " * 800), (8, "ünï ÇØDÉ \x0b日本 🙂 <|endoftext|> '"), (9, "1234567890" * 50), (None, "one two three four five")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with those that operators make."""
    rows = [(i, t, 1, "s", 0, "en", None, 5.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, sketch string, keys int, lang string, node string, score double")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(pt.path("byte_bpe_50k.tiktoken"))


def tik(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_words_of_bytes():
    rows = ["  Ab\x0bc é ", "", "日本 x", " "]
    data, offs = kernel.utf8(pa.array(rows))
    s, e, b = kernel.split_words(data, offs)
    assert [bytes(data[x:y]).decode() for x, y in zip(s, e)] == ["Ab", "c", "é", "日本", "x"]
    assert b.tolist() == [0, 3, 3, 5, 5]
    h = kernel.word_hashes(*((data, s, e)))
    assert len(set(h.tolist())) == 5


def test_kernel_of_sliced_and_null_arrays():
    a = pa.array(["x", None, "yy", "z"]).slice(1, 3)
    data, offs = kernel.utf8(a)
    assert bytes(data) == b"yyz" and offs.tolist() == [0, 0, 2, 3]


def test_jaccard_equals_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_jaccard_of_families(spark):
    """Chains of edits in which many pairs of a group are close and few reach the similarity; small sets; a shared passage."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (3, 6, 9, 30, 120, 400):
        base = list(rng.choice(words, size))
        for _ in range(25):
            t = list(base)
            for p in rng.integers(0, size, rng.integers(0, max(2, size // 20) + 1)):
                t[p] = str(rng.choice(words))
            rows.append((n, " ".join(t)))
            n += 1
    passage = " ".join(words[:60])
    rows += [(n + i, passage + " " + " ".join(rng.choice(words, 200))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for k, num in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, k, num, 100).collect()}
        assert got == brute_components(dict(rows), k, num, 100)


def test_chunk_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 6, 7, 13, 50, 300):
        for trial in range(60):
            # values over the whole range, over half of it, and crowded into few chunks
            top = (2**64 - 1, 2**63, 2**62)[trial % 3]
            a = np.unique(rng.integers(1, top, n, dtype=np.uint64))
            d = int(jaccard.most_apart(2 * n, 85, 100))
            take = int(rng.integers(0, d + 1))
            drop = min(take // 2, n - 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(1, top, take - drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                k1, _ = jaccard.chunk_keys(a, np.array([0, len(a)]), 85, 100)
                k2, _ = jaccard.chunk_keys(b, np.array([0, len(b)]), 85, 100)
                assert set(k1.tolist()) & set(k2.tolist())


def test_unrelated_small_sets_share_no_key():
    """Of a hundred thousand random sets of five to eight shingles hardly any two meet."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(5, 9, 100_000)
    values = rng.integers(1, 2**64 - 1, int(sizes.sum()), dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    keys, _ = jaccard.chunk_keys(values, bounds, 85, 100)
    assert np.unique(keys, return_counts=True)[1].max() <= 20


def test_bpe_equals_library(docs, texts, ranks):
    enc = tik(ranks)
    for r in bpe.encoded_digests(docs, ranks, pt.PATTERN, block_bytes=50_000).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_of_odd_rows(odd, ranks):
    enc = tik(ranks)
    got = sorted(((r["doc_id"] or -1, r["ids"], bytes(r["decoded"])) for r in bpe.decode(bpe.encode(odd, ranks, pt.PATTERN), ranks).collect()), key=lambda r: (r[0], len(r[1])))
    want = sorted(((i or -1, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD), key=lambda r: (r[0], len(r[1])))
    assert got == want


def test_merge_of_long_pieces(ranks):
    enc = tik(ranks)
    for piece in ("a" * 9000, "abcab" * 2000, "é日" * 1500):
        assert bpe.merge(piece.encode(), ranks) == enc.encode_ordinary(piece)


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert tokenfile.read_codes(*tokenfile.write_codes(v), n).tolist() == v.tolist()


def test_token_file_equals_library(odd, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in df.collect()), key=lambda r: (r[0], len(r[1])))
        got = sorted((r["start"], r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in tokenfile.round_trip(df, pt.path("byte_bpe_50k.json"), pt.PATTERN).collect())
        start, want = 0, []
        for i, ids in rows:
            want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want


def test_base_scores_equal_counts(odd, docs):
    for df in (docs, odd):
        rows = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(LOWER)), None]) for r in df.collect()]
        count = {}
        for i, ws in rows:
            if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
                for w in ws:
                    count[w] = count.get(w, 0) + 1
        n, v = sum(count.values()), len(count)
        want = sorted((i if i is not None else -1, len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
        got = maxent.lm_scores(df).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_gradient_and_curvature_of_scales():
    rng = np.random.default_rng(0)
    k, b, n = maxent.KINDS, maxent.BANDS, 40
    weights = [rng.normal(size=(n, 5)) for _ in range(k)]
    band = [rng.integers(0, b, n).astype(np.uint8) for _ in range(k)]
    plain, target, scales = np.log(np.full((n, 5), 0.2)), rng.integers(0, 5, n), rng.uniform(0, 1, (k, b))
    at = lambda s: maxent._moments(weights, band, plain, s, target)
    grad, curve, _ = at(scales)
    curve = curve.reshape(k * b, k * b)
    for i in rng.choice(k * b, 8, replace=False):
        more, less = scales.copy(), scales.copy()
        more.flat[i] += 1e-4
        less.flat[i] -= 1e-4
        assert abs((at(more)[2] - at(less)[2]) / 2e-4 - grad[i]) < 1e-4
        assert np.allclose((at(less)[0] - at(more)[0]) / 2e-4, curve[i], atol=1e-4)


def test_shares_of_words_sum_to_one():
    """Classes, slots and shares inside a slot leave exactly one share a slot for words that training lacks."""
    words = np.unique(np.random.default_rng(0).integers(1, 2**63, 3000, dtype=np.uint64))
    count, topic = np.arange(1, len(words) + 1), np.arange(len(words)) % 3
    tail_n, tail_v = np.zeros((3, maxent.SLOTS)), np.zeros((3, maxent.SLOTS))
    np.add.at(tail_n, (topic, maxent.slot(words)), count)
    np.add.at(tail_v, (topic, maxent.slot(words)), 1)
    head = [[(int(count[i]), int(words[i])) for i in np.flatnonzero(topic == k)[::-1][: maxent.HEADS * maxent.SLOTS]] for k in range(3)]
    m = maxent.Model(3, 50, head, tail_n, tail_v)
    cell, share, _ = m.word_tables(words, count, topic)
    total = np.bincount(cell, weights=10**share, minlength=m.classes * maxent.SLOTS).reshape(-1, maxent.SLOTS)
    for k in range(3):
        first = 1 + k * (maxent.HEADS + 1)
        assert np.allclose(total[first : first + maxent.HEADS], 1)
        assert np.allclose(total[first + maxent.HEADS], 1 - 1 / (m.tail_n[k] + m.tail_v[k] + 1))
    assert np.allclose(np.exp(m.plain).sum(), 1) and np.allclose(np.exp(m.plain_slots).sum(axis=1), 1)


def test_model_beats_counts_on_held_out_text(spark):
    """By a clear margin, and alike however the table is dealt out."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [{r["doc_id"]: r for r in maxent.lm_scores(df.repartition(n)).collect()} for n in (3, 11)]
    held = [r for r in got[0].values() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.1
    for i, r in got[0].items():
        assert abs(r["score"] - got[1][i]["score"]) < 1e-6 * max(1, abs(r["score"]))


def test_scales_come_from_all_training_documents(spark, monkeypatch):
    """Taking away any part of the training documents moves the scales, also where first rounds read few of them."""
    found = []
    trained = maxent.trained
    monkeypatch.setattr(maxent, "trained", lambda *args: found.append(trained(*args)) or found[-1])
    monkeypatch.setattr(maxent, "FIRST_TOKENS", 1 << 14, raising=False)
    rows = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect())]
    for left in (0, 1, 3, 4, 5, 6):
        # training documents of one remainder only: their scales must differ from those of a model that saw none
        own = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 == left]
        assert len(own) > 10
        maxent.lm_scores(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert all(np.abs(s - maxent.SCALE).max() > 0.05 for s in found)


def test_every_update_of_scales_reads_all_training_documents(spark, monkeypatch):
    """Each round asks for every training document, and where the rounds end hardly anything is left to gain from all of them."""
    monkeypatch.setattr(maxent, "FIRST_TOKENS", 1 << 14, raising=False)
    plain, asked, found, trained = maxent._chosen, spark.sparkContext.accumulator(0), [], maxent.trained

    def chosen(batches, model, part):
        for own in plain(batches, model, part):
            asked.add(len(own[3]))
            yield own

    def watched(table, *args):
        model, counts, part = args[-3:]
        before = asked.value
        scales = trained(table, *args)
        # counts are added up in place later
        found.append((table.toArrow().to_batches(), model, [tuple(c.copy() for c in own) for own in counts[::-1]], part, scales, asked.value - before))
        return scales

    monkeypatch.setattr(maxent, "trained", watched)
    monkeypatch.setattr(maxent, "_chosen", chosen)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    maxent.lm_scores(docs)
    monkeypatch.undo()
    [(batches, model, others, part, scales, read)] = found
    n = sum(part(r["doc_id"]) >= 0 for r in docs.select("doc_id").collect())
    assert read % n == 0 and read >= 2 * n
    size, over = maxent.KINDS * maxent.BANDS, maxent._plain_of_rows(model)
    total = [0, 0]
    for half, h, cell in maxent._tokens(maxent._chosen(batches, model, part)):
        inside = cell >= maxent.SLOTS
        for f, (keep, shares) in enumerate(((slice(None), model.plain[None, :]), (inside, over))):
            cls, counts = cell[keep] // maxent.SLOTS, others[half][f]
            rows = [maxent.rows_of(x[keep], model.bits, *((cls, model.classes) if f else ())) for x in h]
            weights = maxent._weights(counts, shares).astype(float)
            tokens = np.repeat(shares, len(cls), axis=0) if f == 0 else model.plain_slots[cls]
            g, c, _ = maxent._moments([w[r] for w, r in zip(weights, rows)], [maxent.bands(k)[r] for k, r in zip(counts, rows)], tokens, scales[f], cls if f == 0 else cell[keep] % maxent.SLOTS)
            total[f] = total[f] + np.concatenate([g, c])
    for own, s in zip(total, scales):
        grad, curve = own[:size] - maxent.RIDGE * (s.ravel() - maxent.SCALE), own[size:].reshape(size, size) + maxent.RIDGE * np.eye(size)
        free = ~((s.ravel() <= 0) & (grad < 0) | (s.ravel() >= 1.5) & (grad > 0))
        assert grad[free] @ np.linalg.solve(curve[np.ix_(free, free)], grad[free]) / 2 < 2e-5 * model.n


def test_counts_of_halves_add_up_beyond_32_bits():
    for kinds in ((np.uint32, np.uint32), (np.uint64, np.uint32), (np.int64, np.uint64)):
        for n in (5, 2**32 - 1):
            got = maxent.added(np.array([n, 0], kinds[0]), np.array([n, 3], kinds[1]))
            assert got.dtype.kind in "iu" and got.tolist() == [2 * n, 3]


def test_log_shares_of_far_apart_rows():
    """Rows whose targets lie far below the rest stay finite and right; others too."""
    z = np.random.default_rng(1).normal(size=(50, 7)) * np.repeat([1.0, 200.0], 25)[:, None]
    target = np.arange(50) % 7
    want = z - z.max(axis=1, keepdims=True)
    want = want - np.log(np.exp(want).sum(axis=1, keepdims=True))
    p, total, logs = maxent.softmax(z.astype(np.float32), target)
    assert np.allclose(logs, want[np.arange(50), target], rtol=1e-5, atol=1e-5)
    assert np.allclose(p / total[:, None], np.exp(want), atol=1e-4)


def test_language_of_held_out_rows(docs):
    got = langid.languages(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.95


def test_language_of_odd_and_mixed_rows(spark, docs, odd):
    m = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.languages(odd, m).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 9))
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 400").collect()}
    mixed = spark.createDataFrame([(1, by["en"][:400] + " " + by["de"][:400])], "doc_id long, text string")
    assert [s["lang"] for s in langid.languages(mixed, m, spans=True).first()["spans"]] == ["en", "de"]
    assert langid.languages(docs, langid.Model([], [], [], [])).where("lang_pred <> 'und'").count() == 0


def test_viterbi_equals_search():
    rng = np.random.default_rng(1)
    from itertools import product

    scores = rng.normal(0, 3, (9, 2)).astype(np.float32)
    bounds = np.array([0, 5, 5, 9])
    got = langid.viterbi(scores, bounds, 2.0)
    for a, b in ((0, 5), (5, 9)):
        best = max(product(range(2), repeat=b - a), key=lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:])))
        assert got[a:b].tolist() == list(best)


def test_toxicity(spark, odd):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        t = list(rng.choice(words, rng.integers(20, 80)))
        bad = i % 8 == 0
        if bad:
            t[int(rng.integers(0, len(t)))] = str(rng.choice(["vilex", "vilefoo"]))
        rows.append((i, " ".join(t)))
        if i % 3 == 0:
            labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit(df, lab)
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, m).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 8 == 0) for i in held]) > 0.95
    assert {i for i in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    kept = toxicity.clean(df, m)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["score"] < 0.3} and kept.columns == df.columns
    out = toxicity.toxicity(odd, m).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.clean(odd, m).columns == odd.columns
    m.bias = 9.0  # whatever the model, a text without words has nothing to judge
    assert {r["doc_id"] for r in toxicity.clean(odd, m).collect()} >= {1, 2}
    none = toxicity.fit(df, lab.limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(df.limit(5), none).collect())


def test_pii_gradient():
    net = pii.Network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, pii.CLASSES, (2, 7)), rng.integers(0, pii.TAGS, (2, 7))
    _, g = net.gradient(x, y)
    for k in net.p:
        at = (x[0, 3], 5) if k[0] == "x" else tuple(int(rng.integers(0, n)) for n in net.p[k].shape)
        net.p[k][at] += 1e-3
        up = net.gradient(x, y)[0]
        net.p[k][at] -= 2e-3
        down = net.gradient(x, y)[0]
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3


def test_pii_base_patterns():
    t = "mail a.b@c.de, x@y 1.2.3.4 999.1.1.1 4111 1111 1111 1111 4111111111111112 +49 (30) 123-4567 +1 2"
    assert [(k, t[a:b]) for k, a, b in pii.base_spans(t)] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("phone", "+49 (30) 123-4567")]
    assert [(k, t2[a:b]) for t2 in ["n 4111-1111 11111111."] for k, a, b in pii.base_spans(t2)] == [("card", "4111-1111 11111111")]


def test_pii_finds_disguises_and_keeps_base(spark, docs, odd):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join([*(f"w{x}" for x in rng.integers(0, 99, 8)), f"user{i}@mail{i % 7}.example.com", f"+49 30 {rng.integers(10**6, 10**7)}", "end"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    net = pii.fit(df)
    own = [t for _, t in rows[:60]]
    found = pii.tagged([pii.plain(t) for t in own], net)
    base = [set(pii.base_spans(t)) for t in own]
    assert sum(len(b & set(f)) for b, f in zip(base, found)) >= 0.8 * sum(map(len, base))
    for (b, spans), t in zip(pii.all_spans(own, net), own):
        assert set(b) <= set(spans) and set(b) == set(pii.base_spans(t))
    out = {r["doc_id"]: r for r in pii.personal_data(odd, net).collect()}
    assert out[1]["spans"] == "" and out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = pii.redact(df.withColumnRenamed("doc_id", "id"), net).first()["text"]
    assert "@" not in masked and "<email>" in masked


#: The base patterns as they are stated.
STATED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def stated_spans(text):
    def ok(kind, m):
        digits = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(kind, *m.span()) for kind, p in STATED.items() for m in re.finditer(p, text) if ok(kind, m[0])]


def test_pii_base_spans_equal_stated_patterns():
    import random

    pick, n = random.Random(1), 0
    for letters in ("ab@@..11223 +-_() ", "4111 -", "1+ .9@"):
        for _ in range(8000):
            t = "".join(pick.choice(letters) for _ in range(pick.randrange(60)))
            want = stated_spans(t)
            assert pii.base_spans(t) == want
            n += len(want)
    assert n > 1000


def test_pii_of_documents(spark, docs, texts):
    """Counts and digests over the table; the network adds spans and takes none away."""
    got = pii.personal_data(docs, pii.train([])).collect()
    for r in got:
        want = stated_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"] == joined and r["n_spans"] == len(want)


def test_pii_of_very_long_texts():
    import time

    net, began = pii.train([]), time.time()
    for t in ("a" * 5_000_000 + " @", "+" * 5_000_000 + "1", "a@" * 1_000_000):
        assert pii.base_spans(t) == []
    for t in ("1" * 1_000_000, "1 " * 500_000, "1." * 100_000):
        pii.all_spans([t], net)
    assert time.time() - began < 120


def test_pii_of_disguises_that_training_does_not_make(spark):
    rng = np.random.default_rng(0)
    words = lambda n: " ".join(f"{''.join(rng.choice(list('aeioulmnrst'), 5))}" for _ in range(n))
    rows = [(i, f"{words(8)} {words(1)}{i}@{words(1)}.example.com {words(3)} +49 30 {rng.integers(10**6, 10**7)} {words(3)}") for i in range(500)]
    net = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    hits = []
    for shape in ("{a}{{at}}{b}{{dot}}com", "{a} (AT) {b} (DOT) net", "{a}＠{b}.example.com", "{a}<at>{b}<dot>org", "{a} [ at ] {b} [ dot ] de"):
        for _ in range(20):
            own = shape.format(a=words(1), b=words(1))
            text = f"{words(9)} {own} {words(6)}"
            at = text.index(own)
            hits.append(any(a < at + len(own) and b > at for _, a, b in pii.all_spans([text], net)[0][1]))
    assert np.mean(hits) >= 0.6
    clean = [words(60) for _ in range(40)]
    assert sum(len(s) for _, s in pii.all_spans(clean, net)) == 0


def test_redaction_of_overlaps():
    assert pii.redacted("abcdefgh", [("card", 1, 4), ("ip", 2, 6)]) == "a<card><ip>gh"


@pytest.mark.parametrize("code", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(code):
    rng = np.random.default_rng(code)
    pages = [rng.integers(0, 4, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (130, 70, 3), (65, 192, 1), (3, 5000, 1))]
    for predictor in (1, 2):
        for tile in (0, 16):
            for order in "<>":
                got = list(tiff.read_pages(tiff.write_pages(pages, code, predictor, tile, order)))
                assert [(g["page"], g["width"], g["height"], g["samples"]) for g in got] == [(i, p.shape[1], p.shape[0], p.shape[2]) for i, p in enumerate(pages)]
                assert [g["pixels"] for g in got] == [p.tobytes() for p in pages]


def test_tiff_of_known_bytes():
    # the format's own PackBits example, and LZW of a short run
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")).hex().upper() == "AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10
    for n in (0, 1, 600, 5000, 60000):
        raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        assert tiff.unpack_lzw(tiff.pack_lzw(raw)) == raw and tiff.unpack_bits(tiff.pack_bits(raw)) == raw


def test_lzw_of_known_codes():
    """The format's own example, and widths that change with the codes; bits laid down one by one here."""

    def laid(codes):
        bits, free = "", 257
        for c in codes:
            bits += format(c, f"0{9 + (free >= 512) + (free >= 1024) + (free >= 2048)}b")
            free = 258 if c == 256 else free + 1
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.pack_lzw(raw) == laid([256, 7, 258, 8, 8, 258, 6, 6, 257])
    assert tiff.unpack_lzw(laid([256, 7, 258, 8, 8, 258, 6, 6])) == raw  # no stop code
    single = [i % 256 for i in range(3000)]
    assert tiff.unpack_lzw(laid([256, *single, 256, 65, 258, 258, 257])) == bytes(single) + b"AAAAA"
    for broken in ([65, 66], [256, 258, 257], [256, 65, 300, 257]):
        with pytest.raises(ValueError):
            tiff.unpack_lzw(laid(broken))
    long = b"ab" * 300_000
    assert tiff.unpack_lzw(tiff.pack_lzw(long)) == long and tiff.unpack_bits(tiff.pack_bits(b"x" * 10**6)) == b"x" * 10**6


def test_tiff_of_documents(docs, texts):
    """Every column over the table, computed plainly from the text and from the stored bytes; all codecs occur, also for long texts."""
    media = {r["doc_id"]: bytes(r["media"]) for r in tiff.text_images(docs).collect()}
    codes = {}
    for r in tiff.text_image_digests(docs).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        stored = media[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        pages = list(tiff.read_pages(stored))
        share = [payload.count(c) / len(payload) for c in set(payload)]
        entropy = -sum(p * math.log2(p) for p in share)
        edges = sum(a != b for a, b in zip(payload, payload[1:]))
        assert r["feature"] == f"pages={len(pages)};rows={len(payload) // 192};mean={sum(payload) / len(payload):.4f};levels={len(share)};entropy={entropy:.4f};edges={edges}"
        codes.setdefault(pages[0]["compression"], []).append(len(raw))
    assert set(codes) == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE} and all(max(n) > 4096 for n in codes.values())


def test_tiff_rows(spark, odd):
    good = tiff.write_pages([np.zeros((2, 3), np.uint8)] * 2, tiff.DEFLATE, 1, 0)
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None), (4, bytearray(good[:-30]))], "doc_id long, media binary")
    got = [(r["doc_id"], r["page"], r["error"] is None) for r in tiff.tiff_pages(files).collect()]
    assert (1, 0, True) in got and (1, 1, True) in got and (2, None, False) in got and not any(g[0] == 3 for g in got) and any(g[0] == 4 and not g[2] for g in got)
    out = sorted(((r["doc_id"] or -1, r["n_bytes"], r["payload_sha256"]) for r in tiff.text_image_digests(odd).collect()))
    pad = lambda b: b.ljust(max(1, -(-len(b) // 192)) * 192)
    assert out == sorted((i or -1, len((t or "").encode()), hashlib.sha256(pad((t or "").encode())).hexdigest()) for i, t in ODD)


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "A train leaves the station of Springfield at 60 mph and travels for 3 hours before Maria stops it at 60 mph again near the river bank"), (2, "short"), (3, None)], "item_id long, text string")
    d = spark.createDataFrame([(10, "xx a train leaves the station of Shelbyville at 75 km and travels for 9 minutes before Peter stops it at 75 km again near the river bank yy"), (11, "So: A TRAIN leaves the station of Springfield, at 60 mph and travels for 3 hours before Maria stops it at 60 mph again"), (12, "a train leaves the yard at noon"), (13, None), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contaminated(d, items).collect()}
    assert set(got) == {10, 11}
    assert got[10]["kind"] == "reparameterised" and got[10]["n_changed"] > 0 and got[10]["coverage"] == 1.0
    assert decontam.contaminated(odd, items).count() == 0
    assert decontam.contaminated(d, items.limit(0)).count() == 0


def test_url_filter(spark):
    t = lambda s: f"2024-{s}"
    entries = spark.createDataFrame([("a", "example.org", "add", t("01-10 00:00:00")), ("a", "example.org", "remove", t("03-01 00:00:00")), ("b", "x.example.org", "add", t("02-01 00:00:00")), ("b", "y.net/spam", "add", t("01-01 00:00:00")), ("a", "z.net", "add", t("01-05 00:00:00")), ("a", "z.net", "remove", t("01-05 00:00:00")), (None, "q", "add", None)], "list string, pattern string, action string, ts string").selectExpr("list", "pattern", "action", "cast(ts as timestamp) ts")
    caps = [(1, "http://x.example.org/p", "01-09 23:59:59"), (2, "http://X.Example.org:80/p", "01-10 00:00:00"), (3, "https://u@x.example.org/", "02-15 00:00:00"), (4, "http://x.example.org/", "03-01 00:00:00"), (5, "http://y.net/spam/1?q", "05-01 00:00:00"), (6, "http://y.net/ham", "05-01 00:00:00"), (7, "http://z.net/", "06-01 00:00:00"), (8, None, "06-01 00:00:00"), (9, "junk", "06-01 00:00:00"), (9, "junk", "06-01 00:00:00"), (10, "http://x.example.org/", None)]
    df = spark.createDataFrame([(i, u, t(s) if s else None, "c") for i, u, s in caps], "page_id long, url string, fetch_ts string, pattern string").withColumn("fetch_ts", __import__("pyspark.sql.functions", fromlist=["col"]).col("fetch_ts").cast("timestamp"))
    got = sorted((r["page_id"], r["n_active"], r["lists"], r["pattern"]) for r in urlfilter.filtered(df, entries).collect())
    assert got == [(1, 0, "", None), (2, 1, "a", "example.org"), (3, 2, "a,b", "x.example.org"), (4, 1, "b", "x.example.org"), (5, 1, "b", "y.net/spam"), (6, 0, "", None), (7, 0, "", None), (8, 0, "", None), (9, 0, "", None), (9, 0, "", None), (10, 0, "", None)]
    again = sorted((r["page_id"], r["n_active"], r["lists"], r["pattern"]) for r in urlfilter.filtered(df, entries, part=1).collect())
    assert again == got  # every pattern with two captures in a month in parts
    assert urlfilter.filtered(df, entries.limit(0)).where("blocked").count() == 0
    assert urlfilter.filtered(df.limit(0), entries).count() == 0


def test_odd_rows_of_jaccard(odd):
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect()), key=str)
    assert len(got) == len(ODD)
    by = {g[0]: g for g in got}
    assert by[1][1:] == (0, 1) and by[3][1:] == (0, 3) and by[4][1:] == (1, 4) and by[7][2] == 7


def test_empty_tables(spark, docs, ranks):
    none = docs.limit(0)
    assert jaccard.jaccard_components(none).count() == 0
    assert bpe.encode(none, ranks, pt.PATTERN).count() == 0
    assert tokenfile.round_trip(none, pt.path("byte_bpe_50k.json"), pt.PATTERN).count() == 0
    assert maxent.lm_scores(none).count() == 0
    assert langid.languages(none, langid.fit(none)).count() == 0
    assert pii.personal_data(none, pii.fit(none)).count() == 0
    assert tiff.text_image_digests(none).count() == 0
    assert tiff.tiff_pages(tiff.text_images(none)).count() == 0
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontam.contaminated(none, items).count() == 0
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    m = toxicity.fit(none, labels)
    assert toxicity.toxicity(none, m).count() == 0 and toxicity.clean(none, m).count() == 0
    assert pii.redact(none, pii.train([])).count() == 0


def test_token_starts_equal_pattern():
    import random

    import regex

    from threadlake.llm import pretokens

    assert pretokens.PATTERN == pt.PATTERN
    pick = random.Random(0)
    letters = "ab'stmdrvel  \n\t.,!12é日 　🙂’_\x1c\x85"
    for _ in range(500):
        texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(0, 14))) for _ in range(6)]
        data, offs = kernel.utf8(pa.array(texts))
        s, e, b = pretokens.token_bounds(data, offs)
        assert [[data[x:y].tobytes().decode() for x, y in zip(s[b[i] : b[i + 1]], e[b[i] : b[i + 1]])] for i in range(6)] == [regex.findall(pt.PATTERN, t) for t in texts]


def test_other_patterns_are_applied():
    from threadlake.llm import pretokens

    data, offs = kernel.utf8(pa.array(["ab é", "", "x"]))
    s, e, b = pretokens.token_bounds(data, offs, r"\w+|\s+")
    assert [data[x:y].tobytes().decode() for x, y in zip(s, e)] == ["ab", " ", "é", "x"] and b.tolist() == [0, 3, 3, 4]
    with pytest.raises(ValueError):
        pretokens.token_bounds(*kernel.utf8(pa.array(["a b"])), r"\w+")


def test_numbers_of_words():
    """Numbers follow first sight; the table grows, and strings that share half of their hash bits are told apart."""
    from threadlake.llm.pretokens import Vocabulary

    rng = np.random.default_rng(0)
    v, seen = Vocabulary(4), {}
    for n in (1, 30, 3000, 70):
        words = [str(x).encode() for x in rng.integers(0, 2500, n)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        got, new = v.numbers(data, starts, ends)
        fresh = [w for w in dict.fromkeys(words) if w not in seen]
        for w in fresh:
            seen[w] = len(seen)
        assert new == fresh and got.tolist() == [seen[w] for w in words]
    h = np.full(3, 7, np.uint64)
    data, at = np.frombuffer(b"xyx", np.uint8), np.arange(3)
    for _ in range(2):
        got, new = v.place(h, np.array([1, 2, 1], np.uint64), data, at, at + 1)
        assert got[0] == got[2] != got[1]
    assert new == []


def morse(n, a="a", b="b"):
    s, t = a, b
    for _ in range(n):
        s, t = s + t, t + s
    return s, t


def test_hashes_of_regular_texts():
    """Words whose hashes are alike for every polynomial modulo 2^64."""
    for n in (3, 10, 11):
        x, y = morse(n)
        data, offs = kernel.utf8(pa.array([x, y]))
        h = kernel.word_hashes(data, offs[:-1], offs[1:])
        assert h[0] != h[1]
    x, y = morse(11, "a ", "b ")
    data, offs = kernel.utf8(pa.array([x, y]))
    words = kernel.word_hashes(data, *kernel.split_words(data, offs)[:2])
    h, _ = kernel.shingles(words, np.array([0, len(words) // 2, len(words)]), len(words) // 2)
    assert h[0] != h[1]


def test_regular_texts_in_operators(spark):
    from tokenizers import Tokenizer

    x, y = morse(11)
    df = spark.createDataFrame([(1, x), (2, y), (3, f"{x} {y}"), (4, f"{y} {x}")], "doc_id long, text string").coalesce(1)
    t = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["ids_crc32"] for r in tokenfile.round_trip(df, pt.path("byte_bpe_50k.json"), pt.PATTERN).collect()}
    assert got == {r["doc_id"]: zlib.crc32(np.array([*t.encode(r["text"]).ids, 2], "<u4").tobytes()) for r in df.collect()}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df, 4, 85, 100).collect()} == {i: i for i in range(1, 5)}
    known = {r["doc_id"]: r["n_known"] for r in maxent.lm_scores(df, mod=1000, held=zlib.crc32(b"2") % 1000).collect()}
    assert known == {1: 2, 2: 2, 3: 3, 4: 3}


#: One word in each of many scripts; letters without a script of their own; a mathematical letter; single letters.
LETTERED = ["word", "λόγος", "слово", "բառ", "מילה", "كلمة", "ܡܠܬܐ", "शब्द", "คำ", "ຄໍາ", "ཚིག", "စကား", "სიტყვა", "ቃል", "ពាក្យ", "ことば", "단어", "字", "ᏣᎳᎩ", "ߒߞߏ", "𝔴", "Ễ", "ª", "𐌀", "ꦗꦮ"]


def test_every_letter_has_a_language(spark, docs):
    m = langid.fit(docs)
    rows = [*enumerate(LETTERED), (90, "12 ?! 🙂 … ②"), (91, "̈ ²½"), (92, " "), (93, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    assert all(got[i][0] in m.langs and 0 < got[i][1] <= 1 for i in range(len(LETTERED)))
    assert all(got[i] == ("und", 0.0) for i in (90, 91, 92, 93))
    # a script that nothing was learned of: by the languages' shares
    assert got[LETTERED.index("ᏣᎳᎩ")] == (m.langs[int(m.prior.argmax())], pytest.approx(m.prior.max()))


@pytest.mark.parametrize("code", [tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_of_a_very_long_text(code):
    """A text of 64 MB goes through in under five times its size: the file is held once, pages one after another."""
    import subprocess
    import sys

    run = f"""
import sys, threading, time, zlib
sys.path.insert(0, {str(__import__('pathlib').Path(__file__).resolve().parents[2])!r})
import numpy as np, pyarrow as pa
from threadlake.llm import tiff
def now(): return int(open('/proc/self/statm').read().split()[1]) * 4096 >> 20
x = np.tile(np.frombuffer(b'some words again and again, 0123456789. ', np.uint8), 1 << 20)[: 64 << 20].copy()
x = np.resize(x, 64 << 20)
for k in range(1000):
    x[:2] = 97 + k % 26, 97 + k // 26
    p = np.full(-(-len(x) // 192) * 192, 32, np.uint8); p[: len(x)] = x
    if tiff.CODECS[zlib.crc32(p) % 8] == {code}: break
size, offsets, text = len(x), np.array([0, len(x)], np.int32).tobytes(), x.tobytes()
del x, p
batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)])], ['doc_id', 'text'])
most, before, done = [0], now(), []
def watch():
    while not done:
        most[0] = max(most[0], now()); time.sleep(0.01)
t = threading.Thread(target=watch, daemon=True); t.start()
(out,) = tiff._digests(tiff._pages(tiff._images(iter([batch])), ['doc_id', 'n_bytes'], 'media'))
done.append(1); t.join()
(r,) = out.to_pylist()
import hashlib
assert r['payload_sha256'] == hashlib.sha256(text.ljust(-(-size // 192) * 192)).hexdigest() and r['n_bytes'] == size
print(most[0] - before)
"""
    done = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 5 * 64


def test_languages_beyond_a_byte():
    """300 languages: the labels of the best path, against all paths."""
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(7, 300)).astype(np.float32)
    scores[:, 150:] += 1
    got = langid.viterbi(scores, np.array([0, 3, 3, 7]), 1.5)
    for a, b in ((0, 3), (3, 7)):
        best = scores[a].astype(float)
        back = []
        for t in range(a + 1, b):
            top = int(best.argmax())
            moved = best[top] - 1.5 > best
            back.append(np.where(moved, top, np.arange(300)))
            best = np.where(moved, best[top] - 1.5, best) + scores[t]
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        assert got[a:b].tolist() == path[::-1]


def test_learning_of_many_languages(spark):
    """200 languages of words of their own are told apart, those above 127 too."""
    rows = [(i * 4 + k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i * 7 % 26)}x{w}q" for w in ("ab", "cd", "ef", "gh")), f"l{i:03}") for i in range(200) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.langs) == 200
    got = {r["doc_id"]: r["lang_pred"] for r in langid.languages(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize("values", [[], [0], [1, 255, 256], [2**32 - 1, 7], [2**32, 0], [2**40 + 3, 2**62, 5]])
def test_packed_numbers(values):
    from threadlake.llm import blocks

    got = blocks.unpack(blocks.pack(np.array(values, np.int64)))
    assert got.tolist() == values and got.dtype.itemsize == (8 if max(values, default=0) >= 2**32 else 4)
