"""The n-gram join and the top-k search against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from panelmill.llm import ngram_join, topk
from panelmill.llm.components import components


def brute(rows, n, num, den):
    sets = [(i, set(ngram_join.shingles(t, n).tolist())) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    least = {}
    for k, (i, s) in enumerate(sets):
        r = root(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(s), least.get(root(k))) for k, (i, s) in enumerate(sets))


def near_copies(seed, texts, words):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for t in range(texts):
        base = list(rng.choice(vocab, int(rng.integers(*words))))
        for _ in range(int(rng.integers(1, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocab))
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


@pytest.mark.parametrize("n,num,den,words", [(3, 9, 10, (3, 120)), (5, 4, 5, (6, 200)), (2, 1, 2, (2, 12))])
def test_ngram_components(spark, n, num, den, words):
    rows = near_copies(n, 60, words) + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "long " * 3000)]
    got = ngram_join.ngram_components(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, cid int, h1 string"), n, num, den)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, n, num, den)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words in here now"), (None, "A B C D E F G"), (None, "quite alone it is"), (2, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, 3, 9, 10).collect()) == brute(rows, 3, 9, 10)
    none = df.limit(0)
    assert ngram_join.ngram_components(none).count() == 0 and ngram_join.drop_near_copies(none).count() == 0


def test_one_difference_is_found_by_pigeonhole():
    """Sets within the allowed difference share a key of the smaller set's band, whatever the mix."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(9, 150))
        s = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b, lo, hi = ngram_join.band_of(len(s), 4, 5)
        most = hi // 4
        for m1 in (0, (most + 1) // 2):
            m0 = max(0, most + 1 - 2 * m1)
            cut = int(rng.integers(0, most + 1))
            more = np.unique(np.concatenate([s[int(cut // 2) :], rng.integers(0, 1 << 63, cut - cut // 2, dtype=np.uint64)]))
            x, y = ngram_join.keys_of(s, b, most, m0, m1), ngram_join.keys_of(more, b, most, m0, m1)
            full = lambda z: set(z[0][z[1] == 0].tolist())
            assert (full(x) & set(y[0].tolist())) | (set(x[0].tolist()) & full(y))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def top_brute(rows, every, k):
    vecs = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in {i: q for i, q in vecs if i % every == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vecs if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 2, (5, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(60)]  # one vector many times: ties
    rows += [(400, None), (401, []), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7), (405, [0.0] * 8), (420, [0.0] * 8), (None, [1.0] * 8), (440, [1.0, 2.0]), (441, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, cell int, label int")
    got = {tuple(r) for r in topk.top_k(df).collect()}
    assert got == top_brute(rows, 20, 20)
    assert topk.top_k(df.limit(0)).count() == 0


def test_a_large_group_costs_few_pairs_a_document(spark, monkeypatch):
    """Copies of one text that differ from each other about as much as a link allows."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for k in range(240):
        copy = list(base)
        for at in rng.choice(160, int(rng.integers(1, 4)), replace=False):
            copy[at] = f"x{k}y{at}"
        rows.append((k, " ".join(copy)))
    tried, verify = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, *a: (tried.append(pairs.count()), verify(pairs, *a))[1])
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 4, 5)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, 5, 4, 5)
    assert sum(tried) <= 12 * len(rows)


def test_long_texts_below_the_similarity_are_not_verified(spark, monkeypatch):
    # Six texts of 1,500 words, each with a third of its words its own: similarity about a quarter, hundreds of keys in common.
    rng = np.random.default_rng(5)
    body, rows = [f"w{i}" for i in rng.integers(0, 10_000, 1_500)], []
    for i in range(6):
        words = list(body)
        for at in range(100 * i, 100 * i + 500):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(6, rows[0][1] + " end"), (7, " ".join(f"v{i}" for i in range(1_500))), (8, " ".join(f"v{i}" for i in range(1_499)))]
    verified, counts = [], {}
    real, real_stored = ngram_join._verify, ngram_join.stored

    def stored(df, name):
        out = real_stored(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, *a: verified.append(pairs.count()) or real(pairs, *a))
    monkeypatch.setattr(ngram_join, "stored", stored)
    got = Counter(tuple(r)[:3] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), 5, 4, 5).collect())
    assert got == brute(rows, 5, 4, 5)
    assert sum(verified) == 2
    # Texts 7 and 8 share hundreds of keys, which are one key since the same two meet there.
    assert counts["met"] < 1_500
