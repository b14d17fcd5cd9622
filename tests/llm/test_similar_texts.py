"""Texts by SimHash blocks and shingle similarity against a Jaccard brute force over all pairs."""

import corpus_pipeline as P
import numpy as np
import random

from slipweave.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_set(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([b" ".join(words)] if words else [])


def brute_components(texts, least=(4, 5)):
    label = {i: i for i in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    sets, ids = {i: brute_set(t) for i, t in texts.items()}, sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if a == b or least[1] * len(a & b) >= least[0] * len(a | b) and a and b:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_stage_keeps_one_of_each_group_at_four_fifths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components({r.doc_id: r.text for r in docs.collect()})
    got = P.simhash_near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, g in want.items() if i == g)


def edited(rnd):
    """Bases and copies with words changed, around the similarity; a line that many hold."""
    line, texts = [f"common{k}" for k in range(12)], {}
    bases = [[f"w{b}x{rnd.randrange(400)}" for _ in range(rnd.randint(20, 160))] for b in range(12)]
    for i in range(240):
        words = list(bases[i % 12])
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"new{i}"
        if rnd.random() < 0.6:
            words += line
        texts[i] = " ".join(words)
    return texts


def test_random_edits_and_hot_shingles(spark):
    """Nothing below the similarity is linked; nearly all that reaches it is, in chunks too."""
    texts = edited(random.Random(3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: brute_set(t) for i, t in texts.items()}
    for chunk in (1000, 20):
        got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, chunk=chunk).collect()}
        want = brute_components(texts)
        assert all(want[i] == want[c] for i, c in got.items())
        links = [(i, j) for i in texts for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        assert len(links) > 300 and sum(got[i] == got[j] for i, j in links) >= 0.97 * len(links)


def test_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_components(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    gone = [i for i, c in want.items() if i != c]
    assert sum(got[i] != i for i in gone) >= 0.97 * len(gone)


def test_spanning_forest():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        n, m = int(rnd.integers(1, 30)), int(rnd.integers(0, 80))
        a, b, w = rnd.integers(0, n, m), rnd.integers(0, n, m), rnd.integers(0, 9, m)
        got = simhash.spanning(n, a, b, w)
        label, total, count = list(range(n)), 0, 0
        for k in np.argsort(w, kind="stable"):
            x, y = label[a[k]], label[b[k]]
            if x != y:
                label = [x if v == y else v for v in label]
                total, count = total + w[k], count + 1
        assert len(got) == count and w[got].sum() == total
        assert np.array_equal(simhash.forest(n, a[got], b[got]), simhash.forest(n, a, b))


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, " \t", 7), (3, "a b", 7), (4, "A  b", 7), (4, "A  b", 7), (None, "q", 7), (9, "other words", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.similar_texts(docs).collect())
    assert got == [(-1, None), (1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (9, 9)]
    assert simhash.similar_texts(docs.limit(0)).collect() == []
    assert np.array_equal(simhash.shingles("w " * 70000), simhash.shingles("w w w w w"))


def test_no_link_is_lost(spark):
    """Every pair at the similarity is joined, whatever the blocks miss."""
    for seed in (3, 5):
        texts = edited(random.Random(seed))
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        want = brute_components(texts)
        for chunk, distance in ((1000, 56), (20, 0)):
            assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs, chunk=chunk, distance=distance).collect()} == want


def test_parities_never_exceed_the_difference():
    rnd = np.random.default_rng(6)
    for n in (0, 1, 31, 33, 100, 3000):
        x = np.unique(rnd.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.r_[x[n // 9:], rnd.integers(0, 1 << 63, n // 7, np.uint64)])
        held = simhash._Parities([simhash.parity(x).tobytes(), simhash.parity(y).tobytes()])
        far = held.apart(np.array([0, 1, 0]), np.array([1, 0, 0]))
        assert far[0] == far[1] <= len(np.setxor1d(x, y)) and far[2] == 0
