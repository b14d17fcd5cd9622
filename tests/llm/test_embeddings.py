import numpy as np

from slipweave.llm import embeddings

SF = "/root/testdata/sf0.001"


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1:]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: (links[i], root(i), root(i) == i) for i, _ in rows}


def test_table_matches_brute_force(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    assert got == want


def near(rnd, base, cosine):
    z = rnd.normal(size=base.shape)
    z -= z @ base * base
    z /= np.linalg.norm(z)
    return cosine * base + np.sqrt(1 - cosine**2) * z


def test_recall_at_the_threshold(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(300):
        b = rnd.normal(size=64)
        b /= np.linalg.norm(b)
        rows += [(2 * i, b.tolist()), (2 * i + 1, near(rnd, b, rnd.uniform(0.9, 0.93)).tolist())]
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    total = sum(w[0] for w in want.values())
    assert total and sum(got.values()) >= 0.97 * total
    assert all(got[i] <= want[i][0] for i in got)


def test_hot_groups_in_chunks(spark):
    rnd = np.random.default_rng(8)
    b = rnd.normal(size=32)
    b /= np.linalg.norm(b)
    rows = [(i, (near(rnd, b, 0.98) * rnd.uniform(0.1, 9)).tolist()) for i in range(120)] + [(1000 + i, b.tolist()) for i in range(40)]
    want = brute(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame, chunk=16).collect()}
    assert got == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.1]), (9, [1.0, 0.0]), (10, [1.0]), (11, [1e300, 1e-300]), (12, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    assert got == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 12)} | {7: (3, 7, True), 8: (3, 7, False), 9: (3, 7, False), 11: (3, 7, False)}
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []
    null = spark.createDataFrame([(None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in embeddings.near_duplicates(null).collect()] == [(None, 0, None, False)]
