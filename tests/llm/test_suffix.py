import hashlib
import random

import numpy as np

from slipweave.llm import suffix

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """rows (doc_id, text) in order of doc_id, each id once."""
    seen, out = set(), {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
    return out


def got(frame, **kw):
    return {r.doc_id: tuple(r[1:5]) for r in suffix.deduplicate(frame, **kw).collect()}


def test_anchor_choice():
    rnd = random.Random(2)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(500)), np.uint8)
    h = suffix.window_hashes(data, 24)
    _, pos, first, last, _ = suffix.anchors(data, 100, 24)
    for p, a, b in zip(pos, first, last):
        assert all(s + int(np.argmin(h[s:s + 77])) == p for s in range(a, b + 1))
    assert first[0] == 0 and last[-1] == 400 and (first[1:] == last[:-1] + 1).all()


def test_anchors_of_texts_back_to_back():
    rnd = random.Random(7)
    raws = [bytes(rnd.choice(b"abc") for _ in range(rnd.choice([0, 5, 99, 100, 101, 250, 700]))) for _ in range(60)]
    ends = np.cumsum([len(r) for r in raws])
    _, pos, a, b, text = suffix.anchors(np.frombuffer(b"".join(raws), np.uint8), 100, 24, ends)
    got = [(t, p - s, x - s, y - s) for t, p, x, y in zip(text.tolist(), pos.tolist(), a.tolist(), b.tolist()) for s in [int(ends[t]) - len(raws[t])]]
    want = []
    for t, r in enumerate(raws):
        _, p, x, y, _ = suffix.anchors(np.frombuffer(r, np.uint8), 100, 24)
        want += [(t, *v) for v in zip(p.tolist(), x.tolist(), y.tolist())]
    assert got == want


def test_bounded_prefixes():
    rnd = random.Random(1)
    for _ in range(40):
        n = rnd.randrange(2, 200)
        x = np.array([rnd.choice([1, 2, 3][:rnd.randrange(1, 4)]) for _ in range(n)] + [0])
        x[20::50] = 0
        limit = rnd.randrange(1, 40)
        order, _ = suffix.suffix_array(x, limit)
        prefix = suffix.bounded_prefixes(x, order, limit)
        for i in range(1, len(x)):
            u, v, k = x[order[i - 1]:], x[order[i]:], 0
            while k < limit and u[k] == v[k]:
                if u[k] == 0:
                    k = limit
                    break
                k += 1
            assert prefix[i] == k


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == brute(sorted((r.doc_id, r.text) for r in docs.collect()))


def planted(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 9))) for _ in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 80))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = rnd.choices(base, k=rnd.randint(0, 3)) + [" ".join(rnd.choices(words, k=20))]
        t = " ".join(parts)
        if rnd.random() < 0.4 and t:
            k = rnd.randrange(len(t))
            t = t[:k] + "X" + t[k + 1:]
        rows.append((i * 2, t))
    return rows + [(999, "z" * 700), (1001, "z" * 350 + "y"), (1003, "ab" * 200)]


def test_planted_and_hot(spark):
    rows = planted(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(frame) == want
    for chunk in (1, 2, 7):
        assert got(frame, chunk=chunk) == want
    assert got(frame, gram=60) == want


def test_groups_over_batches(spark):
    """Anchors whose rows end in any place of a batch, and go on over several."""
    rows = planted(5, 30)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, key = brute(rows), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for size, chunk in ((1, 500), (3, 500), (3, 4), (7, 2), (50, 9)):
        spark.conf.set(key, str(size))
        try:
            assert got(frame, chunk=chunk) == want
        finally:
            spark.conf.set(key, before)


def test_one_key_for_different_bytes():
    """Only equal bytes make a stretch late."""
    data = np.frombuffer(b"abcdabcdabce", np.uint8)
    at, key, uid = np.array([0, 4, 8, 0, 4]), np.array([7, 7, 7, 9, 9], np.uint64), np.array([1, 1, 1, 2, 3])
    late = suffix._late(data, key, uid, at, at, np.array([4, 4, 4, 4, 3]))
    assert late.tolist() == [False, True, False, False, False]


def test_clean_keeps_columns_of_any_name(spark):
    t = " ".join(f"word{i}" for i in range(60))
    rows = [(1, t, 5, "x", 1), (2, t + "!", 6, "y", 2)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, _hash long, _text string, n_chars int")
    left = suffix.clean(frame)
    assert left.schema == frame.schema
    assert sorted(tuple(r) for r in left.collect()) == [(1, t, 5, "x", 1), (2, "!", 6, "y", 1)]
    other = frame.select("doc_id", "text", *[frame["n_chars"].alias(c) for c in ("_doc", "_h", "row", "doc", "hash", "cut", "uid", "windows", "a")])
    assert suffix.clean(other).columns == other.columns


def test_odd_rows(spark):
    t = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, t, "a"), (3, t, "a"), (5, "short", "b"), (None, t, "c"), (7, t + "!", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, windows string")
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed) for r in suffix.deduplicate(frame).collect())
    n = len(t)
    assert found == [((False, 1), 0, 0), ((False, 2), 0, 0), ((False, 3), n, 0), ((False, 3), n, 0), ((False, 5), 5, 0), ((False, 7), n + 1, n), ((True, 0), n, n)]
    assert suffix.deduplicate(frame.limit(0)).collect() == []
    left = suffix.clean(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.where("doc_id is null or doc_id > 4").collect()) == [(0, ""), (5, "short"), (7, "!")]
