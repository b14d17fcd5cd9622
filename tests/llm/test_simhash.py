import random

import xxhash

from slipweave.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    label = {i: i for i in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprint_cases():
    for t in (None, "", " \t\n", "One", "a b c", "A B c D", "É x\x0by z É x\x0by z", "w " * 70000):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps


def test_links_in_hot_keys_are_complete(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {}
    for i in range(400):
        x = base[i % 6]
        for b in rnd.sample(range(64), rnd.randint(0, 5)):
            x ^= 1 << b
        fps[i] = x
    classes = {}
    for i in sorted(fps):
        classes.setdefault(fps[i], i)
    frame = spark.createDataFrame([(i, x - (x >> 63 << 64)) for x, i in classes.items()], "node long, fp long")
    found = {r[0]: r[1] for r in simhash.components(simhash.links(frame, chunk=20)).collect()}
    want = brute_components({i: x for x, i in classes.items()})
    assert {i: found.get(i, i) for i in want} == want
    for blocks in (5, 7, 8):  # any number of pieces finds the same pairs
        found = {r[0]: r[1] for r in simhash.components(simhash.links(frame, blocks=blocks)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_blocks_grow_with_the_table():
    sizes = [simhash.blocks_for(n, 4) for n in (0, 10, 10**5, 10**6, 10**7, 10**9, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == 6 and sizes[-1] > 8
    for n, blocks in ((10**5, sizes[2]), (10**9, sizes[5])):
        assert min(sum(w for _, w in c) for c in simhash.combinations(simhash._cuts(blocks), blocks - 4)) > n.bit_length()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c d e", "y"), (3, "a b c d e", "y"), (None, "q", "z"), (9, "A b C d e", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, None), (1, 1), (2, 1), (3, 3), (3, 3), (9, 3)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
