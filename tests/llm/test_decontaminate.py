import random

from slipweave.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def brute(passage, text):
    """Least edits of the passage against any substring."""
    p, t = D.normalize(passage), D.normalize(text)
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        k = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[k] = rnd.choice("abcxyz")
        elif kind == 1:
            del s[k]
        else:
            s.insert(k, rnd.choice("abcxyz "))
    return "".join(s)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:8]
    filler = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    index = D.Passages(list(enumerate(items)))
    found = total = 0
    for n in range(40):
        i = n % 8
        k = int(index.budget[i])
        before, after = filler[n][:200], filler[-1 - n][:200]
        text = before + edited(rnd, items[i], rnd.choice([0, 1, k // 2, k, k + 1, k + 8, 3 * k])) + after
        got = {g[0]: g for g in index.search(text)}
        for j in {i, (i + 1) % 8}:
            least = brute(items[j], text)
            assert (j in got) == (least <= index.budget[j]), (n, j, least, index.budget[j])
            if j in got:
                assert got[j][1] == least
                assert brute(items[j], text[got[j][2]:got[j][3]]) == least
                found += 1
            total += 1
    assert 0 < found < total


def test_edges_and_case():
    index = D.Passages([(7, "The quick brown Fox jumps over the lazy dog again and again"), (8, "short"), (9, "")])
    assert index.search("the QUICK brown fox\tjumps over the lazy dog again and again") == [(7, 0, 0, 59)]
    assert index.search("quick brown fox jumps over the lazy dog again and again")[0][1] == 4
    assert index.search(None) == index.search("") == index.search("shor") == []
    assert index.search("a Short, short one") == [(8, 0, 2, 7), (8, 0, 9, 14)]  # no budget: exact
    assert D.Passages([]).search("anything at all") == []


def test_table(spark):
    item = "a passage of the benchmark that should never be trained on by anyone"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "other words entirely, none of which is here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 9000 + item, 0), (1, item, 0), (2, None, 0), (3, "", 0), (None, item.upper(), 0), (5, "clean", 0)], "doc_id long, text string, item_id int")
    got = sorted((r.doc_id or 0, r.item_id, r.edits, r.start) for r in D.matches(docs, bench).collect())
    assert got == [(0, 1, 0, 0), (1, 1, 0, 0), (1, 1, 0, 18000)]
    assert sorted((r.doc_id or 0, r.item_id) for r in D.matches(docs, bench, block_chars=60).collect()) == [(0, 1), (1, 1), (1, 1)]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert D.matches(docs.limit(0), bench).collect() == [] and D.matches(docs, bench.limit(0)).collect() == []


def test_short_passages_have_the_whole_budget():
    rnd = random.Random(11)
    for _ in range(300):
        item = "".join(rnd.choices("abcdefgh ", k=rnd.randint(1, 45)))
        index = D.Passages([(1, item)])
        k = len(item) // 10
        text = "".join(rnd.choices("mnopq", k=rnd.randint(0, 30))) + edited(rnd, item, rnd.randint(0, k + 1)) + "".join(rnd.choices("mnopq", k=rnd.randint(0, 30)))
        least = brute(item, text)
        got = index.search(text)
        assert bool(got) == (least <= k), (item, text, least)
        assert not got or got[0][1] == least


def test_every_region_apart():
    item = "a passage that stands here more than once, word for word or nearly so"
    text = f"{item} ... {item.replace('once', 'twice')} ... {item[:20]} ... {item.upper()}"
    got = D.Passages([(3, item)]).search(text)
    assert [h[1] for h in got] == [0, 0, 3] and sorted(h[2] for h in got) == [0, len(item) + 5, text.index(item.upper())]
    assert D.normalize(text)[got[1][2]:got[1][3]] == item


def test_one_character_a_million_times():
    import tracemalloc

    item = "-" * 300 + " the end of a table"
    text = "-" * 1_000_000 + " the end of a table"
    index = D.Passages([(1, item), (2, "another passage, of words")])
    tracemalloc.start()
    got = index.search(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0][1:] == (0, len(text) - len(item), len(text)) and {h[0] for h in got} == {1}
    assert peak < 500_000_000, peak


def test_texts_are_hashed_together(monkeypatch):
    rnd = random.Random(3)
    items = ["".join(rnd.choices("abcdefgh ", k=rnd.choice([7, 30, 120]))) for _ in range(6)]
    texts = []
    for n in range(400):
        before, after = ("".join(rnd.choices("ghijklmn ", k=rnd.choice([0, 20, 300]))) for _ in range(2))
        texts.append(rnd.choice([None, "", before]) if n % 5 == 0 else before + edited(rnd, items[n % 6], rnd.choice([0, 1, 3])) + after)
    # A match over the seam of two texts is none.
    texts += [items[2][:3], items[2][3:]]
    index = D.Passages(list(enumerate(items)))
    alone = [index.search(t) for t in texts]
    calls, hashes = [], D.gram_hashes
    monkeypatch.setattr(D, "gram_hashes", lambda codes, q: calls.append(q) or hashes(codes, q))
    assert list(index.search_all(texts)) == alone and sum(map(bool, alone)) > 100
    assert len(calls) < 40, len(calls)


def test_groups_of_any_size_find_the_same(monkeypatch):
    items = ["ab" * 30, "a passage that repeats nothing at all, or hardly", "bab"]
    texts = ["ab" * 50 + "x" + "ba" * 45, None, "A PASSAGE that repeats nothing at al, or hardly. bab", "", "ba" * 200]
    index = D.Passages(list(enumerate(items)))
    want = list(index.search_all(texts))
    for group, chunk, hits in [(1, 1 << 16, 1 << 20), (150, 16, 1 << 20), (1 << 20, 30, 40), (1 << 20, 1 << 16, 3)]:
        for name, value in [("GROUP", group), ("CHUNK", chunk), ("HITS", hits)]:
            monkeypatch.setattr(D, name, value)
        assert list(index.search_all(texts)) == want, (group, chunk, hits)
    assert [bool(x) for x in want] == [True, False, True, False, True]


def test_characters_as_in_normalize():
    texts = ["ΟΔΟΣ ΣΑΣ", "", "İstanbul Ş", "Σ", "É　\x85😀 Straße", "x" * 70_000 + "Σ"]
    assert D._together(texts).tolist() == [ord(c) for t in texts for c in D.normalize(t)]
