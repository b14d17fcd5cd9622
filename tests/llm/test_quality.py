import zlib

import numpy as np

from slipweave.llm import quality

SF = "/root/testdata/sf0.01"


def brute(net, data):
    chunks = quality.pick_chunks(data, 1 << 60)
    pooled = np.stack([np.tanh(net.responses(np.frombuffer(c, np.uint8)).max(axis=0) + net.bias) for c in chunks])
    z = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]) @ net.out + net.offset[0]
    return 1 / (1 + np.exp(-z))


def test_score_covers_the_whole_text():
    net = quality.Net()
    rnd = np.random.default_rng(1)
    for n in (0, 1, 64, 255, 256, 257, 448, 449, 5000, 70000):
        data = rnd.integers(0, 256, n, np.uint8).tobytes()
        assert abs(net.score(data) - brute(net, data)) < 1e-5, n


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, net).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93


def test_odd_rows(spark):
    net = quality.Net()
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (2, "", 9.0), (None, "a", 9.0), (4, "b " * 90000, 9.0)], "doc_id long, text string, score double")
    got = quality.score(docs, net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.keep(docs, net, 0.0).count() == 5 and quality.keep(docs, net, 1.1).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1.0}
    assert quality.score(docs.limit(0), net).collect() == []


def test_copies_of_a_labelled_row_are_one_before_the_driver(spark):
    docs = spark.range(400).selectExpr("id % 4 doc_id", "concat('text ', id % 4) text", "id")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    one = quality.fit(docs.where("id < 4"), labels)
    many = quality.fit(docs, labels)
    assert np.array_equal(one.table, many.table) and np.array_equal(one.out, many.out)
