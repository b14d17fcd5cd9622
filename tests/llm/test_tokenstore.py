import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from slipweave.llm import idmemo, tokenstore

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "x \n y", "a b \x1c c", "<|endoftext|> it's", "l'été 😀 日本", "\n\n  z", "tab\t tab ", "12 345", "don't  stop", " lead", "e　 f", "a \x00b \x00b", "\x00b", "\na\n\nb \n", "x\r\ny z\nw v\n", "a\u180e b\n\u180ec d", "\x85a \xa0b", "-- 's\n's"]


def want(rows):
    lib = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(frame):
    return sorted(tuple(r) for r in tokenstore.store_and_read(frame, PATH).collect())


def test_encoder_equals_the_library():
    lib = Tokenizer.from_file(PATH)
    enc = tokenstore.Encoder(PATH)
    for t, ids in zip(ODD, enc.encode(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def _least(f):
    """(result, least CPU seconds of three runs)"""
    took = []
    for _ in range(3):
        begun = time.process_time()
        out = f()
        took.append(time.process_time() - begun)
    return out, min(took)


def test_new_groups_cost_less_than_splitting_by_the_library():
    rnd = np.random.default_rng(5)
    parts = ["the", "ing", "é", "日", "\n", "\n\n", "\r\n", "q", "zx", "7", "'s", "-", "\u2003", "\x00", "😀", "ation", "w"]
    keys = list({(" " * int(rnd.integers(0, 2)) + "".join(rnd.choice(parts, rnd.integers(1, 6)))).encode() for _ in range(40_000)})
    enc = tokenstore.Encoder(PATH)
    (sizes, flat), mine = _least(lambda: enc._solve(keys))
    assert np.split(flat, np.cumsum(sizes)[:-1])[-1].tolist() == [t.id for t in enc.lib.model.tokenize(tokenstore._shown(keys[-1]))]
    assert flat.tolist() == [t.id for k in keys for t in enc.lib.model.tokenize(tokenstore._shown(k))]
    assert sizes.tolist() == [len(enc.lib.model.tokenize(tokenstore._shown(k))) for k in keys]

    plain = [k for k in keys if b"\n" not in k]
    library = Tokenizer(enc.lib.model)
    library.pre_tokenizer = pre_tokenizers.Split("\u010a", "isolated")
    texts = [b"\n".join(plain[k:k + 2048]).decode("latin-1").translate(tokenstore._BYTES) for k in range(0, len(plain), 2048)]
    _, splitting = _least(lambda: [library.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts])
    assert mine / len(keys) < 0.8 * splitting / len(plain)


def _ids_of(memo, words, solve):
    starts = np.cumsum([0, *map(len, words)])[:-1]
    ids, n = memo.ids(np.frombuffer(b"".join(words), np.uint8), starts, solve)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def _letters(keys):
    return np.array([len(k) for k in keys], np.int32), np.frombuffer(b"".join(keys), np.uint8).astype(np.uint32)


def test_a_lookup_costs_no_look_through_the_memo():
    memo = tokenstore.Encoder(PATH).memo
    words = [b"w%d" % i for i in range(300_000)]
    _ids_of(memo, words, _letters)
    few = words[::1500]
    ids, mine = _least(lambda: _ids_of(memo, few, None))  # all known: nothing to solve
    assert ids == [list(w) for w in few]
    _, through = _least(lambda: pc.index_in(pa.array(few), value_set=memo.known))
    assert mine < through / 2


@pytest.mark.parametrize("hashes", [None, lambda words: np.full(len(words), 7), lambda words: np.array([w[0] - 52 for w in words.to_pylist()], np.int64)])
def test_the_memo_is_right_when_full_and_when_hashes_clash(hashes, monkeypatch):
    if hashes:
        monkeypatch.setattr(idmemo, "_hashes", hashes)
    rnd, memo = np.random.default_rng(8), idmemo.HashedMemo(300)
    for size in [0, 1, 40, 200, 900, 5, 100, 700, *rnd.integers(1, 250, 40).tolist()]:
        words = [b"%d" % x for x in rnd.zipf(1.3, size) % 5000]
        assert not words or _ids_of(memo, words, _letters) == [list(w) for w in words]
        assert len(memo.known) == len(memo.sizes) == len(memo.hashes) <= max(300, len(set(words)))
    many = [b"%d" % x for x in range(9000)]  # the table grows
    memo.most = 20_000
    assert _ids_of(memo, many, _letters) == _ids_of(memo, many, _letters if hashes else None) == [list(w) for w in many]


def test_marks_are_those_of_the_polynomial():
    ids = np.random.default_rng(4).integers(0, 50000, 20000).astype("<u4")
    mixed = [((i + 1) * 0x9E3779B97F4A7C15) % 2**64 for i in ids.tolist()]
    mixed, want = [x ^ x >> 29 for x in mixed], []
    for at in range(len(ids) - tokenstore.WINDOW + 1):
        h = 0
        for x in mixed[at:at + tokenstore.WINDOW]:
            h = (h * 0xD1342543DE82EF95 + x) % 2**64
        if (h ^ h >> 32) % tokenstore.MEAN == 0:
            want.append(at + tokenstore.WINDOW)
    assert len(want) > 20 and tokenstore.marks(ids).tolist() == want


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == want([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(i * 3, t) for i, t in enumerate([*ODD, None, "word " * 40000, "word " * 40000])]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, root int")
    assert got(frame) == want(rows)
    assert got(frame.limit(0)) == []
    twice = frame.where("doc_id = 6").unionAll(frame.where("doc_id = 6"))
    assert [r[1:3] for r in got(twice)] == [(0, r := want(rows)[2][2]), (r, r)]


def test_ids_come_back_whole(spark, tmp_path):
    lib, texts = Tokenizer.from_file(PATH), [*ODD, None, "word " * 40000, "word " * 40000, "a passage of some words, " * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = f"file://{tmp_path}/ids"
    tokenstore.write(frame, folder, PATH)
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in tokenstore.read_ids(spark, folder).collect()}
    assert got == {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}


def test_long_texts_in_pieces_and_a_full_memo(monkeypatch):
    lib, enc = Tokenizer.from_file(PATH), tokenstore.Encoder(PATH)
    monkeypatch.setattr(tokenstore, "PIECE", 50)
    monkeypatch.setattr(tokenstore, "MEMO", 40)
    rnd = np.random.default_rng(3)
    for _ in range(60):
        texts = ["".join(rnd.choice(["'s", " ", "  ", "\n", "ab", "é", "'ll", "12", "!", " q", "日", "\u2003", "😀", "\x07"], rnd.integers(0, 120))) for _ in range(6)]
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_and_checksums():
    rnd = np.random.default_rng(2)
    ids = rnd.integers(0, 50000, 30000).astype("<u4")
    ends = tokenstore.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= tokenstore.LEAST and sizes.max() <= tokenstore.MOST
    at = [e for e in range(100, 5000) if tokenstore.cuts(ids[:e])[-1:] == [e]]
    assert len(at) == 4900 and all(np.diff([0, *tokenstore.cuts(ids[:e])]).min() > 0 for e in range(1, 5000))
    parts = [(zlib.crc32(ids[a:b].tobytes()), 4 * (b - a)) for a, b in zip([0, *ends], ends)]
    assert tokenstore.joined_crc(parts) == zlib.crc32(ids.tobytes())
    shifted = tokenstore.cuts(np.concatenate([ids[500:600], ids]))
    assert len({e - 100 for e in shifted} & set(ends)) > len(ends) // 2


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here " * 500)], "doc_id long, text string")
    folder = f"file://{tmp_path}/s"
    tokenstore.write(docs, folder, PATH)
    from pyarrow import fs

    pack = next(p for p in (tmp_path / "s/packs").iterdir() if not p.name.startswith("."))
    local = fs.LocalFileSystem()
    data = local.open_input_stream(str(pack), compression="zstd").read()
    with local.open_output_stream(str(pack), compression="zstd") as out:
        out.write(data[:-5] + b"\x07" + data[-4:])
    with pytest.raises(Exception, match="differs"):
        tokenstore.read_documents(spark, folder).collect()
