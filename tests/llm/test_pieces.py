import random

import public_tokenizers
import pytest
import sentencepiece

from slipweave.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", "  a  b ", "\n\n x", "日本語 é😀", "x" * 2000, "\t\x00 tab", "aaaa " * 30, " " * 50, "l'été, n'est-ce pas? *** a_b!!", "def f(x):\n    return x\n"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(PATH)


def texts(codec, n=200):
    rnd = random.Random(4)
    vocabulary = [p.replace(pieces.MARK, " ") for p in codec.ids]
    return ODD + ["".join(rnd.choice("abcdeth is.on\n é，0*") for _ in range(60)) for _ in range(n)] + ["".join(rnd.choices(vocabulary, k=25)) for _ in range(n)]


def test_merge_model_equals_the_library(codec):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in texts(codec):
        ids = codec.encode(t).tolist()
        assert ids == lib.encode(t), t
        assert codec.decode(codec.encode(t)) == lib.decode(ids) == t


def test_unigram_model_scores_as_the_library(codec):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    rnd = random.Random(9)
    for p in model.pieces:
        p.score = -rnd.uniform(4, 16) if p.type == pb.ModelProto.SentencePiece.NORMAL else 0.0
    own = pieces.Codec.__new__(pieces.Codec)
    own._load(model.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    plain = [t for t in texts(codec, 100) if t]
    score = lambda ids: sum(own.score[i] for i in ids)
    for t in plain:
        ids = own.encode(t).tolist()
        assert own.decode(own.encode(t)) == t
        assert score(ids) == pytest.approx(score(lib.encode(t)), abs=1e-3), t


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_models_that_normalize(codec, rule, squeeze):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.normalizer_spec.add_dummy_prefix = True
    own = pieces.Codec.__new__(pieces.Codec)
    own._load(model.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rnd = random.Random(3)
    odd = "ＡＢ①㌕ﬁ\u3000\t\u200b\u00a0 é e\u0301 ｶﾞ ½ \u2028  İ ß 각 ㈱"
    for t in [*ODD, odd, *["".join(rnd.choice(odd + "ab  ") for _ in range(30)) for _ in range(300)]]:
        assert own.encode(t).tolist() == lib.encode(t), repr(t)


def test_a_model_without_byte_pieces(codec):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    kept = [p for p in model.pieces if p.type != pb.ModelProto.SentencePiece.BYTE]
    del model.pieces[:]
    model.pieces.extend(kept)
    model.trainer_spec.byte_fallback = False
    own = pieces.Codec.__new__(pieces.Codec)
    own._load(model.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for t in [*texts(codec, 60), "\x07\x07\x07 a \x07b\x07\x06", "\x05", "ⴰⴱⴲ x ⴳ"]:
        assert own.encode(t).tolist() == lib.encode(t), repr(t)


def test_long_texts_in_parts_and_a_full_memo(codec, monkeypatch):
    monkeypatch.setattr(pieces, "PART", 40)
    own = pieces.Codec(PATH)
    own.memo.most = 30
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    many = texts(codec, 60)
    assert [x.tolist() for x in own.encode_all([*many, None, ""])] == [*lib.encode(many), [], []]


def test_table(spark, codec):
    rows = [(1, None, 7), (2, "", 7), (3, "The thing is.", 7), (3, "The thing is.", 7), (None, "a b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_pieces, r.decoded_equal) for r in pieces.round_trip(docs, PATH).collect()}
    n = len(codec.encode("The thing is."))
    assert got == {(1, 0, True), (2, 0, True), (3, n, True), (None, len(codec.encode("a b")), True)}
    back = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == [(0, "a b"), (1, ""), (2, ""), (3, "The thing is."), (3, "The thing is.")]
    assert pieces.round_trip(docs.limit(0), PATH).collect() == []


def test_long_text(codec):
    t = "reading the long text, " * 20000
    assert codec.decode(codec.encode(t)) == t
