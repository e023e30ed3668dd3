"""Viterbi against a plain dynamic programme and the library's lattice; exact round trips."""

import numpy as np
import pytest

from stemweave.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    return S.codec(S.default_model())


def plain_best(c, s):
    pieces = {p: sc for p, sc in zip(c.pieces, c.scores) if p in c.automaton}
    longest = max(map(len, pieces))
    best = [0.0] + [float("-inf")] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - longest), j):
            if s[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[s[i:j]])
        if s[j - 1] not in pieces:
            best[j] = max(best[j], best[j - 1] + c.unknown_score)
    return best[-1]


TEXTS = ["hello world", " two  spaces ", "\n\ttabs\n", "漢字 かな 😀 é", "a", "the the", "▁mark", "x" * 300, "Thlyouble | inesea!! 123"]


def test_scores_are_optimal(codec):
    value = dict(zip(range(len(codec.scores)), codec.scores))
    for text in TEXTS:
        s = "▁" + text.replace(" ", "▁")
        ids = codec.best(s)
        total, n_bytes = 0.0, 0
        for i in ids:
            if i in codec.byte_id.values():
                n_bytes += 1
            else:
                total += value[i]
        unknown = sum(ch not in codec.automaton for ch in s)
        assert n_bytes == len("".join(ch for ch in s if ch not in codec.automaton).encode())
        assert total + unknown * codec.unknown_score == pytest.approx(plain_best(codec, s), rel=1e-12)
        assert list(codec.encode(text)) == ids


def test_library_lattice_agrees(codec):
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(S.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:  # scores that 32-bit sums hold exactly
        p.score = -40.0 if p.score < -1e6 else p.score / 1024
    raw = m.SerializeToString()
    lib, own = sp.SentencePieceProcessor(model_proto=raw), S.PieceCodec(raw)
    score = lambda ids: sum(own.scores[i] for i in ids)
    for text in ("hello world", "onheed, with the rest", "Ërnt öó ciónes", "one two three four five"):
        assert score(own.encode(text)) == pytest.approx(score(lib.nbest_encode(text, nbest_size=2)[0]), abs=1e-4)


def test_round_trip_and_edges(spark):
    texts = [*TEXTS, "", None, "a" * 50_000, "word " * 30_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in S.pieces_of(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].round_trip == ("▁" not in (t or "")), t
        assert got[i].n_pieces == len(got[i].ids)
    assert got[len(TEXTS)].ids == [] and got[len(TEXTS) + 1].ids == []
    assert S.pieces_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(1, "hello  wörld"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in S.decode(S.encode(df, S.default_model()), S.default_model()).collect()}
    assert out[1].decoded == "hello  wörld" and out[2].decoded == "" and out[2].ids == []


def test_decode_bytes(codec):
    ids = codec.encode("é漢")
    assert codec.decode_many(ids, np.array([len(ids)])) == ["é漢".encode()]
