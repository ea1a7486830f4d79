"""Pieces, spans and decoded texts against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD, table
from wikimill.llm import piece_spans, token_counts
from wikimill.llm.queries import QUERIES

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return token_counts.Pieces(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library_spans(model, text):
    return [(p.begin, p.end) for p in model.encode(text, return_type="proto").pieces]


def odd_texts():
    rng = random.Random(3)
    texts = ["", " ", "   ", "\n", "\t\n ", " a", "a ", "a  b", "▁", "▁a▁ b", "a▁b", "<s>", "</s> <unk> <0x41>", "é", "漢字 かな", "😀", "\x00\x01", "é", " x　y", "\r\n", "ﬁ Ⅳ ①", "word " * 5000, "x" * 20000]
    alphabet = " \n\t▁abcé漢😀\x00.<>s/0"
    return texts + ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(400)]


def test_ids_spans_and_texts_equal_the_library(model, pieces):
    encoder, words = piece_spans.Encoder(pieces), piece_spans.vocabulary(PATH)
    for text in odd_texts():
        ids, borders = piece_spans.encode_text(text, encoder, words)
        assert ids.tolist() == model.encode(text), text
        assert list(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)) == library_spans(model, text), text
        assert piece_spans.decoded(ids, words) == model.decode(ids.tolist()), text


def test_any_ids_decode_as_the_library_does(model):
    rng, words = random.Random(4), piece_spans.vocabulary(PATH)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 29871]) for _ in range(rng.randrange(1, 12))]
        assert piece_spans.decoded(np.array(ids), words) == model.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
def test_character_maps_of_the_library(rule):
    """Longest prefixes and offsets of compiled maps; white space as the library's own normalizer treats it."""
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(own.serialized_model_proto())
    spec = proto.normalizer_spec
    shape = piece_spans.Shape(piece_spans.CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
    rng = random.Random(5)
    alphabet = "aÀÅAé̀ﬁⅣ①ｱﾞ가가 　 \t漢㌀ſß"
    for text in ["ﬁ Ⅳ ①", " a  b ", "   "] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 25))) for _ in range(300)]:
        normal, align = shape.normalize(text.encode())
        want, offsets = own.normalize(text, with_offsets=True)
        marked = want if not spec.escape_whitespaces else want.replace(" ", "▁")
        assert normal.decode().replace("▁", " ") == marked.replace("▁", " "), (rule, text)
        assert len(align) == len(normal) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        starts = [i for i in range(len(normal)) if normal[i] & 0xC0 != 0x80]
        assert align[starts].tolist() == [int(at[o]) for o in offsets[:len(starts)]], (rule, text)


def test_query_equals_the_library(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = []
    for d in docs:
        ids = model.encode(d.text or "")
        want.append((d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    rows = QUERIES["op12_piece_spans"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)


def test_odd_rows(spark, model, pieces, monkeypatch):
    monkeypatch.setattr(piece_spans, "MEMO", 50)
    out = piece_spans.encode_documents(table(spark, ODD), pieces, decode=True)
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in out.collect())
    assert got == sorted((str(i), model.encode(t or ""), model.decode(model.encode(t or "")) if t else "") for i, t in ODD)
    assert piece_spans.encode_documents(table(spark, ODD).where("false"), pieces).count() == 0
    back = piece_spans.decode_documents(out.select("doc_id", "ids"), pieces)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == [(i, t) for i, _, t in got]
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert sorted(map(tuple, piece_spans.decode_documents(nulls, pieces).collect())) == [(1, None), (2, "")]


def test_a_long_text_is_cut_at_pre_tokens(model, pieces, monkeypatch):
    monkeypatch.setattr(piece_spans, "SLICE", 5)
    encoder, words = piece_spans.Encoder(pieces), piece_spans.vocabulary(PATH)
    for text in odd_texts():
        if len(text) < 1000:
            assert piece_spans.encode_text(text, encoder, words)[0].tolist() == model.encode(text), text
