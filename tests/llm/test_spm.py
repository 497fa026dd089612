"""Encoding and decoding against the sentencepiece library."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelight.llm.spm import SPACE, model_bytes, piece_table, sentencepiece_round_trip

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", "ing", " ", "  ", "    ", "\n", "\t", SPACE, "é", "日本", "語", "​", "🙂", "\x00", "A", "(", "12", "____", "....", "\r\n", "**", "ß", "<s>", "er", "s"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.text(max_size=30)))
def test_ids_and_texts_are_those_of_the_library(library, text):
    text = text.encode("utf-8", "replace").decode()
    pieces = piece_table(model_bytes(MODEL))
    ids = library.encode(text)
    assert pieces.encode(text) == ",".join(map(str, ids))
    assert pieces.decode(",".join(map(str, ids))) == library.decode(ids)


def test_broken_bytes_decode_as_in_the_library(library):
    pieces = piece_table(model_bytes(MODEL))
    for ids in ([229, 148], [3 + 0xE2, 3 + 0x82, 287, 3 + 0xFF], [1, 287, 2], [28705, 3 + 0xC3, 3 + 0xA9]):
        assert pieces.decode(",".join(map(str, ids))) == library.decode(ids)


def test_rows(spark, library):
    texts = ["Hello  world\n", None, "", "x" * 50000, " " * 3000, "é日"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "a b", "k"), (0, texts[0], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sentencepiece_round_trip(df, MODEL, outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"), keep=()).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_round_trip(df.limit(0), MODEL).count() == 0
