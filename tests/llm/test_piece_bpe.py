"""SentencePiece pieces against the library, batch by batch."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward_texts, by_id, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from merchantry.llm import piece_bpe
from merchantry.llm.spans import distinct_spans, span_hashes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)
CODEC = piece_bpe.PieceCodec(MODEL)
MORE = [
    "a▁b ▁ ", "<s> </s><unk>\x00<0x0A>", "²².. e².", "z" * 3000 + " " + "0" * 500, " " * 100 + "a", "　x y", "中文字符测试" * 300, "\n\n a\n", "▁", "é" * 200,
]


def test_columns(spark):
    texts = [*awkward_texts(), *MORE]
    found = by_id(piece_bpe.encode(documents(spark, texts).repartition(3), MODEL, packed="packed", decoded="decoded"))
    for i, text in enumerate(texts):
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        assert found[i]["token_ids"] == ids, repr(text)[:50]
        assert np.frombuffer(found[i]["packed"], "<u4").tolist() == ids
        assert found[i]["decoded"] == LIBRARY.decode(ids)
        assert found[i]["lang"] == "en"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab e.,'▁\n1²é中😀the"), max_size=60), min_size=1, max_size=5))
def test_rows_are_the_librarys(texts):
    CODEC.confirm(texts, *CODEC.encode_rows(texts))


def test_short_and_long_stretches_agree():
    for text in ["thethethe", " international", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789"]:
        row = np.array([[CODEC._of_char[ord(char)] for char in text]], np.int32)
        assert [i for i in CODEC.agendas(row)[0].tolist() if i != -2] == CODEC.agenda(text)


def test_difference_stops():
    with pytest.raises(ValueError):
        CODEC._confirm_spans(["the", "a"], np.array([1, 1]), np.array([5, 6], np.int32))


def test_decode_and_empty_table(spark):
    df = spark.createDataFrame([(1, LIBRARY.encode("a b")), (2, None)], "doc_id long, token_ids array<int>")
    assert {row.doc_id: row.decoded for row in piece_bpe.decode(df, MODEL).collect()} == {1: "a b", 2: ""}
    assert piece_bpe.encode(documents(spark, []), MODEL).count() == 0


def test_query_digests(spark, tmp_path):
    from merchantry.llm.queries import op12_piece_bpe

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for row in op12_piece_bpe(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode(awkward_texts()[row.doc_id] or "", add_bos=True, add_eos=True)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_built_words_have_different_hashes():
    for n in (16, 512, 1024, 4096):
        a = _thue_morse(n).encode()
        data = np.frombuffer(a + a.translate(bytes.maketrans(b"ab", b"ba")) + a, np.uint8)
        starts, ends = np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])
        for seed in (0, 7):
            h = span_hashes(data, starts, ends, seed)
            assert h[0] == h[2] != h[1]
        assert distinct_spans(data, starts, ends)[1].tolist() in ([0, 1, 0], [1, 0, 1])
