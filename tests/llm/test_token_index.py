import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward_texts, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from merchantry.llm import token_index
from merchantry.llm.wavelet import WaveletMatrix

PATH = public_tokenizers.path("word_bpe_49k.json")
TRUTH = Tokenizer.from_file(PATH)


def wanted(text):
    return TRUTH.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\x01\x1c\x85　aIHTWsÅÉßİΣς.,!?-#½²Ⅷ0é中😀̱́̀‍", max_size=40))
def test_chunks_encode_as_whole_texts(text):
    ids = token_index.encode_rows(token_index._chunk_table(PATH), [text])[1]
    assert ids.tolist() == wanted(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "A", "b.", "\n", "\x01"]), max_size=8))
def test_special_strings_are_the_librarys(parts):
    text = "".join(parts)
    texts = [text, "Plain Text", text + "x"]
    lengths, ids = token_index.encode_rows(token_index._chunk_table(PATH), texts)
    rows = [wanted(one) for one in texts]
    assert lengths.tolist() == [len(row) for row in rows] and ids.tolist() == sum(rows, [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" aez0ßàéöüÿ÷ÉµŸ̈'$*%-_`~{}()|<>/st", max_size=40))
def test_signs_and_small_letters_encode_as_whole_texts(text):
    ids = token_index.encode_rows(token_index._chunk_table(PATH), [text])[1]
    assert ids.tolist() == wanted(text)


def test_words_before_signs_are_chunks_and_accented_words_plain():
    """Words that signs follow are met once, and small letters beyond a-z don't take the whole tokenizer."""
    data, starts, ends, _ = token_index.chunk_spans(["mañana$$$ (mañana) x_1 <|endoftext|>"])
    chunks = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert chunks == ["mañana", "$$$", "(mañana", ")", "x", "_1", "<|endoftext|>"]
    spans = ["mañana".encode(), b"plain", "straße".encode(), "a÷b".encode(), "É".encode(), b"x1", "é̈".encode()]
    assert token_index._is_plain(spans, True).tolist() == [True, True, True, False, False, False, False]
    assert token_index._is_plain(spans, False).tolist() == [False, True] + [False] * 5
    plain = token_index._PlainWords(TRUTH)
    assert plain.usable and plain.wide
    assert plain.encode(spans[:3])[1].tolist() == wanted("mañana plain straße")


def test_wavelet_matrix_of_many_runs():
    """Values are parted run by run, of 16 bits and of more."""
    values = np.random.default_rng(3).integers(0, 1 << 16, 200_000)
    for bits, own in ((16, values), (20, values * 16)):
        matrix = WaveletMatrix.build(own, bits)
        assert (matrix.values() == own).all() and matrix.values().dtype == np.uint32
        assert [matrix.access(at) for at in (0, 65_535, 65_536, 199_999)] == own[[0, 65_535, 65_536, 199_999]].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.data())
def test_wavelet_matrix(values, data):
    matrix = WaveletMatrix.build(np.array(values, np.int64), 6)
    assert matrix.values().tolist() == values
    value = data.draw(st.integers(0, 63))
    start, end = sorted((data.draw(st.integers(0, len(values))), data.draw(st.integers(0, len(values)))))
    assert matrix.count(value, start, end) == values[start:end].count(value)
    assert matrix.occurrences(value) == [i for i, v in enumerate(values) if v == value]
    for at in range(0, len(values), 97):
        assert matrix.access(at) == values[at]
    with pytest.raises(IndexError):
        matrix.access(len(values))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index")) + "/tokens"
    docs = documents(spark).selectExpr("*", "7 AS shard", "'x' AS planes").repartition(3)
    token_index.write_index(docs, folder, PATH, end_id=2, shard_tokens=3_000)
    return token_index.read_index(spark, folder)


def test_documents_come_back(index):
    texts = awkward_texts()
    starts = {row["shard"]: row["shard_start"] for row in token_index.shard_starts(index).collect()}
    assert len(starts) > 3  # small shards, and one for the long text
    rows = {row["doc_id"]: row for row in token_index.read_documents(index).collect()}
    before = 0
    for i, text in enumerate(texts):
        ids = wanted(text) + [2]
        assert list(rows[i]["token_ids"]) == ids
        assert starts[rows[i]["shard"]] + rows[i]["start"] == before
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        before += len(ids)


def test_occurrences_and_counts(index):
    texts = awkward_texts()
    token = wanted("alpha")[0]
    places = sorted((i, at) for i, text in enumerate(texts) for at, got in enumerate(wanted(text)) if got == token)
    found = sorted((row["doc_id"], row["position"]) for row in token_index.occurrences(index, token).collect())
    assert found == places and places
    counts = {row["token_id"]: row["n"] for row in token_index.token_counts(index, [token, 2, 49_000]).collect()}
    assert counts[token] == len(places) and counts[2] >= len(texts)


def test_repeated_null_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, "b"), (3, "b"), (3, "a"), (3, "a")], "doc_id long, text string")
    token_index.write_index(rows, f"{tmp_path}/some", PATH, end_id=2)
    found = token_index.read_documents(token_index.read_index(spark, f"{tmp_path}/some")).collect()
    assert sorted((row["start"], row["doc_id"], row["token_ids"][0]) for row in found) == sorted(
        [(0, None, wanted("b")[0]), (2, 3, wanted("a")[0]), (4, 3, wanted("a")[0]), (6, 3, wanted("b")[0])])
    token_index.write_index(rows.limit(0), f"{tmp_path}/none", PATH, end_id=2)
    index = token_index.read_index(spark, f"{tmp_path}/none")
    assert index.count() == 0 and token_index.shard_starts(index).count() == 0
