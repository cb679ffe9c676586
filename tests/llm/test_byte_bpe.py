import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from fixtures import awkward_texts, by_id, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from merchantry.llm import byte_bpe
from merchantry.llm.queries import with_token_ids
from merchantry.llm.spans import SpanTable

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TRUTH = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(text):
    return byte_bpe._encoder(PATH, public_tokenizers.PATTERN).encode_rows([text])[1].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encoded(text) == TRUTH.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\x1c\x85\xa0 　abcdest'rvml.,!?½²Ⅷ01éß中😀́‍", max_size=40))
def test_spaces_stops_and_marks(text):
    assert encoded(text) == TRUTH.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, " " * 30_000 + "x", "é" * 10_000, "=-" * 10_000])
def test_long_pieces(text):
    assert encoded(text) == TRUTH.encode_ordinary(text)


def test_merges_of_a_made_up_vocabulary():
    rnd = random.Random(3)
    ranks = {bytes([i]): i for i in range(256)}
    pool = [b"a", b"b", b"c"]
    for rank in range(256, 320):
        token = rnd.choice(pool) + rnd.choice(pool)
        if token not in ranks:
            ranks[token] = rank
            pool.append(token)
    codec = byte_bpe.BytePairCodec(ranks)
    pieces = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    lengths, ids = codec.encode_pieces(pieces)
    at = 0
    for piece, n in zip(pieces, lengths.tolist()):
        wanted = [ranks[piece]] if piece in ranks else codec.merged(piece)
        assert ids[at:at + n].tolist() == wanted
        at += n


def test_table_that_starts_anew():
    encoder = byte_bpe.TextEncoder(byte_bpe._codec(PATH), public_tokenizers.PATTERN)
    encoder._table = SpanTable(encoder._encode_new, max_bytes=1000)
    for text in [t or "" for t in awkward_texts()][:14] * 2:
        assert encoder.encode_rows([text])[1].tolist() == TRUTH.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab1.,'é\u3000\u2003\x85\xa0\x1c“中", max_size=25), min_size=1, max_size=6))
def test_texts_of_a_group_stay_apart(texts):
    lengths, ids = byte_bpe._encoder(PATH, public_tokenizers.PATTERN).encode_rows(texts)
    wanted = [TRUTH.encode_ordinary(text) for text in texts]
    assert lengths.tolist() == [len(row) for row in wanted] and ids.tolist() == sum(wanted, [])


def test_white_space_at_the_end_of_a_text_is_one_match():
    texts = ["\n\n", "1", "a \n\n", "b", "a\n ", "", "b \t", ".", " \n", "é", "\n\n a", " \n"]
    lengths, ids = byte_bpe._encoder(PATH, public_tokenizers.PATTERN).encode_rows(texts)
    wanted = [TRUTH.encode_ordinary(text) for text in texts]
    assert lengths.tolist() == [len(row) for row in wanted] and ids.tolist() == sum(wanted, [])


def test_table_and_round_trip(spark):
    texts = awkward_texts()
    df = byte_bpe.digests(with_token_ids(documents(spark), "decoded"))
    found = by_id(df)
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = TRUTH.encode_ordinary(text or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_decode_alone_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [36, 559]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    found = by_id(byte_bpe.decode(rows, PATH))
    assert [bytes(found[i]["decoded"]) for i in (1, 2, 3)] == [TRUTH.decode_bytes([36, 559]), b"", b""]
    with pytest.raises(ValueError):
        byte_bpe._codec(PATH).decode_rows([0, 1], byte_bpe.np.array([60_000]))


def test_clashing_columns_and_empty_table(spark):
    df = documents(spark, ["x y", "x y"]).selectExpr("*", "'old' AS token_ids", "1 AS decoded")
    out = with_token_ids(df, "decoded")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "decoded"]
    assert all(row["token_ids"] == TRUTH.encode_ordinary("x y") for row in out.collect())
    assert with_token_ids(documents(spark, [])).count() == 0
