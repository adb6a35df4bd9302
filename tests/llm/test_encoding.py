"""Token ids against the reference tokenizer library, and exact round trips."""

from __future__ import annotations

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.encoding import RANKS, Encoder, encode_documents, token_counts

tokenizers = pytest.importorskip("tokenizers")
JSON = RANKS.replace(".tiktoken", ".json")


@pytest.fixture(scope="module")
def pair():
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return Encoder(), t


PARTS = st.lists(st.sampled_from([*"a'stmdrevl \n\t.1é中　\xa0x\"", "'re", "'ll", " '", "<|endoftext|>", "​", "😀", "\x1c", "\x85", "don't", "  "]) | st.characters(blacklist_categories=["Cs"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=4))
def test_ids_equal_the_library(texts):
    t = tokenizers.Tokenizer.from_file(JSON) if not hasattr(test_ids_equal_the_library, "t") else test_ids_equal_the_library.t
    t.encode_special_tokens = True
    test_ids_equal_the_library.t = t
    enc = getattr(test_ids_equal_the_library, "e", None) or Encoder()
    test_ids_equal_the_library.e = enc
    assert [ids for ids, _ in enc.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces_and_offsets(pair):
    enc, t = pair
    for text in ("a" * 30_000, " " * 5_000 + "x", "ab" * 9_000, "中" * 4_000):
        (ids, starts), = enc.encode([text], offsets=True)
        assert ids == t.encode(text, add_special_tokens=False).ids and len(starts) == len(ids)
        back = {r: b for b, r in enc.ranks.items()}
        assert b"".join(back[i] for i in ids).decode() == text  # an exact round trip
    (ids, starts), = enc.encode(["one  two"], offsets=True)
    assert starts == [0, 3, 4]


def test_documents(spark, pair):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Hello world", "c"), (3, "Hello world", "c")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_documents(df).collect())
    hello = pair[1].encode("Hello world", add_special_tokens=False).ids
    assert got == [(1, []), (2, []), (3, hello), (3, hello)]
    assert sorted(r.n_tokens for r in token_counts(df, ["doc_id"]).collect()) == [0, 0, 2, 2]
    assert encode_documents(df.limit(0)).count() == 0


def test_rank_file_is_a_parameter(tmp_path):
    file = tmp_path / "own.tiktoken"
    file.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert next(Encoder(str(file)).encode(["ab"]))[0] == [97, 98]


@settings(max_examples=200, deadline=None)
@given(PARTS)
def test_offsets_lead_back_to_the_text(text):
    enc = getattr(test_ids_equal_the_library, "e", None) or Encoder()
    test_ids_equal_the_library.e = enc
    (ids, starts), = enc.encode([text], offsets=True)
    assert enc.decode(ids) == text and len(starts) == len(ids)
    for k, at in enumerate(starts):
        first = enc.bytes_of[ids[k]]
        if first[0] & 0xC0 != 0x80:  # starts with a code point: what comes before decodes to the text up to there
            assert enc.decode(ids[:k]) == text[:at]


def test_documents_with_offsets(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "día 中文 x")], "doc_id long, text string")
    for r in encode_documents(df, offsets=True).collect():
        assert len(r.ids) == len(r.starts) and (r.doc_id == 3 or r.ids == [])
