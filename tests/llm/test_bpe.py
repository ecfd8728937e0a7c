import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.llm import bpe
from mosaiq.llm.queries import byte_tokenizer, op1_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.model_proto(bpe.read_ranks(PATH)), public_tokenizers.PATTERN)


def test_every_token_is_a_piece_of_its_rank(codec):
    assert codec.tokens == bpe.read_ranks(PATH)


def test_query_matches_reference(spark, sf_dir, texts, reference):
    for row in op1_byte_bpe(spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    codec = test_any_text.codec
    ids = codec.encode(text)
    assert memoryview(ids).cast("I").tolist() == test_any_text.reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.fixture(autouse=True)
def _share(codec, reference):
    test_any_text.codec, test_any_text.reference = codec, reference


def test_long_texts_go_in_runs(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 1000)
    text = "many words here, " * 3000 + "a" * 20_000
    assert memoryview(codec.encode(text)).cast("I").tolist() == reference.encode_ordinary(text)


def test_odd_rows(spark, odd, empty):
    tokenizer = byte_tokenizer(spark)
    rows = tokenizer.encode(odd, decoded="decoded").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode() and r.kept == "kept"
    again = tokenizer.decode(tokenizer.encode(odd.withColumn("token_ids", odd.text))).collect()
    assert {bytes(r.decoded) for r in again} == {bytes(r.decoded) for r in rows}
    assert tokenizer.encode(empty).count() == 0
