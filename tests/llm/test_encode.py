"""Byte-level BPE against tiktoken, and the exact round trip."""

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.load_ranks(PATH)
ENCODER = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
OTHER = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("etaoin dé'ß1 \n\t　"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(texts):
    assert ENCODER.encode(texts).to_pylist() == [OTHER.encode_ordinary(t) for t in texts]


def test_long_pieces_take_the_same_merges():
    texts = ["ab" * 2000, "the" * 700 + "é" * 500, "a" * 513, "x" * 512, "日本" * 400]
    assert ENCODER.encode(texts).to_pylist() == [OTHER.encode_ordinary(t) for t in texts]


def test_memory_is_given_up_and_ids_stay(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY_PIECES", 1)
    for text in ("one two three", "four five", "one two three"):
        assert ENCODER.encode([text]).to_pylist() == [OTHER.encode_ordinary(text)]


def test_odd_rows_round_trip(odd_docs, no_docs):
    def run(df):
        return byte_bpe.decode(byte_bpe.encode(df, "text", PATH, public_tokenizers.PATTERN), "ids", PATH)

    rows = run(odd_docs).select("text", "ids", "decoded", "fp").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode() and r.ids == OTHER.encode_ordinary(r.text or "") and r.fp == "7"
    assert run(no_docs).collect() == []
