"""Encoding against the reference library, exact round trips and the perfect hash."""

import base64
import random
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(None, P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, texts):
    return [list(codec.ids_of(x)) for x in codec.encode_batch(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
def test_equals_the_reference_and_round_trips(codec, reference, texts):
    found = ids(codec, texts)
    assert found == [reference.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in found] == [t.encode() for t in texts]


def test_characters_on_which_engines_differ(codec, reference):
    texts = ["x² ½a Ⅷ 9²", "a\x1cb \x1f\x1d c", "²", "plain", "it's²", "　x\x85y\xa0 z"] * 2
    assert ids(codec, texts) == [reference.encode_ordinary(t) for t in texts]


def test_code_points_that_engines_class_otherwise(codec, reference):
    assert len(codec.stand_ins) > 1000 and 0x1C89 in codec.stand_ins
    points = sorted({*codec.stand_ins, *range(0x20, 0x3000, 7), *random.Random(1).sample([x for x in range(0x110000) if not 0xD800 <= x < 0xE000], 4000)})
    for form in ("{0}'s", "{0}'ll a{0}'re", "a{0}1 {0}x", "1{0} {0}{0}\n{0}!", " {0}' {0}"):
        texts = [form.format(chr(x)) for x in points]
        assert ids(codec, texts) == reference.encode_ordinary_batch(texts)


def test_memory_of_words_is_bounded_by_their_length(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_LENGTH", 3000)
    codec.ready().memo = bpe.Memo()
    for k in range(40):
        texts = [f"{'x' * 200}{k} {'字' * 150}{k} shared"]
        assert ids(codec, texts) == [reference.encode_ordinary(t) for t in texts]
        assert max(sum(map(len, m)) for m in (codec.memo.young, codec.memo.old)) <= 3000


def test_long_pieces_and_white_space(codec, reference):
    r = random.Random(5)
    texts = ["a" * 3000, "ab" * 2000, " " * 500 + "x", "\n\n \t", "<|endoftext|>", "".join(r.choice("tionhe ") for _ in range(20_000))]
    assert ids(codec, texts) == [reference.encode_ordinary(t) for t in texts]


def test_memo_generations_change_nothing(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 20)
    texts = [f"word{i} other{i % 7} thing" for i in range(200)]
    for k in range(0, 200, 10):
        assert ids(codec, texts[k : k + 10]) == [reference.encode_ordinary(t) for t in texts[k : k + 10]]


def test_perfect_hash_is_minimal(codec):
    keys = [codec.vocab[i] for i in codec.ids]
    assert sorted(codec.hash.key_at.tolist()) == list(range(len(keys)))
    assert codec.hash.find(keys).tolist() == list(range(len(keys)))


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    out = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, outputs=("ids", "ids_sha256", "decoded_sha256"))
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    empty = sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert got[1].ids_sha256 == got[2].decoded_sha256 == empty
    assert got[3].ids_sha256 == sha256(" ".join(map(str, got[3].ids)).encode()).hexdigest()
    assert got[3].decoded_sha256 == sha256(b"the cat").hexdigest()
    assert bpe.encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
