"""Problem 6: ids equal those of two public libraries, and decode to the text."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factspan.llm import encoding as S

RANKS = open(S.default_ranks(), "rb").read()


@pytest.fixture(scope="module")
def encode():
    return S.TextEncoder(S.PairIndex(RANKS))


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(encode, reference, text):
    ids = encode([text])[0]
    assert ids == reference(text)
    by_id = {int(b): base64.b64decode(a) for a, b in (x.split() for x in RANKS.splitlines())}
    assert b"".join(by_id[i] for i in ids) == text.encode()


def test_repeats_and_overlaps(encode, reference):
    r = random.Random(2)
    texts = ["".join(r.choice("ab ") for _ in range(n)) for n in range(120)] + ["a" * 5000, " " * 300, "\n\n\t ", "<|endoftext|> don't"]
    assert encode(texts) == [reference(t) for t in texts]


def test_job(spark, reference):
    rows = [(1, None, 9), (2, "", 9), (3, "  \n", 9), (4, "Ein Käse 🙂 <|endoftext|>", 9), (4, "twin", 9), (5, "word " * 50_000, 9)]
    got = sorted((r.doc_id, tuple(r.ids)) for r in S.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect())
    assert got == sorted((i, tuple(reference(t) if t else ())) for i, t, _ in rows)
    assert S.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
