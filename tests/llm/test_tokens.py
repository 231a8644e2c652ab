import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.tokens import TOKENIZERS, VOCABULARY, Encoder, read_ranks, token_counts, token_ids

PATH = f"{TOKENIZERS}/{VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return Encoder(read_ranks(f.read()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "a", "<|endoftext|> x", "naïve café — 日本語 한국어 🚀👩‍💻", "x" * 3000, " " * 999 + "\n\n\t", "abab" * 700, "don't we'll I'VE 's", "\u202e\ufeff\u0000\x07", "١٢٣ ½ ²", "\r\n\r\n a\u00a0b\u2003c"]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(encoder, library, text):
    assert encoder.encode(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, library, text):
    assert encoder.encode(text) == library(text)


@pytest.mark.parametrize("sign", ["\U000323b0", "\u088f", "\U00012550", "\u1c89", "\u0378", "\U0001fae8"])
def test_letters_of_later_unicode(encoder, library, sign):
    for text in (f"{sign}'s", f"a{sign}1", f" {sign}{sign} {sign}b", f"7{sign}!", f"{sign}\n"):
        assert encoder.encode(text) == library(text)


def test_repetitive_texts(encoder, library):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "aa", "b", "=-", "  ", "0", "é"]) for _ in range(rng.randrange(200)))
        assert encoder.encode(text) == library(text)


def test_round_trip(encoder):
    for text in TEXTS:
        assert b"".join(encoder.bytes_of[i] for i in encoder.encode(text)).decode() == text


def test_column(spark, encoder):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None), (4, "long " * 40_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, out string")
    got = sorted((r["doc_id"], r["ids"]) for r in token_ids(df, ["doc_id"]).collect())
    assert got == sorted((i, encoder.encode(t)) for i, t, _ in rows)
    n = sorted((r["doc_id"], r["out"], r["n_tokens"]) for r in token_counts(df.where("out is not null"), ["doc_id", "out"]).collect())
    assert n == sorted((i, o, len(encoder.encode(t))) for i, t, o in rows if o)
    assert token_ids(df.limit(0), ["doc_id"]).count() == 0
