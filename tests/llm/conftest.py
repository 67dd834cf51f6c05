from __future__ import annotations

import public_tokenizers
import pytest

#: Texts with every kind of trouble: nulls, empties, odd spaces, special tokens, repeats, long runs without spaces.
TROUBLE = [
    None,
    "",
    " ",
    "\n",
    "plain words in a row",
    "  two  spaces  and\ttabs \n and lines\n\n",
    "trailing space ",
    " leading space",
    "<|endoftext|> inside <|endoftext|>text<|startoftext|>",
    "a b  c　 d\x85 e\x1c f",
    "nul\0byte and more",
    "Ünïcödé çéñ ßtraße naïve é ñ",
    "漢字かな交じり文 と 日本語",
    "emoji 👩‍👩‍👧 ok 🇩🇪",
    "x" * 5000,
    "don't can't we'll it's I'd they've 's 'tis",
    "1234567890 3.14 1,000,000 !!! ??? ...",
    ("word " * 3000).strip(),
    "plain words in a row",
    "퟿ edge",
    "tail\n",
    "a b c d",
]


@pytest.fixture
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def trouble(spark):
    rows = [(k, t) for k, t in enumerate(TROUBLE)] + [(None, "no id"), (3, "repeated id"), (3, "repeated id")]
    return spark.createDataFrame(rows, "doc_id long, text string")
