"""The encoder of token files and packing against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from verifold.llm import token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def by_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda texts: [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_asks_only_for_parts_that_are_new(by_library):
    own = token_files.Encoder(TOKENIZER)
    own.encode(pa.array(["Alpha beta gamma, delta", "Beta x\nAlpha y\nBeta"]))
    asked = []
    whole = own._whole
    own._whole = lambda texts: asked.extend(t for t in texts if t) or whole(texts)
    texts = ["Alpha gamma beta.\nAlpha delta", "Beta beta,\nBeta gamma!", "Alpha x.\nBeta y."]
    ids, sizes = own.encode(pa.array(texts))
    assert set(asked) <= {".", "!"}
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == by_library(texts)


def test_encoder_equals_the_library_on_mixed_texts(monkeypatch, by_library):
    monkeypatch.setattr(token_files, "PIECES", 60)
    monkeypatch.setattr(token_files, "PIECE_CHARS", 8)
    own, rng = token_files.Encoder(TOKENIZER), random.Random(7)
    parts = ["a", "The", "b1", "é", "'s", "'", "\n", "\n\n", " ", " ", " ", "  ", "\t", "\r\n", "\x85", "\xa0", "\u2003", "\x1c", "\u200b", ".", ",", "!?", "...", "<|endoftext|>", "<|", "日本", "🙂", "١", "½", "e\u0301", "Ġ", "Ċ", "long" * 5, "\x00"]
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 0]
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(40)]
        ids, sizes = own.encode(pa.array(texts, rng.choice([pa.string(), pa.large_string()])))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == by_library(texts)
        assert len(own.known) <= 60 and own.flat.size == own.sizes.sum() and len(own.sizes) == len(own.known) == len(own.used)


def test_encoder_cuts_where_the_tokenizer_cuts():
    split = token_files.Encoder(TOKENIZER).tok.pre_tokenizer.pre_tokenize_str
    every = pa.array([chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000])
    for c in every.filter(pc.utf8_is_alnum(every)).to_pylist():
        assert [at for _, at in split(c + ".")] == [(0, 1), (1, 2)]
    for c in every.filter(pc.invert(pc.utf8_is_space(every))).to_pylist():
        assert split("a " + c + ".")[1][1][1] > 2
