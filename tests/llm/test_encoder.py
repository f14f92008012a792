"""The encoder's word memory: equal hashes, forgetting, and borders before punctuation."""

import random

import numpy as np
import pyarrow as pa
import pytest

from reportlens.llm import tokens

VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = list("aZé×÷ßñÀ ,.!?#$%&*:;'<|>\n\t0१中-_") + ["'s", "<|endoftext|>", "!!", "...", " the", "été"]


def _texts(n: int) -> list:
    draw = random.Random(7)
    return [None, ""] + ["".join(draw.choices(PARTS, k=draw.randint(0, 30))) for _ in range(n)]


def _check(encoder: tokens.Encoder, texts: list) -> None:
    ids, borders = encoder.encode(pa.array(texts, pa.string()))
    whole = encoder.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])] == [e.ids for e in whole]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_ids_are_those_of_the_whole_tokenizer(name):
    encoder = tokens.Encoder(tokens.tokenizer_path(name))
    for _ in range(2):                      # learnt, then remembered
        _check(encoder, _texts(3000))


@pytest.mark.parametrize("name", VOCABULARIES)
def test_equal_hashes_and_a_full_memory_change_nothing(name, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 50)
    _check(tokens.Encoder(tokens.tokenizer_path(name)), _texts(300))
    monkeypatch.setattr(tokens, "hash_runs", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    _check(tokens.Encoder(tokens.tokenizer_path(name)), _texts(300))
