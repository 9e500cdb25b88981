"""Texts that quote the vocabulary's added tokens have the tokenizer's ids."""

from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from aeroframe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_are_those_of_the_vocabulary():
    with open(PATH) as f:
        assert packing.ADDED == {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def test_ids_of_texts_with_added_tokens():
    rng = random.Random(9)
    parts = ["<|endoftext|>", "<|endoftext|", "<|", "|>", "endoftext", "<", " ", "  ", "\n", "a", "B", "'s", ".", "é", "12", "😀"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y ", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice(parts) for _ in range(12)) for _ in range(800)]
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids.of(t), "<u4").tolist() for t in texts] == want
    assert want[0] == [64, 220, 50256, 275]
