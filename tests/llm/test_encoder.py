"""The encoder of op5 equals the tokenizer on odd white space, and keeps the words of more than one shard."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from contestlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", " ", "　", "é", "漢字", "12", ".", "!?", "x" * 70, " y" * 3, "<|endoftext|>",
         "\x1c", "́", "\U0001f642", "'", "\r\n", "\x00", "​", "﻿", "᠎", " word"]


def test_ids_equal_the_tokenizers():
    draw = random.Random(4)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(40))) for _ in range(3_000)] + ["", " ", "\n", "a"]
    encoder = packing.Encoder(PATH)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encoder.encode([]) == []


def test_words_of_several_shards_are_remembered(monkeypatch):
    """Before, a worker forgot its words after 120,000, which is less than one shard may have."""
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:18]]
    shards = [[" ".join(words[k::3])] for k in range(3)]
    encoder = packing.Encoder(PATH)
    first = [encoder.encode(s)[0] for s in shards]
    asked = []
    inner = packing.Encoder._learn
    monkeypatch.setattr(packing.Encoder, "_learn", lambda self, *new: asked.append(1) or inner(self, *new))
    assert all(np.array_equal(a, encoder.encode(s)[0]) for a, s in zip(first, shards))
    assert len(words) > 120_000 and not asked
