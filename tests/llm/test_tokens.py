"""The tokenizer's two forms give the same ids."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from pageloom.llm import packing

ODD = (
    "a" * 5000, "\x00\x00 a\x00", "a\r\nb\r\n\r\n  c\r", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext|", "  <|endoftext|>  ", "é" * 300, "日本語" * 200, "👩‍👩‍👧‍👦" * 50, "  \x85 a", "﻿BOM", "á" * 40, "1" * 400,
    "١٢٣ ४५६", "   " * 200, "\n" * 300, "\t \t\n \n", "'s't're'VE'LL don't", "_" * 100, "!?" * 200, " 　a", "\U0010ffff", "�", "ſ K İ ß ǅ", "𝟘𝟙", "Ⅷ ½ ²", "\x1c\x1d\x1e\x1f a", "a\x0bb\x0cc", "<s></s>[INST]", "​‍", "",
)


def test_ids_of_odd_texts():
    tokenizer, path = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer_path()
    rng = random.Random(1)
    alphabet = "ab AB\n\r\t'é日1٣!_-<|>  \x00\x85\x1c👍ſ½"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)), *(f" {t} <|endoftext|>{t}" for t in ODD)]
    for text in texts:
        assert packing.token_ids(text, path)[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
