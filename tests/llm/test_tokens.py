"""The encoder that remembers words gives the tokenizer's own ids."""

from __future__ import annotations

import random
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from scriptorium.llm.tokens import Encoder

HOSTILE = [
    None,
    "",
    " \n ",
    "It's, 'S FOO, 'stuff, don't! DON'T.",
    "<|endoftext|>, <|ENDOFTEXT|>, a<|startoftext|>b. <|endoftext|>",
    "İSTANBUL, Σας ΣΑΣ, H̱ello! ẖ, x̸! été, ÉTÉ.",
    "ÀÉÎ%&& ß ÿ Ÿ, µm ª º 1º, ÷ × naïve) ÆON",
    "a,,b ,a, ...a... 12,5 12a, a1, a b, a\u0085b. a­b, ﻿x, 日本語, ﬁn, ǅ.",
    "Word word, WORD WORD!! word",
]


def test_ids_equal_the_tokenizers():
    """Special tokens, combining marks, case pairs and marks; the memory is turned over many times."""
    plain, codec = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Encoder(most_bytes=4000)
    draw, signs = random.Random(3), "aAbéÉßÿµªİΣς'’.,;:!?)%&<|>-_ \n\t\r ̸̱́12"
    texts = HOSTILE + ["".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(3000)]
    assert codec.parts
    for k in range(0, len(texts), 50):
        want = [array("I", plain.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts[k : k + 50]]
        assert codec.encode_all(texts[k : k + 50]) == want
