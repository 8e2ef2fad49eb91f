"""Words that look like the tokenizer's added tokens, in any case."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leafvoice.llm import tokens


def test_added_tokens_in_capitals():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, encode = Tokenizer.from_file(path), tokens.WordEncoder(path).encode
    for x in ("a <|ENDOFTEXT|> b", "a <|endoftext|> b", "<|StartOfText|>", "Ab.<|ENDOFTEXT|>C", "ABC Def. GHI,, (X) don't", "ÜB ABC <|EndOfText|> É."):
        assert np.frombuffer(encode(x), np.uint32).tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_capitals_of_latin_1():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, pieces = Tokenizer.from_file(path), tokens.WordEncoder(path)
    letters = [chr(i) for i in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 9)))) + rng.choice(["", ".", "...", "###", "'s", "«", "é.x", "¿", "é", "ſ", "İ", "Σ"]) for _ in range(3000)]
    texts += ["Ciónta. Éeux, ÀÉ×Ö÷ ß ẞ Ÿ ÿ Œ œ Großé! ÉÉ's"]
    for text in texts:
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
