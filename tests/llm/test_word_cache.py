"""The caches of the token files: ids of the whole tokenizer at any size, frequent pieces kept over a full cache."""

import numpy as np
import public_tokenizers

from starlit.llm.token_files import TOKENIZER, WordEncoder

TEXTS = ["the The, THE. the's don't ab12 a''s x### <|", "niño 'Él'! straße über, <|endoftext|> the", "中文 the naïvé \x01 re-do it'll",
         "tab\tnew\nline\x0b\x0cÀÉÞß x\x1cy a×b ÷ \x85 \xa0 \u2028 e\u0301 ﬁ İ <|startoftext|>", "1234 'S 'll'Re \\ ` ~^_@[]{}#'", "", " \n ",
         *[f"w{k} other{'abcdefghij'[k % 10]}, the Éa{k}" for k in range(40)]]


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<i4").tolist()


def test_ids_at_any_cache_size():
    for size in (1, 7, 1000):
        enc = WordEncoder(public_tokenizers.path(TOKENIZER), size, size)
        for _ in range(2):
            for t in TEXTS:
                assert ids(enc.encode(t)) == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_frequent_pieces_outlive_a_full_cache():
    enc = WordEncoder(public_tokenizers.path(TOKENIZER), 5, 5)
    made, make = [], enc.pieces.make
    enc.pieces.make = lambda p: (made.append(p), make(p))[1]
    for k in range(60):
        enc.encode(f"the, w{chr(97 + k % 26)}{chr(97 + k // 26)}")
    assert made.count("the") == made.count(",") == 1 and len(enc.pieces) + len(enc.pieces.before) <= 18


def test_plain_texts_are_cut_into_pieces_without_a_word_each():
    enc = WordEncoder(public_tokenizers.path(TOKENIZER))
    enc.encode("The the THE the, the. (the) the!")
    assert not enc.words and set(enc.pieces) == {"the", ",", ".", "(", ")", "!"}
