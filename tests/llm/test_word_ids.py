"""Ids by words against the library."""

import random

import public_tokenizers

from llm.test_pieces import texts
from vecspark.llm.pieces import tokenizer
from vecspark.llm.word_ids import PATTERN, WordIds, cut

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_texts_equal_library():
    made = texts(1200, 4) + ["", "z" * 5000, "漢字" * 300, "a\x1cb\x85\xa0  　x", "don't we're 'S's  \n\n x", "<|endoftext|> <|endoftext|", "½ ² 1²3 ª"]
    known = WordIds(PATH, keep_words=500)
    for at in range(0, len(made), 100):
        part = made[at:at + 100]
        ids, counts = known.encode(part)
        place = 0
        for text, n in zip(part, counts.tolist()):
            assert ids[place:place + n].tolist() == tokenizer(PATH).encode(text, add_special_tokens=False).ids, text
            place += n
        assert place == len(ids)
    assert [len(x) for x in known.packed(["", "a", ""])] == [0, 4, 0] and known.packed([]) == []


def test_both_cuts_agree():
    import regex
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choice("aZé'sretvmlld 1 \n\t.,-_ÿ×÷ ") for _ in range(draw.randint(0, 40)))
        assert cut(text) == regex.findall(PATTERN, text)
    assert PATTERN == public_tokenizers.PATTERN
