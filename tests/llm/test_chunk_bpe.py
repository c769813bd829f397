"""Chunked encoding against the library on whole texts."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers

from llm.test_pieces import texts
from vecspark.llm.chunk_bpe import Joiner, cut_batch, decode, encode_documents, shared_chunks
from vecspark.llm.pieces import tokenizer
from vecspark.llm.word_ids import word_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_joins_repair_any_cut():
    draw, known = random.Random(5), word_ids(PATH)
    for text in [t for t in texts(1500, 9) if "<|endoftext|>" not in t] + ["we're" * 9, "a'" + "s" * 5 + "'ll", "x  \n\n  y" * 7, "'" * 30]:
        cuts = sorted(draw.sample(range(len(text) + 1), min(len(text), draw.randint(0, 6))))
        joiner = Joiner(PATH)
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            joiner.add(known.packed([text[a:b]])[0])
        got = joiner.finish()
        assert np.frombuffer(got, "<u4").tolist() == tokenizer(PATH).encode(text, add_special_tokens=False).ids, (text, cuts)
        assert decode(got, PATH).decode() == text


def test_long_words_are_joined_in_linear_time():
    """A megabyte without white space: joining it takes no longer than a few times as long as a quarter of it."""
    known, times = word_ids(PATH), []
    for size in (90_000, 360_000):
        text = "".join(chr(0x4e00 + i * i % 900) for i in range(size))
        chunks = known.packed([text[i:i + 170] for i in range(0, size, 170)])
        start, joiner = time.perf_counter(), Joiner(PATH)
        for ids in chunks:
            joiner.add(ids)
        got = joiner.finish()
        times.append(time.perf_counter() - start)
    assert np.frombuffer(got, "<u4").tolist() == tokenizer(PATH).encode(text, add_special_tokens=False).ids
    assert times[1] < 10 * times[0] + 1


def test_decode_equals_library():
    draw = random.Random(2)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(draw.randint(0, 9))]
        assert decode(np.array(ids, "<u4").tobytes(), PATH).decode() == tokenizer(PATH).decode(ids, skip_special_tokens=False)


def test_chunks_follow_content():
    draw = random.Random(3)
    body = "".join(draw.choice("abcdefgh é\n") for _ in range(6000)).encode()
    a, b = cut_batch([b"x" * 100 + body, "längere andere Einleitung ".encode() * 9 + body], (b"<|endoftext|>",))
    assert b"".join(a) == b"x" * 100 + body and len(set(a) & set(b)) >= len(a) - 3


def test_documents(spark):
    draw = random.Random(4)
    passages = ["".join(draw.choice(["the ", "Wort, ", "été ", "x", "\n", "漢", "a\tb ", "<|endoftext|>"]) for _ in range(900)) for _ in range(4)]
    rows = [(i, "".join(draw.choice([*passages, f"between {i} ", "tail"]) for _ in range(draw.randint(1, 5)))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, passages[0]), (3, rows[3][1]), (72, "z" * 50_000)]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, data binary").repartition(5)
    assert shared_chunks(df, PATH).count() > 4
    got = sorted(map(tuple, encode_documents(df, PATH).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = tokenizer(PATH).encode(t or "", add_special_tokens=False).ids
        back = tokenizer(PATH).decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encode_documents(df.limit(0), PATH).count() == 0
