"""Pieces, counts and ids against the library itself, on hostile texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from vecspark.llm.pieces import id_pieces, tokenizer
from vecspark.llm.token_count import count_tokens, whole_tokens
from vecspark.llm.token_files import digests, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "word", "Word's", " ", "  ", "   ", "\n", "\n\n", "\t", " \n", "\r\n", "\x1c", "\x85", " ", " ", "é", "ß",
         "漢字", "🤦🏼‍♂️", "<|endoftext|>", "<|endof", "123", "...", "!?", "'ll", "_", "\x00", "https://x.y/z?q=1", "́",
         "ab " * 30, ".", ",", "x.\nY", "été,", "end.)", "\"q\"", "it's!", "<", "|", ">", "ÿ:", "×", "÷"]


def texts(n=4000, seed=7):
    draw = random.Random(seed)
    return ["", " ", "\n", "a", " a", "a ", "  a", "a\n b"] + [
        "".join(draw.choice(PARTS) for _ in range(draw.randint(1, 25))) for _ in range(n)]


def library(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_library():
    of = id_pieces(PATH).of
    for text in texts():
        assert np.frombuffer(of(text), "<u4").tolist() == library(text), repr(text)


def test_whole_tokens_are_single_tokens():
    whole = whole_tokens(PATH)
    assert len(whole) > 40_000 and "<|endoftext|>" not in whole


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"x{i}") for i, t in enumerate(texts(200, 3))] + [(9000, None, "n"), (9001, "the " * 40_000, "long"), (3, "a", "again"),
                                                                   (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_counts(docs):
    got = sorted(map(tuple, count_tokens(docs, PATH, 20).collect()), key=repr)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n, n > 20) for r in docs.collect()
                   for n in [len(library(r.text))]), key=repr)
    assert got == want


def test_files(spark, docs, tmp_path):
    out = str(tmp_path / "files")
    write_tokens(docs, out, PATH, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in digests(spark, out).collect())
    assert [g[1] is None for g in got].index(True) == 0
    assert [g[1] for g in got[1:]] == sorted(g[1] for g in got[1:])
    start = 0
    for s, _, n, _ in got:
        assert s == start
        start += n
    want = sorted(zlib.crc32(np.array(library(r.text) + [2], "<u4").tobytes()) for r in docs.collect())
    assert sorted(g[3] for g in got) == want
    plan = read_tokens(spark, out).select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<n_tokens:bigint>" in plan


def test_empty(spark, docs, tmp_path):
    none = docs.limit(0)
    assert count_tokens(none, PATH, 1).count() == 0
    write_tokens(none, str(tmp_path / "none"), PATH, 2)
    assert digests(spark, str(tmp_path / "none")).count() == 0
