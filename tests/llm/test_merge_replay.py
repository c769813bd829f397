"""Merge replay against the library, text by text."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from llm.test_pieces import texts
from vecspark.llm.merge_replay import encode_documents, encode_words, pack, ranks_of, replay, token_ids, unpack

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, counts):
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at:at + n].tolist())
        at += n
    return out


def test_words_together_equal_words_alone(library):
    draw = random.Random(3)
    words = [bytes(draw.choice(b"abcdeEst \xc3\xa9\xff") for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    words += [b"", b"a" * 5000, b"ab" * 3000, b" tokenization", b"\n" * 77]
    ranks = ranks_of(PATH)
    assert split(*encode_words(words, ranks)) == [library._core_bpe.encode_single_piece(w) if w else [] for w in words]
    # the vocabulary's own strings too, where merges alone lead to them
    assert [x for x in split(*replay([b" tokenization", b"x"], ranks))] == [library.encode_ordinary(" tokenization"), library.encode_ordinary("x")]


def test_a_lower_rank_that_a_merge_brings_up_goes_first():
    """bc (rank 256) and a+bc (257) come late; ab+c has the same bytes as a+bc, whose rank is below that of ab."""
    from vecspark.llm.merge_replay import Ranks
    import tempfile
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 258, b"abc": 256, b"ab": 257, b"ca": 259}
    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken") as file:
        file.write(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        file.flush()
        found = Ranks(file.name)
    own = tiktoken.Encoding("tiny", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(4)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(2, 30))).encode() for _ in range(500)] + [b"ababcab", b"abab"]
    assert split(*replay(words, found)) == [own._core_bpe.encode_single_piece(w) for w in words]


def test_packing():
    for values in ([], [0], [1 << 31, 5, 70_000], list(range(9000))):
        assert unpack(pack(values)).tolist() == values


def test_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(400, 5))]
    rows += [(900, None), (901, ""), (None, "no id <|endoftext|>"), (3, rows[3][1]), (902, "漢字" * 40_000), (903, "z" * 30_000 + "\x1c\x85 　"),
             (904, "the same words " * 20_000)]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, data binary, kind int").repartition(5)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    want.sort(key=repr)
    for block in (20_000, 24 << 20):
        assert sorted(map(tuple, encode_documents(df, PATH, public_tokenizers.PATTERN, block).collect()), key=repr) == want
    got = {r.doc_id: list(r.ids) for r in token_ids(df, PATH, public_tokenizers.PATTERN).collect()}
    assert got[904] == library.encode_ordinary(rows[-1][1]) and got[900] == []
    assert encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
