"""Line dedup against a plain version."""

import hashlib
import random

from vecspark.llm.lines import apply_bitmaps, dedup_lines, keep_bitmaps

WS = " \t\n\x0b\f\r"


def plain(rows):
    first, docs = {}, {}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                docs.setdefault(key(line), set()).add(i)
    first = {k: min(v) for k, v in docs.items() if len(v) > 1}
    out = []
    for i, text in rows:
        ls = (text or "").split("\n")
        stay = [x for x in ls if i is None or first.get(key(x), i) == i]
        out.append((i, len(ls), len(ls) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_plain(spark):
    draw = random.Random(1)
    some = ["a common line of text", "A Common LINE of text  ", "ÄÖÜ äöü line ß", "ÄÖÜ ÄÖÜ line ß", "short", "", "nine char",
            "ten chars!", "\x1cten chars!"] + [f"line number {i} of many" for i in range(40)]
    rows = [(i, "\n".join(draw.choice(some) for _ in range(draw.randint(0, 150)))) for i in range(120)]
    rows += [(500, None), (501, ""), (5, "ten chars!\nten chars!"), (7, rows[7][1]), (None, "ten chars!"), (600, "\n" * 5000 + some[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_dropped string").repartition(7)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest())
                  for r in dedup_lines(df).collect()), key=repr)
    assert got == plain(rows)


def test_bitmaps_hold_no_text(spark):
    df = spark.createDataFrame([(1, "the same line\nx"), (2, "y\nthe same line")], "doc_id long, text string")
    maps = keep_bitmaps(df)
    assert [f.name for f in maps.schema] == ["doc_id", "body", "keep_words", "n_dropped"]
    row = maps.first()
    assert row.doc_id == 2 and row.keep_words[0].word == 0 and row.keep_words[0].bits == ~2
    assert {r.doc_id: r.text for r in apply_bitmaps(df, maps).collect()} == {1: "the same line\nx", 2: "y"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert dedup_lines(df).columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    assert dedup_lines(df).count() == 0
