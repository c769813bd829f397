"""Phrase hits, proximity and contamination against plain versions."""

import random
import re

from vecspark.llm.phrase_index import build_index, contamination, find_near, term_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, size):
    rows = []
    listed = [(i, WORD.findall(low(t))) for i, t in items]
    for doc_id, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for item, words in listed:
            n = min(size, len(words))
            wins = {tuple(words[j:j + n]) for j in range(len(words) - n + 1)} if n else set()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j:j + n]) in wins:
                    hit |= set(range(j, j + n))
                    found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        rows.append((doc_id, len(w), len(hit), len(ids), ids))
    return sorted(rows, key=repr)


def test_contamination(spark):
    draw = random.Random(6)
    vocab = ["the", "of", "And", "ÉTÉ", "été", "x1", "zebra", "quark", "lion", "a"]
    make = lambda n: " ".join(draw.choice(vocab) + draw.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(i, make(draw.randint(4, 9))) for i in range(12)] + [(20, "zebra"), (21, "quark LION"), (22, ""), (23, None), (None, "lion lion"), (20, "of of of")]
    docs = [(i, make(draw.randint(0, 60)) + " " + (draw.choice(items)[1] or "") + " " + make(5)) for i in range(80)]
    docs += [(100, None), (101, ""), (None, "zebra and"), (5, docs[5][1]), (6, "other zebra"), (102, "the " * 3000 + items[0][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in contamination(d, b, 5).collect()), key=repr)
    assert got == plain(docs, items, 5)
    assert contamination(d.limit(0), b, 5).count() == 0
    assert contamination(d, b.limit(0), 5).agg({"n_hit": "sum"}).first()[0] == 0


def test_index_keeps_only_its_context(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500)))], "doc_id long, text string")
    t = spark.createDataFrame([("w0",), ("w250",), ("w499",)], "term string")
    rows = {r.term: (r.pos, r.before, r.after) for r in build_index(d, t, 3).collect()}
    assert rows == {"w0": (0, "", "w1 w2 w3"), "w250": (250, "w247 w248 w249", "w251 w252 w253"), "w499": (499, "w496 w497 w498", "")}


def test_near(spark):
    draw = random.Random(8)
    docs = [(i, " ".join(draw.choice("abcdefgh") for _ in range(40))) for i in range(30)]
    groups = [(1, ["a", "b"]), (2, ["c", "d", "e", "c"]), (3, ["h"]), (4, ["a", "zz"])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    g = spark.createDataFrame(groups, "group_id long, terms array<string>")
    terms = spark.createDataFrame([(t,) for t in {t for _, ts in groups for t in ts}], "term string")
    counts = term_counts(d, terms)
    got = {(r.doc_id, r.group_id, r.start) for r in find_near(build_index(d, terms, 1), g, counts, 4).collect()}
    want = {(i, k, s) for i, t in docs for k, ts in groups for s in range(40)
            if set(ts) <= set(t.split()[s:s + 4])}
    assert got == want
