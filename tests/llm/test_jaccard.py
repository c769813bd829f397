"""Components against all pairs on small tables, and the allocation's guarantee."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vecspark.llm import jaccard
from vecspark.llm.jaccard import allocate, bounds, link_components, one_of_each, signatures
from vecspark.session import path_exists


def plain(rows, k, num, den):
    ids = [i for i, _ in rows]
    sets = []
    for _, text in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = {i: i for i in ids if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and None not in (ids[x], ids[y]) and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(ids[x]), root(ids[y])))
                label[b] = a
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in zip(ids, sets)), key=repr)


def edits(draw, words, n):
    words = list(words)
    for _ in range(n):
        at = draw.randrange(len(words))
        draw.choice([lambda: words.pop(at) if len(words) > 4 else None, lambda: words.insert(at, draw.choice("pqrs")),
                     lambda: words.__setitem__(at, draw.choice("tuvw"))])()
    return words


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_components(spark, k, num, den):
    draw = random.Random(k)
    rows = []
    for base in range(14):
        words = [f"{draw.choice('abcdefgh')}{draw.randrange(60)}" for _ in range(draw.choice([3, 8, 12, 30, 90, 400]))]
        for _ in range(draw.choice([1, 3, 12])):
            rows.append((len(rows), " ".join(edits(draw, words, draw.choice([0, 1, 2, len(words) // 60, len(words) // 25])))))
    # a chain whose ends don't link, and a large group of near copies with stragglers
    chain = [f"c{i}" for i in range(120)]
    for i in range(10):
        rows.append((len(rows), " ".join(chain[:i * 3] + [f"new{j}" for j in range(i * 3)] + chain[i * 3:])))
    for i in range(40):
        rows.append((len(rows), " ".join(edits(draw, [f"g{j}" for j in range(150)], draw.choice([1, 1, 2, 5])))))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "two words"), (904, "Two  Words"), (905, "word"), (None, "two words"),
             (906, rows[4][1].upper()), (5, rows[5][1]), (907, "w " * 30_000)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(6)
    got = sorted(map(tuple, link_components(df, k, num, den).collect()), key=repr)
    want = plain(rows, k, num, den)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 40
    kept = sorted(r.doc_id for r in one_of_each(df, k, num, den).where("doc_id IS NOT NULL").collect())
    assert kept == sorted(i for i, _, c in want if i is not None and i == c)


def test_rounds_hold_open_shingles_only(spark, monkeypatch):
    """Shingles whose members are all connected, or that a round has closed, are in no later round."""
    draw, rows, kept = random.Random(3), [], []
    for i in range(150):
        # copies of one text, some of them with a passage of their own that near misses share
        words = edits(draw, [f"g{j}" for j in range(150)], draw.choice([1, 1, 2]))
        rows.append((i, " ".join(words[:60] + [f"p{i % 3}x{j}" for j in range(6 + i % 5)] * (i % 2) + words[60:])))

    def spied(df, name, **options):
        found = stored(df, name, **options)
        if "key" in df.columns and "first" in df.columns:
            kept.append((name, found[0].collect()))
        return found
    stored = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", spied)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, link_components(df, 3, 90, 100).collect()), key=repr) == plain(rows, 3, 90, 100)
    tables = {name: [t for n, t in kept if n == name] for name in ("members", "open")}
    assert len(tables["open"]) > 1 and tables["open"][0]
    for found in tables["open"]:
        labels = {}
        for r in found:
            labels.setdefault(r.key, set()).add(r.label)
        assert all(len(x) > 1 for x in labels.values())
    sizes = [len(t) for t in tables["members"]]
    assert sizes[1] < len(tables["open"][0]) < sizes[0]


def near_misses(n=120):
    """Texts that share a passage and are otherwise their own; every tenth has a near copy."""
    draw, rows = random.Random(8), []
    for i in range(n):
        words = [f"{draw.choice('abcdef')}{draw.randrange(90)}" for _ in range(60)] + [f"s{j}" for j in range(80)]
        rows.append((len(rows), " ".join(words)))
        if i % 10 == 0:
            rows.append((len(rows), " ".join(edits(draw, words, 1))))
    return rows


def test_texts_of_pairs_that_differ_too_much_stay(spark, monkeypatch):
    """Only pairs that may link have their texts sent, and no scratch table but the result stays."""
    sent, verify = [], jaccard.verify

    def spied(pairs, *rest):
        sent.append(pairs.count())
        return verify(pairs, *rest)
    monkeypatch.setattr(jaccard, "verify", spied)
    rows, paths, stored = near_misses(), {}, jaccard.stored

    def kept(df, name, **options):
        found = stored(df, name, **options)
        paths.setdefault(name, []).append(found[1])
        return found
    monkeypatch.setattr(jaccard, "stored", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, link_components(df, 5, 80, 100).collect()), key=repr) == plain(rows, 5, 80, 100)
    assert 0 < sum(sent) <= 24
    assert not any(path_exists(spark, path) for name in ("edges", "texts", "tested", "links", "members") for path in paths[name])


@pytest.mark.parametrize("counters", [1 << 22, 1])
def test_rounds_and_counters_lose_no_link(spark, monkeypatch, counters):
    """Pairs in several rounds, and shingles put in any order, give the same components."""
    def parts(pairs, texts):
        return [(pairs.where(f"pmod(xxhash64(a), 3) = {i}"), texts) for i in range(3)]
    monkeypatch.setattr(jaccard, "in_rounds", parts)
    monkeypatch.setattr(jaccard, "MOST_COUNTERS", counters)
    rows = near_misses(90)
    draw = random.Random(4)
    rows += [(len(rows) + i, " ".join(edits(draw, [f"g{j}" for j in range(150)], draw.choice([1, 8, 16])))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, link_components(df, 5, 80, 100).collect()), key=repr) == plain(rows, 5, 80, 100)


def test_rounds_hold_as_many_pairs_as_texts(spark):
    pairs = spark.range(100).selectExpr("id % 40 AS a", "id AS b")
    texts = spark.range(30).selectExpr("id AS doc_id", "'x' AS text")
    found = jaccard.in_rounds(pairs, texts)
    assert len(found) == 4 and sorted(r for part, _ in found for r in map(tuple, part.collect())) == sorted(map(tuple, pairs.collect()))


def test_sketches_never_differ_by_more_than_sets(spark):
    draw, sets = random.Random(5), []
    for n in [1, 2, 5, 31, 33, 120, 700, 3000]:
        words = [f"{draw.choice('abc')}{draw.randrange(10**6)}" for _ in range(n)]
        sets += [words, edits(draw, words, n // 20 + 1), words[:n // 2 + 1], words * 2]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(sets)], "doc_id long, text string")
    found = sorted(map(tuple, jaccard.sketches(rows, 3).collect()))
    shingles = [set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} for w in sets]
    assert [(i, n) for i, n, _ in found] == [(i, len(s)) for i, s in enumerate(shingles)]
    a, b = zip(*((x, y) for x in range(len(sets)) for y in range(len(sets))))
    bits = pa.array([bytes(f[2]) for f in found])
    least = jaccard.least_differences(bits.take(pa.array(a)), bits.take(pa.array(b)))
    true = np.array([len(shingles[x] ^ shingles[y]) for x, y in zip(a, b)])
    assert (least <= true).all() and (least[true == 0] == 0).all()
    assert true[28 * len(sets) + 29] // 2 < least[28 * len(sets) + 29]
    some = slice(7, 40)
    assert (jaccard.least_differences(bits.take(pa.array(a))[some], bits.take(pa.array(b))[some]) == least[some]).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert link_components(df, 3, 90, 100).count() == 0


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_share_a_signature(num, den):
    """Random pairs right at the threshold, of all sizes, through the kernel alone."""
    draw = np.random.default_rng(num)
    for size in [1, 2, 3, 4, 5, 7, 9, 10, 11, 15, 20, 33, 60, 150, 700]:
        for _ in range(25):
            a = draw.integers(-2**62, 2**62, size)
            out = draw.integers(0, size + 1)
            while size - out and den * (size - out) < num * size:
                out -= 1
            b = a[:size - out]
            room = (den * len(b) - num * size) // num if den * len(b) >= num * size else 0
            b = np.concatenate([b, draw.integers(-2**62, 2**62, max(0, room))])
            both = len(set(a) & set(b))
            if den * both < num * len(set(a) | set(b)):
                continue
            keys, lead, member, start = signatures(np.array([1, 2]), np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), num, den)
            assert ((lead != member) & ~start).any(), (size, out, room)


def test_bands_cover_partners():
    for num, den in [(90, 100), (80, 100)]:
        limits = bounds(5000, num, den)
        for n in range(1, 5000):
            band = np.searchsorted(limits, n, side="right") - 1
            assert np.searchsorted(limits, n * den // num, side="right") - 1 <= band + 1
    segments, deletions, slack = allocate(8, 12, 80, 100)
    assert segments + deletions >= 2 * 20 * 12 // 180 + 1 + slack
