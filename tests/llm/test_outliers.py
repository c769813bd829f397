"""Base counts against plain Python, estimates against plain numpy, and verdicts on planted outliers."""

import random
import re

import numpy as np
import pytest

from vecspark.llm import outliers as o

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            hit |= set(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_base_counts(spark):
    draw = random.Random(2)
    texts = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "é\n\né\n é\n#$|&<>*%"]
    texts += ["".join(draw.choice(["a", "bb", "🤦", "#"]) + draw.choice([" ", "\n", "\x0b", "  "]) for _ in range(draw.randint(0, 70))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in [*o.BASE, "base_failed"]) for r in o.base_statistics(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_quantiles():
    assert o.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert o.chi2_quantile(0.5, 5) == pytest.approx(4.3515, abs=1e-3)
    assert o.consistency(1 - 1e-12) == pytest.approx(1, abs=1e-6)


def mcd(x):
    """Plain estimates of one group: the same starts, bins, steps and reweighting."""
    floors = np.diag((np.array(list(o.FLOORS.values())) * o.UNIT) ** 2)
    n, x = len(x), x.astype(float)
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    best = None
    width = o.UNIT // 64

    def quantile(col, p):
        bins = np.sort(np.floor(col / width))
        return bins[int(np.ceil(p * n)) - 1] * width + width / 2
    med = np.array([quantile(c, .5) for c in x.T])
    iqr = np.array([(quantile(c, .75) - quantile(c, .25)) / 1.349 for c in x.T])
    for m, c in ((med, np.diag(iqr ** 2) + floors), (x.mean(0), np.cov(x.T, bias=True) + floors)):
        was = np.inf
        for _ in range(o.MAX_STEPS):
            bins = np.floor(np.log2(dist(m, c) + 1e-9) * o.BINS_PER_OCTAVE)
            cut = np.sort(bins)[int(np.floor((n + o.P + 1) * o.HALF)) - 1] if n > 1 else np.inf
            near = x[bins <= cut]
            m2, c2 = near.mean(0), np.cov(near.T, bias=True).reshape(o.P, o.P) * o.consistency(o.HALF) + floors
            det = np.linalg.slogdet(c2)[1]
            if not det < was - o.LEAST_GAIN:
                break
            m, c, was = m2, c2, det
        if best is None or was < best[0]:
            best = was, m, c
    near = x[dist(*best[1:]) <= o.chi2_quantile(o.REWEIGHT, o.P)]
    return near.mean(0), np.cov(near.T, bias=True).reshape(o.P, o.P) * o.consistency(o.REWEIGHT) + floors


def test_fit_against_plain(spark):
    draw = np.random.default_rng(4)
    rows = []
    for lang, source, n in (("en", "a", 150), ("en", None, 90), (None, "a", 60), ("de", "b", 1)):
        for _ in range(n):
            words = int(draw.lognormal(5, 1)) + 1
            junk = draw.random() < 0.15
            rows.append((len(rows), lang, source, words, int(words * draw.normal(5, 0.5)) + 1, int(words * 2 * junk), 3, int(2 * junk), int(words * 0.2 * junk), False))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    got = o.judge(stats, o.fit(stats)).toPandas()
    q = o.vectors(stats).toPandas()
    x = q[o.Q].to_numpy()
    for lang, source in {(r[1], r[2]) for r in rows}:
        lang_rows = np.array([r[1] == lang for r in rows])
        own = lang_rows & np.array([r[2] == source for r in rows])
        (m, c), (lm, lc), n = mcd(x[own]), mcd(x[lang_rows]), own.sum()
        m, c = (n * m + o.PRIOR_ROWS * lm) / (n + o.PRIOR_ROWS), (n * c + o.PRIOR_ROWS * lc) / (n + o.PRIOR_ROWS)
        want = np.einsum("ij,jk,ik->i", x[own] - m, np.linalg.inv(c), x[own] - m)
        mine = got.set_index("doc_id").distance.loc[q.doc_id[own]].to_numpy()
        assert np.allclose(mine, want, rtol=1e-6, atol=1e-6), (lang, source)
    junk = np.array([r[5] > 0 for r in rows])
    kept = got.sort_values("doc_id").kept.to_numpy()
    assert not kept[junk].any() and kept[~junk].mean() > 0.97


STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def clean_rows(n, seed):
    draw = np.random.default_rng(seed)
    sizes = (draw.lognormal(5.5, 0.5, n) + 30).astype(int).tolist()
    return [(i, "en", "s", w, int(w * draw.normal(5, 0.15)), 0, 30, int(draw.random() < 0.02), 0, False) for i, w in enumerate(sizes)]


def test_one_statistic_rejects(spark):
    """Each planted row differs from clean ones by one statistic, short of the base rules."""
    rows = clean_rows(400, 7)
    rows += [(1000, "en", "s", 300, 1500, 0, 30, 10, 0, False), (1001, "en", "s", 300, 1500, 0, 30, 0, 84, False),
             (1002, "en", "s", 300, 1500, 30, 30, 0, 0, False), (1003, "en", "s", 300, 2100, 0, 30, 0, 0, False)]
    stats = spark.createDataFrame(rows, STATS)
    kept = {r.doc_id: r.kept for r in o.judge(stats, o.fit(stats)).collect()}
    assert not any(kept.pop(i) for i in range(1000, 1004))
    assert np.mean(list(kept.values())) > 0.95


def test_floors_are_minima(spark):
    """A spread above its floor stays as it is; equal rows have the floor."""
    stats = spark.createDataFrame(clean_rows(400, 8), STATS)
    cov = np.array(o.fit(stats).first()["cov"]).reshape(o.P, o.P) / o.UNIT ** 2
    x = o.vectors(stats).toPandas()[o.Q].to_numpy() / o.UNIT
    assert np.allclose(np.diag(cov)[:2], x.var(0)[:2], rtol=0.25)
    assert cov[2, 2] == pytest.approx(o.FLOORS["symbols"] ** 2) and cov[4, 4] == pytest.approx(o.FLOORS["repeats"] ** 2)
    line = spark.createDataFrame([(i, "en", "s", 100, 500, 0, 3, 0, 0, False) for i in range(9)], STATS)
    assert [r.distance for r in o.judge(line, o.fit(line)).collect()] == [0.0] * 9


def test_documents_keep_columns(spark):
    df = spark.createDataFrame([(i, "word " * (i + 1), "en", "s", "mine") for i in range(30)], "doc_id long, text string, lang string, source string, kept string")
    got = o.kept_documents(df)
    assert got.columns == df.columns and set(r.kept for r in got.collect()) <= {"mine"}
    assert o.kept_documents(df.limit(0)).count() == 0
