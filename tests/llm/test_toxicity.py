"""The field's marginals against all labellings, held-out accuracy, spans and odd inputs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import toxicity as t
from vecspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_marginals_are_exact():
    draw = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 6, 2])
    score, w = draw.normal(0, 2, sizes.sum()), draw.normal(0, 1, (2, 2))
    got, at = t.marginals(score, sizes, w), 0
    for n in sizes:
        s, total, hit = score[at:at + n], 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(a * b for a, b in zip(s, y)) + sum(w[a, b] for a, b in zip(y, y[1:])))
            total, hit = total + p, hit + p * np.array(y)
        if n:
            assert np.allclose(got[at:at + n], hit / total)
        at += n


def test_pairs_are_the_gradient_of_the_chain():
    """Expected pairs of states against all labellings, and against finite differences of the log partition."""
    draw = np.random.default_rng(2)
    sizes = np.array([4, 0, 1, 5, 2])
    score, w = draw.normal(0, 2, sizes.sum()), draw.normal(0, 2, (2, 2))
    starts = np.cumsum(sizes) - sizes
    seconds = np.array([i for i in range(sizes.sum()) if i not in set(starts[sizes > 0])])

    def log_partition(w):
        out = 0.0
        for at, n in zip(starts, sizes):
            s = score[at:at + n]
            out += np.log(sum(np.exp(sum(a * b for a, b in zip(s, y)) + sum(w[a, b] for a, b in zip(y, y[1:])))
                              for y in itertools.product((0, 1), repeat=int(n))))
        return out

    got = t.expected_pairs(score, sizes, w, seconds)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert got[a, b] == pytest.approx((log_partition(w + step) - log_partition(w - step)) / 2e-5, rel=1e-5)
    assert got.sum() == pytest.approx(len(seconds))


def test_repeated_sampled_ids_train_once(spark):
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert t.sample(docs, labels, F.lit(True)) == (["a text", "c"], [1, 0])


def test_held_out_accuracy(spark):
    rows = QUERIES["op8_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 50 and rows.toxic.sum() > 3
    good, bad = rows.score[rows.toxic == 0].to_numpy(), rows.score[rows.toxic == 1].to_numpy()
    auc = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert auc > 0.85, auc


@pytest.fixture(scope="module")
def model():
    words = "alpha beta gamma delta rho sigma tau phi chi psi".split()
    draw = np.random.default_rng(2)
    texts = [" ".join(draw.choice(words, 30)) for _ in range(60)]
    toxic = [i % 3 == 0 for i in range(60)]
    texts = [x.replace(" ", " vile creep ", 2) if b else x for x, b in zip(texts, toxic)]
    return t.train(texts, [int(b) for b in toxic])


def test_scores_and_spans(spark, model):
    rows = [(1, "alpha beta vile creep gamma"), (2, "alpha beta"), (3, None), (4, ""), (2, "alpha beta"), (None, "beta vile creep"), (5, "beta " * 30_000)]
    df = spark.createDataFrame([(i, x, 0.5) for i, x in rows], "doc_id long, text string, score double")
    got = {(r.doc_id, i): r for i, r in enumerate(t.score_documents(df.coalesce(1), model).collect())}
    assert got[1, 0].score > 0.5 > got[2, 1].score and got[2, 1].score == got[2, 4].score and got[3, 2].score == got[4, 3].score < 0.5
    assert [tuple(s) for s in got[1, 0].spans] == [(11, 21)] and [tuple(s) for s in got[None, 5].spans] == [(5, 15)]
    assert got[5, 6].score < 0.5 and t.score_documents(df.limit(0), model).count() == 0


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    found = t.train(*t.sample(docs, labels, F.lit(True)))
    assert not found.fitted and [r.score for r in t.score_documents(docs, found).collect()] == [0.0, 0.0]
    one = t.train(["bad"], [1])
    assert not one.fitted and one.share == 1
