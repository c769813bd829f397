"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training takes a bounded sample of labelled documents (``MOST_TOXIC`` toxic and
``MOST_CLEAN`` other rows, those with the smallest hashes of their ids), whole
texts. Their labels are per document, so tokens are labelled by the fewest
words that explain the toxic ones: greedily the word that lies in most toxic
documents not yet explained, less the share of clean documents that hold it;
words that explain less than a hundredth of the toxic documents more are left out.
The field has two states per token; its emissions are the token, its ends and
its shape, hashed; transitions let spans go on. It is fitted by ``STEPS`` gradient
steps on the penalised conditional likelihood, with exact forward-backward
marginals of tokens and of neighbouring pairs.

Scoring runs in tasks over all texts: marginals per token, then a logistic
model of their sum and maximum gives the document's score, and runs of tokens
of one half or more give spans in code points. Ids, sources and languages are
never looked at.

Defined cases: null and empty texts have the score of a document without toxic
tokens; labels of no document, null labels and repeated labels do no harm; of rows that
repeat a sampled id the least text is trained on;
without toxic or without clean training rows every score is the training rows'
share of toxic ones (0 without any); repeated rows get equal scores; extra
columns are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecspark.llm.common import small_batches
from vecspark.llm.pieces import Kept

MOST_TOXIC, MOST_CLEAN = 1500, 3000
DIMENSIONS, STEPS, RATE, DECAY, TRANSITION_DECAY = 1 << 18, 40, 0.3, 1e-6, 1.0
LEAST_GAIN, SKETCH, CHANCE = 0.01, 8, 0.05
#: Log-odds of a token that nothing speaks for.
BIAS = -4.0
TOKEN = re.compile(r"[^\W_]+")


def features(token: str) -> list[int]:
    low = token.lower()
    shape = "upper" if token.isupper() else "title" if token[:1].isupper() else "lower"
    return [zlib.crc32(f.encode()) % DIMENSIONS for f in (f"w {low}", f"p {low[:5]}", f"s {low[-5:]}", f"c {shape}")]


def marginals(scores: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """P(toxic) of every token of all texts: ``scores`` are log-odds, ``weights`` the transitions' log-weights (2, 2)."""
    _, ahead, back = passes(scores, sizes, weights)
    odds = ahead * back
    return odds / (1 + odds)


def expected_pairs(scores: np.ndarray, sizes: np.ndarray, weights: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """How many neighbouring tokens are expected in each pair of states (2, 2); ``seconds`` are the places of the later ones."""
    e, ahead, back = passes(scores, sizes, weights)
    before, after, m = ahead[seconds - 1], e[seconds] * back[seconds], np.exp(weights)
    cells = np.stack([np.full(len(seconds), m[0, 0]), m[0, 1] * after, m[1, 0] * before, m[1, 1] * before * after])
    return (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)


def passes(scores: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(emissions, forward, backward) of every token, each as the ratio of toxic to clean.

    The recursions go through all texts side by side.
    """
    e, m = np.exp(np.clip(scores, -30, 30)), np.exp(weights)
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    ahead, back = np.empty(len(e)), np.empty(len(e))
    r = None
    for t in range(longest):
        at = first[:active[t]] + t
        r = e[at] if t == 0 else e[at] * (m[0, 1] + r[:active[t]] * m[1, 1]) / (m[0, 0] + r[:active[t]] * m[1, 0])
        r = np.clip(r, 1e-30, 1e30)
        ahead[at] = r
    last = first + lengths - 1
    q = np.ones(len(lengths))
    for t in range(longest):
        n = active[t]
        at = last[:n] - t
        if t:
            x = e[at + 1] * q[:n]
            q[:n] = np.clip((m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x), 1e-30, 1e30)
        back[at] = q[:n]
    return e, ahead, back


def distinct_texts(texts: list[list]) -> list[list]:
    """The token lists without near copies of earlier ones, by sketches of their least hashes of token pairs."""
    kept, holders = [], {}
    for tokens in texts:
        sketch = sorted({zlib.crc32(f"{a} {b}".encode()) for a, b in zip(tokens, tokens[1:])})[:SKETCH]
        shared: dict = {}
        for h in sketch:
            for i in holders.get(h, ()):
                shared[i] = shared.get(i, 0) + 1
        if sketch and max(shared.values(), default=0) * 2 >= len(sketch):
            continue
        for h in sketch:
            holders.setdefault(h, []).append(len(kept))
        kept.append(tokens)
    return kept


def explaining_words(toxic: list[list], clean: list[list]) -> set[str]:
    """The words that explain the toxic texts, taken greedily; near copies count once."""
    toxic = [set(t) for t in distinct_texts(toxic)]
    where, harm = {}, {}
    for i, words in enumerate(toxic):
        for w in words:
            where.setdefault(w, set()).add(i)
    for words in clean:
        for w in set(words):
            if w in where:
                harm[w] = harm.get(w, 0) + 1
    open_, found, scale = set(range(len(toxic))), {}, len(toxic) / max(1, len(clean))
    # words whose documents would hardly all be toxic by chance, among so many words
    share = math.log(len(toxic) / (len(toxic) + len(clean)))
    least = math.log(CHANCE / max(1, sum(len(s) > 1 for s in where.values())))

    def telling(k: int, h: int) -> bool:
        return k > 3 * scale * h and k * share + math.lgamma(k + h + 1) - math.lgamma(k + 1) - math.lgamma(h + 1) < least

    where = {w: s for w, s in where.items() if telling(len(s), harm.get(w, 0))}
    while open_ and where:
        gain, word = max((len(s & open_) - scale * harm.get(w, 0), w) for w, s in where.items())
        if gain < max(2, LEAST_GAIN * len(toxic)):
            break
        found[word] = where.pop(word)
        open_ -= found[word]
    # words that go along with others explain little alone; those about as frequent as the found ones count too
    least = np.median([len(s) for s in found.values()]) / 2 if found else math.inf
    return {*found, *(w for w, s in where.items() if len(s) >= least and not harm.get(w))}


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    calibration: np.ndarray
    share: float
    fitted: bool

    def emission(self, token: str) -> float:
        return float(self.weights[features(token)].sum())


def _document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(1, log(1 + expected toxic tokens), the largest marginal) of every text."""
    total, top = np.zeros(len(sizes)), np.zeros(len(sizes))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    np.add.at(total, doc, p)
    np.maximum.at(top, doc, p)
    return np.stack([np.ones(len(sizes)), np.log1p(total), top], axis=1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """The model of a bounded sample; the same rows in the same order give the same model."""
    y = np.array(toxic, dtype=float)
    share = float(y.mean()) if len(y) else 0.0
    none = Model(np.zeros(DIMENSIONS, np.float32), np.zeros((2, 2)), np.zeros(3), share, False)
    if not 0 < share < 1:
        return none
    pool: dict = {}  # one string per distinct token
    tokens = [[pool.setdefault(w, w) for w in TOKEN.findall(t or "")] for t in texts]
    small = {w: w.lower() for w in pool}
    small = {w: pool.setdefault(x, x) for w, x in small.items()}
    lower = [[small[w] for w in t] for t in tokens]
    marked = explaining_words([t for t, b in zip(lower, y) if b], [t for t, b in zip(lower, y) if not b])
    table: dict = {}
    flat = np.array([table.setdefault(w, len(table)) for t in tokens for w in t], dtype=np.int32)
    rows = np.array([features(w) for w in table], dtype=np.int64).reshape(-1, 4)
    bad = np.array([w.lower() in marked for w in table], dtype=bool)
    sizes = np.array([len(t) for t in tokens])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    gold = (bad[flat] & (y[doc] > 0)).astype(float) if len(flat) else np.zeros(0)
    inner = np.ones(len(flat), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    pairs = np.flatnonzero(inner)
    w, a = np.zeros(DIMENSIONS), np.zeros((2, 2))
    moments = [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros((2, 2)), np.zeros((2, 2))]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[pairs - 1].astype(int), gold[pairs].astype(int)), 1)
    for step in range(1, STEPS + 1):
        score = w[rows].sum(axis=1)[flat] + BIAS
        p = marginals(score, sizes, a)
        by_word = np.bincount(flat, weights=gold - p, minlength=len(rows))
        grad = np.zeros(DIMENSIONS)
        np.add.at(grad, rows.ravel(), np.repeat(by_word, rows.shape[1]))
        want = expected_pairs(score, sizes, a, pairs)
        for k, (value, g) in enumerate(((w, grad - DECAY * w), (a, seen - want - TRANSITION_DECAY * a))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            value += RATE * (moments[2 * k] / (1 - 0.9 ** step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99 ** step)) + 1e-8)
    p = marginals(w[rows].sum(axis=1)[flat] + BIAS, sizes, a)
    x, c = _document_features(p, sizes), np.zeros(3)
    for _ in range(50):
        s = _sigmoid(x @ c)
        hessian = (x * (s * (1 - s))[:, None]).T @ x + np.eye(3) * 0.1
        c += np.linalg.solve(hessian, x.T @ (y - s) - 0.1 * c)
    return Model(w.astype(np.float32), a, c, share, True)


def sample(docs: DataFrame, labels: DataFrame, usable) -> tuple[list, list]:
    """Texts and labels of the bounded training sample; ``usable`` is a condition on doc_id."""
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [rows.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for kind, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    # one text per id, so that the sample is bounded whatever repeats
    picked = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = picked.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return found.column("text").to_pylist(), found.column("toxic").to_pylist()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) of every row; spans are (start, end) in code points."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kept: dict = {}

    def run(batches):
        model = sent.value
        table = kept.setdefault("table", Kept(model.emission, 300_000))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [TOKEN.findall(t) for t in texts]
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            score = np.fromiter((table[w] for t in tokens for w in t), dtype=float, count=int(sizes.sum()))
            p = marginals(score + BIAS, sizes, model.transitions) if model.fitted else np.zeros(len(score))
            out = _sigmoid(_document_features(p, sizes) @ model.calibration) if model.fitted else np.full(len(texts), model.share)
            ends, hits = np.cumsum(sizes), p >= 0.5
            spans = []
            for text, a, b in zip(texts, ends - sizes, ends):
                own: list = []
                if hits[a:b].any():
                    last = False
                    for m, hit in zip(TOKEN.finditer(text), hits[a:b].tolist()):
                        if hit and last:
                            own[-1]["end"] = m.end()
                        elif hit:
                            own.append({"start": m.start(), "end": m.end()})
                        last = hit
                spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(spans, kind)],
                                             names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long>>")
