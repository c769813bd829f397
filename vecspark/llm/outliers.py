"""Quality rules: documents far from their language's and source's robust centre.

Per text: words, characters in words, symbols, repeated lines and repeated
8-word windows, in array functions of one row; no word leaves its row. Five
transformed statistics make a vector, kept in fixed point so that sums are exact
in any order.

Per (language, source) and per language, the minimum covariance determinant:
from two deterministic starts (medians with interquartile ranges; mean with
covariance), concentration steps take the half of the rows nearest by
Mahalanobis distance and re-estimate, until no group's log-determinant falls by
LEAST_GAIN any more (MAX_STEPS at most; each step's result is valid); the lower
determinant wins. One step is one scan: distances fall into narrow bins of a
logarithmic scale, tasks sum moments per group and bin, and the bins that hold
the nearest half (whole bins, so ties stay together) add up. A last step
reweights by the 97.5 % quantile. A group's estimate is drawn towards its
language's by ``PRIOR_ROWS`` rows, and every variance, also what the statistics
before it leave of it, is its floor at least, so groups of any size, even of one
row or of equal rows, have an estimate. A spread above the floor stays as it is.

Defined cases: null text has no words; null language or source is a value of
its own; repeated rows count each; an empty table gives no rows; extra columns
are kept by ``judge``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vecspark.llm.common import forget, stored, words

RUN, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Scale of the fixed point, and the least standard deviation of each statistic: minima, for statistics without spread.
#: Length and word length have that of rounding to the fixed point. The others are mostly zero in good documents; where none
#: of the nearest repeats lines or words, a share of 22 % of them rejects on its own (0.12 ** 2 * 15.09).
UNIT = 1024
FLOORS = {"length": 0.0003, "word_chars": 0.0003, "symbols": 0.1, "lines": 0.12, "repeats": 0.12}
P = len(FLOORS)
Q = [f"q{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
HALF, REWEIGHT, REJECT = 0.5, 0.975, 0.99
PRIOR_ROWS, BINS_PER_OCTAVE, LEAST_GAIN, MAX_STEPS = 50, 16, 0.01, 40
BROADCAST_GROUPS = 50_000
USED = ["mean", "inverse"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_cdf(x: float, k: int) -> float:
    """For odd k."""
    total, half = math.erf(math.sqrt(x / 2)), x / 2
    for i in range(1, k, 2):
        total -= half ** (i / 2) * math.exp(-half) / math.gamma(i / 2 + 1)
    return total


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What makes the covariance of the nearest ``share`` of normal rows that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, n_lines and base_failed."""
    rest = [c for c in docs.columns if c not in {*BASE, "base_failed", "n_lines"}]
    text = F.coalesce("text", F.lit(""))
    first = docs.select(*rest, words("text").alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"),
                        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    second = first.select(
        *rest, "n_symbols", F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    known = [*rest, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    third = second.select(*known, F.when(F.col("n_words") >= RUN, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - RUN).cast("int")),
        lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(RUN))))).alias("_g"))
    # only texts in which some window repeats go on to the sorting
    fourth = third.select(*known, F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(
        F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("_s"))
    twin = lambda x, k: F.coalesce(x["g"] == F.get("_s", k - 1)["g"], F.lit(False)) | F.coalesce(
        x["g"] == F.get("_s", k + 1)["g"], F.lit(False))
    fifth = fourth.select(*known, F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["i"])).alias("_at"))
    spans = F.transform("_at", lambda s, k: F.least(F.lit(RUN), F.coalesce(F.get("_at", k + 1) - s, F.lit(RUN))))
    repeated = F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return fifth.select(*known, repeated.alias("n_repeat_words")).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with the transformed statistics in fixed point: q0 to q4."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = [F.log1p("n_words"), F.least(F.col("word_chars") / n, F.lit(1000.0)), F.log1p(100 * F.col("n_symbols") / chars),
              F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]
    return stats.withColumns({q: F.round(v * UNIT).cast("long") for q, v in zip(Q, values)})


def _keys() -> list[Column]:
    """The keys of a row's language and of its language and source; JSON tells null from any text."""
    return [F.concat(F.lit("language "), F.to_json(F.struct("lang"))), F.to_json(F.struct("lang", "source"))]


def _inverted(est: DataFrame, keep: list[str], mean: list[Column], cov: dict[tuple[int, int], Column]) -> DataFrame:
    """keep, n, the mean, the covariance (a flat symmetric matrix), its negated inverse by the sweep operator, its log-determinant."""
    flat = F.array(*(cov[max(i, j), min(i, j)].cast("double") for i in range(P) for j in range(P)))
    floors = F.array(*(F.lit(f ** 2 * UNIT ** 2) for f in FLOORS.values()))

    def sweep(acc, k):
        cell = lambda i, j: F.get(acc["m"], (i * P + j).cast("int"))
        # a lifted pivot adds to its own variance only
        d = F.greatest(cell(k, k), F.get(floors, k))

        def swept(x, at):
            i, j = F.floor(at / P), at % P
            return (F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), x / d)
                    .otherwise(x - cell(i, k) * cell(k, j) / d))
        return F.struct(F.transform(acc["m"], swept).alias("m"), (acc["logdet"] + F.log(d)).alias("logdet"))

    out = est.select(*keep, "n", F.array(*(m.cast("double") for m in mean)).alias("mean"), flat.alias("cov"))
    out = out.withColumn("swept", F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), F.struct(
        F.col("cov").alias("m"), F.lit(0.0).alias("logdet")), sweep))
    return out.select(*keep, "n", "mean", "cov", F.col("swept.m").alias("inverse"), F.col("swept.logdet").alias("logdet"))


def _estimate(sums: DataFrame, factor: float, keep: list[str]) -> DataFrame:
    """From n, the rows k summed and their sums: mean, covariance times ``factor`` with variances of their floors at least."""
    k = F.col("k")
    mean = [F.col(f"s{i}").cast("double") / k for i in range(P)]
    floors = [f ** 2 * UNIT ** 2 for f in FLOORS.values()]
    cov = {(i, j): (F.col(f"s{i}_{j}").cast("double") / k - mean[i] * mean[j]) * factor for i, j in PAIRS}
    cov |= {(i, i): F.greatest(cov[i, i], F.lit(f)) for i, f in enumerate(floors)}
    return _inverted(sums, keep, mean, cov)


def _distance() -> Column:
    """Squared Mahalanobis distance of q0.. from ``mean`` by the negated ``inverse``."""
    off = [F.col(q) - F.col("mean")[i] for i, q in enumerate(Q)]
    return F.greatest(-sum((F.col("inverse")[i * P + j] * off[i] * off[j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0)), F.lit(0.0))


def _moments() -> list[Column]:
    return [F.count("*").alias("k"), *(F.sum(q).alias(f"s{i}") for i, q in enumerate(Q)),
            *(F.sum(F.col(Q[i]) * F.col(Q[j])).alias(f"s{i}_{j}") for i, j in PAIRS)]


def _added() -> list[Column]:
    return [F.sum("k").alias("k"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(P)),
            *(F.sum(F.col(f"s{i}_{j}").cast("decimal(38,0)")).alias(f"s{i}_{j}") for i, j in PAIRS)]


def _beside(rows: DataFrame, est: DataFrame, on: list[str], groups: int) -> DataFrame:
    """Rows beside their groups' estimates: broadcast up to a number of groups, else joined with hot groups split."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(est), on)
    salts = est.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*Q, F.rand(1)), F.lit(64)).cast("int")).join(salts, [*on, "salt"]).drop("salt")


def _median_starts(rows: DataFrame) -> DataFrame:
    """Start 0: medians and interquartile ranges, from histograms."""
    width = UNIT // 64
    bins = (rows.select("key", F.posexplode(F.array(*Q)).alias("i", "q")).groupBy("key", "i", F.floor(F.col("q") / width).alias("bin"))
            .agg(F.count("*").alias("c")))
    upto = Window.partitionBy("key", "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.select("key", "i", "bin", F.sum("c").over(upto).alias("cum"), F.sum("c").over(Window.partitionBy("key", "i")).alias("n"))
    at = lambda p: F.min(F.when(F.col("cum") >= p * F.col("n"), F.col("bin"))) * width + width / 2
    wide = ranked.groupBy("key", "n").pivot("i", list(range(P))).agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    cov = {(i, j): F.greatest(F.col(f"{i}_s") ** 2, F.lit((f * UNIT) ** 2)) if i == j else F.lit(0.0) for i, f in enumerate(FLOORS.values()) for j in range(i + 1)}
    return _inverted(wide.withColumn("start", F.lit(0)), ["key", "start"], [F.col(f"{i}_m") for i in range(P)], cov)


def fit(stats: DataFrame) -> DataFrame:
    """Estimates per (language, source), drawn towards their language's: key, n, mean, cov, inverse, logdet. ``stats`` is best a stored table."""
    spark: SparkSession = stats.sparkSession
    rows = vectors(stats).select(F.explode(F.array(*_keys())).alias("key"), *Q)
    plain = rows.groupBy("key").agg(*_moments()).withColumn("n", F.col("k"))
    starts = _median_starts(rows).unionByName(_estimate(plain.withColumn("start", F.lit(1)), 1.0, ["key", "start"]))
    # no subset's determinant yet, so the first step always counts
    est, at = stored(starts.withColumn("logdet", F.lit(float("inf"))).withColumn("lower", F.lit(True)), "mcd-start")
    groups = est.count()

    def step(est: DataFrame) -> DataFrame:
        near = _beside(rows, est.select("key", "start", "n", *USED), ["key"], groups)
        octave = F.floor(F.log2(_distance() + 1e-9) * BINS_PER_OCTAVE).cast("int")
        bins = near.groupBy("key", "start", "n", octave.alias("bin")).agg(*_moments())
        before = Window.partitionBy("key", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        nearest = bins.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).where(
            F.col("before") < F.floor((F.col("n") + P + 1) * HALF))
        return _estimate(nearest.groupBy("key", "start", "n").agg(*_added()), consistency(HALF), ["key", "start"])

    for _ in range(MAX_STEPS):
        was = est.select("key", "start", *(F.col(c).alias(f"was_{c}") for c in est.columns if c not in ("key", "start")))
        lower = F.col("logdet") < F.col("was_logdet") - LEAST_GAIN
        new, path = stored(step(est).join(was, ["key", "start"]).select("key", "start", lower.alias("lower"), *(
            F.when(lower, F.col(c)).otherwise(F.col(f"was_{c}")).alias(c) for c in est.columns if c not in ("key", "start", "lower"))), "mcd-step")
        forget(spark, at)
        est, at = new, path
        if new.where("lower").isEmpty():
            break

    best = est.groupBy("key").agg(F.min_by(F.struct("n", *USED), F.struct("logdet", "start")).alias("e")).select("key", "e.*")
    inside = _beside(rows, best.select("key", "n", *USED), ["key"], groups).where(_distance() <= chi2_quantile(REWEIGHT, P))
    final, _ = stored(_estimate(inside.groupBy("key", "n").agg(*_moments()), consistency(REWEIGHT), ["key"]), "mcd-final")
    forget(spark, at)
    return _with_prior(stats, final)


def _with_prior(stats: DataFrame, final: DataFrame) -> DataFrame:
    of_lang, of_both = _keys()
    pairs = stats.select(of_both.alias("key"), of_lang.alias("lang_key")).distinct()
    prior = final.select(F.col("key").alias("lang_key"), F.col("mean").alias("p_mean"), F.col("cov").alias("p_cov"))
    joined = pairs.join(final.select("key", "n", "mean", "cov"), "key").join(prior, "lang_key")
    mix = lambda c, i: (F.col("n") * F.col(c)[i] + PRIOR_ROWS * F.col(f"p_{c}")[i]) / (F.col("n") + PRIOR_ROWS)
    return _inverted(joined, ["key"], [mix("mean", i) for i in range(P)], {(i, j): mix("cov", i * P + j) for i, j in PAIRS})


def judge(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """``stats`` with the squared distance and ``kept``."""
    columns = [c for c in stats.columns if c not in ("distance", "kept")]
    rows = vectors(stats.select(*columns)).withColumn("key", _keys()[1])
    near = _beside(rows, estimates.select("key", *USED), ["key"], estimates.count())
    distance = _distance()
    # one comparison: as two conditions, a filter on it would be pushed into the array functions and multiply them
    verdict = distance + F.when(F.col("base_failed"), F.lit(float("inf"))).otherwise(0.0) <= chi2_quantile(REJECT, P)
    return near.select(*columns, distance.alias("distance"), verdict.alias("kept"))


def stored_statistics(docs: DataFrame) -> DataFrame:
    return stored(base_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "statistics")[0]


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents kept, with their own columns; texts are read twice and never shuffled."""
    estimates, _ = stored(fit(stored_statistics(docs)), "estimates")
    return judge(base_statistics(docs), estimates).where("kept").select(*docs.columns)
