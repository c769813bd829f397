"""The pipeline's stages against plain versions on the smallest table."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as c
from llm.test_jaccard import plain as groups
from llm.test_phrase_index import plain as hits
from vecspark.llm import outliers
from vecspark.llm.common import stored
from vecspark.llm.pieces import tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in c.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), name)[0])
    raw, good, lined, single, clean, tokens = seen
    assert all(x.columns == COLUMNS for x in seen[:-1])
    stats = outliers.stored_statistics(raw)
    verdicts = outliers.judge(stats, outliers.fit(stats)).where("kept")
    assert ids(good) == ids(verdicts) and 0 < good.count() < raw.count()
    # lines: each long enough key stays in its first document only
    key = lambda x: "".join(chr(ord(h) + 32) if "A" <= h <= "Z" else h for h in x.strip(" \t\n\x0b\f\r"))
    before = {r.doc_id: r.text for r in good.collect()}
    first: dict = {}
    for i in sorted(before):
        for line in before[i].split("\n"):
            first.setdefault(key(line), i)
    want = {i: "\n".join(x for x in text.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, text in before.items()}
    after = {r.doc_id: r.text for r in lined.collect()}
    assert after == want and {r.doc_id: r.n_chars for r in lined.collect()} == {i: len(x) for i, x in want.items()}
    kept = sorted(i for i, _, component in groups(list(after.items()), 5, 80, 100) if i == component)
    assert ids(single) == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in single.collect()}
    assert ids(clean) == sorted(i for i, _, n, *_ in hits(list(left.items()), items, 10) if not n)
    encode = tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode
    for r in tokens.collect():
        found = encode(left[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()
    assert ids(tokens) == ids(clean)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_clashing_columns(spark):
    """Columns that a stage uses for itself keep their values, in rows that stay."""
    extra = ["body", "n_lines", "n_dropped", "keep_words", "kept", "n_words", "distance", "base_failed", "key", "h", "id", "a"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, name in enumerate(extra):
        docs = docs.withColumn(name, F.col("doc_id") * 100 + i)
    for name, stage in c.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)[0]
        assert out.columns == docs.columns and out.count() > 50, name
        wrong = F.lit(False)
        for i, column in enumerate(extra):
            wrong = wrong | (F.col(column) != F.col("doc_id") * 100 + i)
        assert out.where(wrong).isEmpty(), name


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "777")
    try:
        c.bpe(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
        c.jaccard_join(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
        assert spark.conf.get(key) == "777"
    finally:
        spark.conf.set(key, before)
