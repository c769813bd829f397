"""URL verdicts by listed hosts and path prefixes, behind a blocked Bloom filter.

A rule (host, path, action) fits its host and all subdomains where the path
starts with the rule's; the longest fitting rule decides. For each distinct
url, the host suffixes and path prefixes that some rule could list are its
canonical keys; the filter of the listed keys drops nearly all of them, and an
exact hash join with the list removes the false hits. What no rule fits is
allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; ports and user names are part of the host as it stands;
repeated rows get the same verdict; of a rule listed twice with different
actions, block wins; an empty list allows everything; extra columns are left
out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vecspark.llm import bloom
from vecspark.llm.common import ascii_lower


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2), F.lit(""))


def _shape(rules: DataFrame) -> tuple[int, list[int]]:
    """The most labels of a listed host, and the lengths of listed paths (bounded by the length of a url)."""
    row = rules.agg(F.max(F.size(F.split("host", "\\."))), F.collect_set(F.char_length("path"))).first()
    return row[0] or 0, sorted(row[1])


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    host, path = url_parts()
    most, lengths = _shape(rules)
    rules = rules.select("host", "path", "action").distinct().withColumn("h", F.xxhash64("host", "path"))
    listed = pages.sparkSession.sparkContext.broadcast(bloom.build(rules, "h"))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(listed.value.might_contain(h.to_numpy(dtype=np.int64)))

    labels = F.split("host", "\\.")
    urls = pages.select("url").where("url IS NOT NULL").distinct().select("url", host.alias("host"), path.alias("path"))
    suffixes = urls.select("url", "path", F.posexplode(labels).alias("at", "label"), labels.alias("labels")).where(
        F.size("labels") - F.col("at") <= most).select(
        "url", "path", F.array_join(F.slice("labels", F.col("at") + 1, F.size("labels")), ".").alias("host"))
    keys = suffixes.select("url", "host", "path", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast(
        "array<int>")).alias("n")).where("n <= char_length(path)").select(
        "url", "host", F.expr("left(path, n)").alias("path"))
    hits = keys.withColumn("h", F.xxhash64("host", "path")).where(possible("h"))
    best = (hits.join(rules, ["h", "host", "path"]).groupBy("url").agg(F.max(F.struct(
        (F.char_length("host") + F.char_length("path")).alias("n"), (F.col("action") == "block").alias("block"),
        F.concat("host", "path").alias("rule"), "action")).alias("best"))
        .select("url", "best.rule", F.col("best.action").alias("verdict")))
    return pages.select("page_id", "url").join(best, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
