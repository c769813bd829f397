"""Exact line dedup across documents, as keep bitmaps beside the documents.

A line's key is the line without white space at its ends, A-Z lower-cased. Of a
key of at least ``min_chars`` code points found in two documents or more, only
the lines in the smallest doc_id stay.

Lines travel as 128-bit hashes with document and position, never as text. They
are range-partitioned on (hash, document, position) and sorted so, which also
cuts the run of one very frequent line over many tasks; a sorted pass keeps the
first document of every hash, combined per task before the shuffle.

Defined cases: null or empty text is one empty line; a null doc_id neither
drops lines nor makes others drop; rows that repeat a doc_id count as one
document; extra columns are carried through unless they clash with the columns
added, which win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vecspark.llm.common import SPACE_CHARS, ascii_lower, stored

MIN_CHARS = 10
_ID = ["doc_id", "body"]


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n")


def line_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, body, pos) of every long enough line, in sorted runs; ``body`` tells rows of one doc_id apart."""
    lines = (docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("body"),
                                                     F.posexplode(_lines()).alias("pos", "line"))
             .select(*_ID, "pos", ascii_lower(F.btrim("line", F.lit(SPACE_CHARS))).alias("key"))
             .where(F.char_length("key") >= min_chars)
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *_ID, "pos"))
    order = ["h1", "h2", "doc_id", "pos"]
    return lines.repartitionByRange(*order).sortWithinPartitions(*order)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document that loses lines: (doc_id, body, keep_words, n_dropped).

    ``keep_words`` holds the 64-line words of the bitmap in which some line
    goes, as (word, bits); a word left out keeps all its lines.
    """
    runs, _ = stored(line_runs(docs, min_chars), "line-runs")
    firsts = (runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
              .where("first_doc < last_doc").select("h1", "h2", "first_doc"))
    gone = runs.join(firsts, ["h1", "h2"]).where("doc_id > first_doc").select(*_ID, "pos").distinct()
    word = (gone.groupBy(*_ID, F.expr("pos DIV 64").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")).alias("bits"), F.count("*").alias("n")))
    return word.groupBy(*_ID).agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep_words"),
        F.sum("n").alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with ``text`` reduced to the kept lines, and n_lines, n_dropped."""
    left = docs.drop("n_lines", "n_dropped", "keep_words", "body")
    rest = [c for c in left.columns if c != "text"]
    joined = (left.withColumn("body", F.xxhash64("text")).join(bitmaps, _ID, "left")
              .select(*rest, "text", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep_words",
                      _lines().alias("_lines")))
    gone = F.flatten(F.transform("keep_words", lambda w: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit(w["bits"], i) == 0, w["word"] * 64 + i)),
        lambda p: p.isNotNull())))
    size = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), (size - 1).cast("long")), gone)
    # two uses of _lines keep the optimizer from moving the split into the function below
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i.cast("int"))), "\n")
    return joined.select(*rest, F.when(F.col("keep_words").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
                         .alias("text"), size.cast("long").alias("n_lines"), "n_dropped").select(
        *left.columns, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars))
