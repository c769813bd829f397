"""A distributed positional inverted index, for benchmark decontamination.

The index holds a posting (term, doc_id, body, pos) for each occurrence of an
indexed term, with the words right before and after it, range-partitioned and
sorted by term and document. A phrase search takes the two rarest terms of each
phrase, shifts their posting lists by the terms' places in the phrase,
intersects them on (document, start), and compares the words around what is
left, so common terms' lists are never read. A proximity search starts from
each group's rarest term in the same way.

Terms that no search starts from need no postings: ``build_index`` takes the
terms to index. They travel to the scan as broadcasts of at most ``ROUND_TERMS``
rows; more terms take more scans.

Words: A-Z is lower-cased, all ASCII but digits and letters separates.

Defined cases: null and empty texts have no words; rows that repeat a doc_id
are documents of their own, told apart by the hash of their text, and equal
rows get equal results; a null doc_id is kept; an item without an id marks
words but is not listed; items without words match nothing; extra columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecspark.llm.common import NOT_WORD, ascii_lower, stored, words

WINDOW = 10
ROUND_TERMS = 500_000
_DOC = ["doc_id", "body"]


def _words() -> Column:
    return words(ascii_lower("text"), NOT_WORD)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("body"), _words().alias("words"))


def _rounds(terms: DataFrame):
    """The terms in parts small enough to broadcast; a term has at most as many bytes as a document."""
    n = -(-terms.count() // ROUND_TERMS) or 1
    return [F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i)) for i in range(n)]


def _union(frames):
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents of the terms that occur at all."""
    tokens = docs.select(F.explode(_words()).alias("term"))
    return _union([tokens.join(part, "term").groupBy("term").agg(F.count("*").alias("n")) for part in _rounds(terms)])


def build_index(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """Stores and returns the postings of ``terms`` (distinct) with up to ``reach`` words of context on either side."""
    tokens = _documents(docs).select(*_DOC, "words", F.posexplode("words").alias("pos", "term"))
    # the context is cut in the same generated code as the join, so no row carries its whole document
    postings = _union([
        tokens.join(part, "term").select(
            "term", *_DOC, "pos",
            F.array_join(F.slice("words", F.greatest(F.col("pos") - (reach - 1), F.lit(1)), F.least(F.col("pos"), F.lit(reach))), " ").alias("before"),
            F.array_join(F.slice("words", F.col("pos") + 2, F.lit(reach)), " ").alias("after"))
        for part in _rounds(terms)])
    order = ["term", "doc_id", "body", "pos"]
    return stored(postings.repartitionByRange(*order).sortWithinPartitions(*order), "postings")[0]


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, phrase) of every run of ``size`` words of an item, or of all its words where they are fewer."""
    found = items.select("item_id", _words().alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))))
    return (found.select("item_id", "words", starts.alias("at"))
            .select("item_id", F.array_join(F.slice("words", F.col("at") + 1, F.lit(size)), " ").alias("phrase")).distinct())


def phrase_anchors(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases whose terms all occur, with their two rarest terms r1, r2 at places o1, o2 (the same for one word)."""
    placed = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("place", "term"))
    ranked = (placed.join(counts, "term").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("r"))
              .withColumn("terms", F.split("phrase", " ")).where(F.size("r") == F.size("terms")))
    second = F.get("r", F.least(F.size("r") - 1, F.lit(1)))
    o1 = F.col("r")[0]["place"]
    return ranked.select(
        "phrase", F.xxhash64("phrase").alias("pid"), F.size("terms").alias("length"),
        F.col("r")[0]["term"].alias("r1"), o1.alias("o1"), second["term"].alias("r2"), second["place"].alias("o2"),
        F.array_join(F.slice("terms", F.lit(1), o1), " ").alias("lead"),
        F.array_join(F.slice("terms", o1 + 2, F.size("terms")), " ").alias("tail"))


def find_phrases(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, body, start, length, phrase) of every exact occurrence."""
    first = (index.withColumnRenamed("term", "r1").join(anchors, "r1")
             .select("pid", "phrase", "length", "lead", "tail", "before", "after", *_DOC, (F.col("pos") - F.col("o1")).alias("start")))
    second = (index.select(F.col("term").alias("r2"), *_DOC, "pos").join(anchors.select("r2", "o2", "pid"), "r2")
              .select("pid", *_DOC, (F.col("pos") - F.col("o2")).alias("start")))
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, (F.col("a.pid") == F.col("b.pid")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
                  & (F.col("a.body") == F.col("b.body")) & (F.col("a.start") == F.col("b.start")), "left_semi")
    lead_fits = (F.col("lead") == "") | F.concat(F.lit(" "), "before").endswith(F.concat(F.lit(" "), "lead"))
    tail_fits = (F.col("tail") == "") | F.concat("after", F.lit(" ")).startswith(F.concat("tail", F.lit(" ")))
    return both.where(lead_fits & tail_fits).select(*_DOC, "start", "length", "phrase")


def find_near(index: DataFrame, groups: DataFrame, counts: DataFrame, span: int) -> DataFrame:
    """(doc_id, body, group_id, start): stretches of ``span`` words that hold all ``terms`` of a group.

    From each posting of the group's rarest term, every other posting within
    reach fits a range of stretches; one that all distinct terms fit is a match.
    """
    terms = groups.select("group_id", F.explode(F.array_distinct("terms")).alias("term"))
    ranked = terms.join(counts, "term").groupBy("group_id").agg(
        F.min_by("term", F.struct("n", "term")).alias("rare"), F.count("*").alias("found")).join(
        groups.select("group_id", F.size(F.array_distinct("terms")).alias("size")), "group_id").where("found = size")
    rare = index.join(ranked.select("group_id", "size", F.col("rare").alias("term")), "term").select(
        "group_id", "size", *_DOC, F.col("pos").alias("anchor"))
    others = index.join(terms, "term").select("group_id", F.col("doc_id").alias("d"), F.col("body").alias("b"), "term", "pos")
    near = rare.join(others, "group_id").where(
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")) & (F.abs(F.col("pos") - F.col("anchor")) < span))
    starts = F.explode(F.expr(f"sequence(greatest(pos, anchor, {span - 1}) - {span - 1}, least(pos, anchor))"))
    return (near.select("group_id", "size", *_DOC, "anchor", "term", starts.alias("start")).distinct()
            .groupBy("group_id", "size", *_DOC, "anchor", "start").agg(F.count("*").alias("n")).where("n = size")
            .select(*_DOC, "group_id", "start").distinct())


def find_items(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The occurrences of item windows in documents, and the windows (item_id, phrase)."""
    docs = docs.select("doc_id", "text")
    listed, _ = stored(windows(items, size), "item-windows")
    phrases = listed.select("phrase").distinct()
    vocabulary = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    counts, _ = stored(term_counts(docs, vocabulary), "term-counts")
    anchors, _ = stored(phrase_anchors(phrases, counts), "anchors")
    starting = anchors.select(F.explode(F.array("r1", "r2")).alias("term")).distinct()
    return stored(find_phrases(build_index(docs, starting, size - 1), anchors), "phrase-hits")[0], listed


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, body) of the documents that hold an item window."""
    return find_items(docs, items, size)[0].select(*_DOC).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, body, n_words, n_hit, n_items, items): every row of ``docs``, its words inside item windows, the items found."""
    found, listed = find_items(docs, items, size)
    stretches = found.select(*_DOC, "start", "length").distinct()
    earlier = Window.partitionBy(*_DOC).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("start") + F.col("length") - F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("length")).over(earlier), F.lit(0)))
    hits = stretches.select(*_DOC, F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy(*_DOC).agg(F.sum("fresh").alias("n_hit"))
    items_of = (found.select(*_DOC, "phrase").join(listed, "phrase").groupBy(*_DOC)
                .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    marks = hits.join(items_of.withColumnsRenamed({"doc_id": "d", "body": "b"}),
                      F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b"))).select(*_DOC, "n_hit", "items")
    left, right = _documents(docs).select(*_DOC, F.size("words").cast("long").alias("n_words")).alias("l"), marks.alias("r")
    return left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.body").eqNullSafe(F.col("r.body")), "left").select(
        "l.doc_id", "l.body", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
