"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vecspark.llm import (chunk_bpe, collocations, jaccard, lines, merge_replay, outliers, phrase_index, prefix_trie, token_count, token_files,
                          toxicity, url_filter, warc)
from vecspark.llm.common import stored, table
from vecspark.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op3_token_files")
def op3(spark, sf_dir):
    out = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.digests(spark, out)


@query("op1_outliers")
def op1(spark, sf_dir):
    stats = outliers.stored_statistics(table(spark, sf_dir, "documents"))
    estimates, _ = stored(outliers.fit(stats), "estimates")
    return outliers.judge(stats, estimates).select("doc_id", *outliers.BASE, "base_failed", "kept", "distance")


_ITEM_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


@query("op2_phrase_index", f"""
WITH i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
 iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, p0, p0 + 9), ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p0 FROM i WHERE len(w) > 0)),
 d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
 dw AS (SELECT doc_id, p0, k, array_to_string(list_slice(w, p0, p0 + k - 1), ' ') AS phrase
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p0 FROM d, (SELECT DISTINCT k FROM iw))),
 hit AS (SELECT doc_id, p0, dw.k, item_id FROM dw JOIN iw USING (phrase)),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(p0, p0 + k)) AS p FROM hit) GROUP BY doc_id),
 its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op2(spark, sf_dir):
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS digest FROM pages),
 g AS (SELECT b, max(page_id) AS keeper FROM p WHERE octet_length(b) >= 1000 GROUP BY b)
SELECT p.page_id, octet_length(p.b)::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g ON p.b = g.b""")
def op4(spark, sf_dir):
    out = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), out)
    return warc.read_archives(spark, out)


@query("op5_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 l AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
 s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM l),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
       GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id
FROM l JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) USING (doc_id)""")
def op5(spark, sf_dir):
    return jaccard.link_components(table(spark, sf_dir, "documents"), 3, 90, 100)


@query("op6_chunk_bpe")
def op6(spark, sf_dir):
    return chunk_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op7_url_filter", rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
 r(rhost, rpath, action) AS (VALUES {', '.join(map(str, RULES))}),
 f AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS verdict
       FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""")
def op7(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(*toxicity.sample(docs, labels, fold != 0))
    return toxicity.score_documents(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")


@query("op9_token_count")
def op9(spark, sf_dir):
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


@query("op10_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
       GROUP BY key HAVING count(DISTINCT doc_id) > 1),
 g AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id > f.first_doc AS gone
       FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id""")
def op10(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_merge_replay")
def op11(spark, sf_dir):
    return merge_replay.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
 c AS (SELECT lang, phrase, size, count(*) AS f FROM (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2),
         lambda i: array_to_string(list_slice(ws, i, i + size - 1), ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) s(size)
         WHERE len(ws) >= size) GROUP BY ALL),
 t AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE size = 1 GROUP BY lang),
 cut AS (SELECT lang, phrase, size, f AS a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head,
         array_to_string(list_slice(string_split(phrase, ' '), k + 1, size), ' ') AS tail
         FROM c, (VALUES (1), (2)) k(k) WHERE f >= 10 AND k < size),
 s AS (SELECT cut.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
       FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = head JOIN c y ON y.lang = cut.lang AND y.phrase = tail),
 m AS (SELECT lang, phrase, size, a, arg_min(struct_pack(l := l, r := r, score := score), score * 4 + k) AS m FROM s GROUP BY ALL),
 longer AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, a, unnest([array_to_string(list_slice(string_split(phrase, ' '), 1, 2), ' '),
         array_to_string(list_slice(string_split(phrase, ' '), 2, 3), ' ')]) AS phrase FROM m WHERE size = 3) GROUP BY ALL),
 ranked AS (SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY m.m.score DESC, a DESC, m.phrase) AS rank, m.phrase, a,
         m.m.l AS l, m.m.r AS r, m.m.score AS score FROM m LEFT JOIN longer ON m.lang = longer.lang AND m.phrase = longer.phrase
         WHERE around IS NULL OR 100 * around < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000""")
def op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", """
WITH x AS (SELECT conv_id, length(coalesce(text, '')) AS chars, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS d,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) AS pos
   FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list(struct_pack(d := d, chars := chars) ORDER BY pos) AS turns FROM x GROUP BY conv_id),
 h AS (SELECT *, CASE WHEN conv_id % 100 = 0 THEN 0 ELSE xor(list_reduce(encode(conv_id::VARCHAR)::VARCHAR.string_split(''),
   lambda c, b: list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(c, ascii(b)::BIGINT)),
   4294967295::BIGINT), 4294967295) % 6 END AS h FROM o),
 r AS (SELECT h.conv_id, coalesce(list_slice(b.turns, 1, h.h), []) || list_slice(h.turns, h.h + 1, len(h.turns)) AS turns
   FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
 p AS (SELECT conv_id, turns, list_transform(turns, lambda t: t.d) AS ds, len(turns) AS total FROM r),
 e AS (SELECT conv_id, total, depth, list_slice(ds, 1, depth) AS key, CASE WHEN depth > 0 THEN turns[depth].chars ELSE 0 END AS chars
   FROM (SELECT *, unnest(range(0, total + 1)) AS depth FROM p)),
 n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256 FROM e GROUP BY key, depth),
 c AS (SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
 f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (key)),
 s AS (SELECT list_slice(key, 1, up) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
   FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s USING (key) LEFT JOIN n q ON f.depth > 0 AND q.key = list_slice(f.key, 1, f.depth - 1)""")
def op13(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
