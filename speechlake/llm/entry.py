"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm import byte_bpe, jaccard_join, lm, packing, ranked_search, simhash, subword, suffix_dedup, token_counts, topk, toxicity, turn_repair, url_filter
from speechlake.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_of(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.encode(table(spark, sf_dir, "documents"), digest=True)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_of(table(spark, sf_dir, "documents"))


def simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block tables: classes of equal fingerprints within three bits of documents whose id is divisible by 20."""
    return simhash.neighbours(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_document_fingerprints, op3_lm_scoring, op4_ngram_jaccard_join, op5_sentencepiece, op6_url_filters, op7_toxicity, op8_packing, op9_token_counts, op10_topk, op11_conversation_repair, op12_ranked_search, op13_byte_bpe, simhash_neighbours)}

_BLOCKED = ", ".join(f"'{x[:-1]}'" for x in url_filter.BLOCKLIST)

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
f AS (SELECT s, min(doc_id::HUGEINT * 4294967296 + i) AS f FROM p GROUP BY s HAVING count(*) > 1),
r AS (SELECT p.doc_id, p.i FROM p JOIN f ON p.s = f.s WHERE p.doc_id::HUGEINT * 4294967296 + p.i <> f.f),
b AS (SELECT doc_id, unnest(range(length(h) // 2)) AS j, unnest(regexp_extract_all(h, '..')) AS x FROM d),
c AS (SELECT b.doc_id, b.j, x, coalesce(max(r.i) OVER (PARTITION BY b.doc_id ORDER BY b.j) >= b.j - 99, false) AS gone FROM b LEFT JOIN r ON b.doc_id = r.doc_id AND b.j = r.i),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS starts FROM c),
o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, coalesce(string_agg(x, '' ORDER BY j) FILTER (WHERE NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o ON d.doc_id = o.doc_id""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id FROM (SELECT doc_id, list(g ORDER BY g) AS l FROM s GROUP BY doc_id))
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(k.class_id, w.doc_id) AS class_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op6_url_filters": rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN path LIKE '/%' AND EXISTS (SELECT 1 FROM (SELECT unnest([{_BLOCKED}]) AS b) WHERE host = b OR host LIKE '%.' || b) THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_conversation_repair": r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT i, list_reduce([i::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) x(i)),
tab AS MATERIALIZED (SELECT list(t ORDER BY i) AS t FROM crc),
lot AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS lot FROM raw, tab),
dmg AS (
  SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM lot, range(2) c(copy) WHERE lot <> 0 AND (copy = 0 OR lot = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM dmg),
rep AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth, regexp_replace(text, '[ \x09-\x0D]+$', '') AS kept, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM num),
f AS MATERIALIZED (
  SELECT coalesce(conv_id::VARCHAR, '') AS c, turn, n, role, text, CASE WHEN kept = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(kept, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault,
         n > 1 AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM rep),
s AS (SELECT c, n, role[1] AS r, fault IN ('b', 'd') AS must, CASE fault WHEN 't' THEN 5 ELSE 0 END AS p FROM f),
grown AS (
  SELECT c, 0::BIGINT AS n, {'k': 0::BIGINT, 'a': ''} AS g0, {'k': 1000000::BIGINT, 'a': ''} AS g1, {'k': 5::BIGINT, 'a': 'I'} AS g2, {'k': 10::BIGINT, 'a': 'II'} AS g3 FROM (SELECT DISTINCT c FROM f)
  UNION ALL
  SELECT c, n, h0, h1,
         list_min([h2, {'k': h0.k + 5, 'a': h0.a || 'I'}, {'k': h1.k + 5, 'a': h1.a || 'I'}, {'k': h3.k + 5, 'a': h3.a || 'I'}]),
         list_min([h3, {'k': h2.k + 5, 'a': h2.a || 'I'}, {'k': h0.k + 10, 'a': h0.a || 'II'}, {'k': h1.k + 10, 'a': h1.a || 'II'}])
  FROM (
    SELECT g.c, s.n, {'k': g0.k + 2, 'a': g0.a || 'D'} AS h0,
           list_min([{'k': g1.k + 2, 'a': g1.a || 'D'}, {'k': g0.k + p + CASE WHEN must OR r <> 's' THEN 1000000 ELSE 0 END, 'a': g0.a || 'K'}]) AS h1,
           list_min(list_concat([{'k': g2.k + 2, 'a': g2.a || 'D'}], list_concat(
             list_transform([g0, g1, g3], lambda g: {'k': g.k + p + CASE WHEN must OR r <> 'u' THEN 1000000 ELSE 0 END, 'a': g.a || 'K'}),
             list_transform([g0, g1, g3], lambda g: {'k': g.k + 1 + p + CASE WHEN must THEN 1000000 ELSE 0 END, 'a': g.a || 'R'})))) AS h2,
           list_min([{'k': g3.k + 2, 'a': g3.a || 'D'}, {'k': g2.k + p + CASE WHEN must OR r <> 'a' THEN 1000000 ELSE 0 END, 'a': g2.a || 'K'}, {'k': g2.k + 1 + p + CASE WHEN must THEN 1000000 ELSE 0 END, 'a': g2.a || 'R'}]) AS h3
    FROM grown g JOIN s ON s.c = g.c AND s.n = g.n + 1)),
best AS (SELECT c, list_min([g0, g3]) AS b FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC) AS last FROM grown) WHERE last = 1),
letters AS (SELECT c, b.a[j] AS e, j, count(*) FILTER (WHERE b.a[j] <> 'I') OVER w AS n, count(*) FILTER (WHERE b.a[j] <> 'D') OVER w AS o, length(replace(b.a, 'D', '')) AS size
            FROM (SELECT c, b, unnest(range(1, length(b.a) + 1)) AS j FROM best) WINDOW w AS (PARTITION BY c ORDER BY j)),
lines AS (
  SELECT l.c, string_agg(CASE WHEN e = 'K' THEN role WHEN (o + size) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines
  FROM letters l LEFT JOIN f ON f.c = l.c AND f.n = l.n WHERE e <> 'D' GROUP BY l.c),
sums AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM f GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.k, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) LEFT JOIN sums USING (c) LEFT JOIN best USING (c) LEFT JOIN lines USING (c)""",
    "op12_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
g AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS all_terms FROM d WHERE len(ts) > 0),
m AS (SELECT doc_id, ts, 25 + (75 * len(ts) * n_docs) // all_terms AS m FROM d, g WHERE len(ts) > 0),
p AS (SELECT doc_id, m, t, count(*) AS tf FROM (SELECT doc_id, m, unnest(ts) AS t FROM m) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY t, n_docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}
