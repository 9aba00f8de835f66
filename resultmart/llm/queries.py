"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resultmart.llm.alignment import digest_of_groups, score_links
from resultmart.llm.bpe import decode, encode
from resultmart.llm.common import read, scratch
from resultmart.llm.divergence import audit_sources
from resultmart.llm.exact_dedup import exact_duplicates
from resultmart.llm.line_dedup import dedup_lines
from resultmart.llm.metric_join import embedding_links
from resultmart.llm.near_dup import near_duplicates
from resultmart.llm.packing import pack
from resultmart.llm.quality import fit_quality, score_quality
from resultmart.llm.sentence import decode_pieces, encode_pieces
from resultmart.llm.sharding import shard
from resultmart.llm.token_file import crc32_of_ids, read_tokens, write_tokens
from resultmart.llm.warc import resolve_revisits

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Most text of a shard.
SHARD_BYTES = 1 << 20
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=0)
    return read_tokens(spark, path).mapInArrow(crc32_of_ids, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read(spark, sf_dir, "embeddings"))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels"))).drop("text")


def captures(pages: DataFrame) -> DataFrame:
    """Records of an archive as the pages imply them: a full response for each page, a minute apart, and a revisit some hours before or after it with the page's entity tag."""
    page = pages.select("page_id", "url", F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"')).alias("etag"), F.octet_length("html").cast("string").alias("size"), (F.col("page_id") * 60).alias("at"))
    shift = (F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("long") % 7 - 2) * 3600 + 30
    full = page.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("at").alias("captured"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), "size", F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), "etag").alias("headers"))
    again = page.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("at") + shift).alias("captured"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.create_map(F.lit("Cache-Control"), F.lit("no-cache"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), (F.col("at") + shift).cast("string"), F.lit("ETag"), F.concat(F.lit("W/"), "etag")).alias("headers"))
    return full.unionByName(again)


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(read(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value)))
    return found.withColumn("headers", F.array_join(lines, "; "))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), WORD_BPE, end_id=1, length=2048)
    kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    return pieces.select(*kept, "ids").mapInArrow(crc32_of_ids, ", ".join(f"{x} long" for x in [*kept, "ids_crc32"]))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(encode(read(spark, sf_dir, "documents"), WORD_BPE), WORD_BPE)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_pieces(encode_pieces(read(spark, sf_dir, "documents"), PIECES), PIECES)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_links(read(spark, sf_dir, "documents"), BYTE_BPE, PIECES, digest_of_groups(BYTE_BPE, PIECES), "groups_sha256 string")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_file, op2_extendible_sharding, op3_line_dedup, op4_metric_join, op5_quality_gam, op6_revisits, op7_exact_dedup, op8_ngram_jaccard, op9_hilbert_packing, op10_bpe, op11_sentence_pieces, op12_alignment, op13_source_audit)}

ORACLES = {
    "op2_extendible_sharding": f"""
WITH h AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS hash FROM documents
), bucket AS (
  SELECT d::INT AS depth, hash >> (48 - d)::INT AS bits, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM h, range(0, 49) r(d) GROUP BY 1, 2
)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(bits), 48, '0'), depth) END AS prefix, 0::BIGINT AS part, shard_bytes, shard_docs
FROM h JOIN bucket ON bits = hash >> (48 - depth)
WHERE shard_bytes <= {SHARD_BYTES}
QUALIFY depth = min(depth) OVER (PARTITION BY doc_id)
""",
    "op4_metric_join": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE isfinite(c) AND c >= 0.9
), reach(vec_id, hit) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, l.y FROM reach JOIN l ON l.x = reach.hit),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1), c AS (SELECT vec_id, min(hit) AS component_id FROM reach GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id
""",
    "op6_revisits": r"""
WITH u AS (
  SELECT page_id, '"' || substr(md5(html), 1, 16) || '"' AS etag, strlen(html) AS size, page_id * 60 AS at,
    (('0x' || substr(md5(url), 1, 4))::BIGINT % 7 - 2) * 3600 + 30 AS shift, regexp_replace(trim(url), '#.*$', '') AS url
  FROM pages
), p AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS asked
  FROM u
), c AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS canonical_url FROM p
), f AS (
  SELECT r.page_id * 2 + 1 AS record_id, r.canonical_url, r.at + r.shift AS captured, r.etag, s.page_id * 2 AS response_id, s.at AS response_captured, s.etag AS stored, s.size
  FROM c r ASOF LEFT JOIN c s ON r.canonical_url = s.canonical_url AND r.at + r.shift > s.at
)
SELECT record_id, canonical_url, captured, response_id, response_captured,
  CASE WHEN response_id IS NULL THEN 'missing' WHEN etag = stored THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN etag = stored THEN 'cache-control: no-cache; content-length: ' || size || '; content-type: text/html; date: ' || captured || '; etag: W/' || etag END AS headers
FROM f
""",
    "op3_line_dedup": r"""
WITH line AS (
  SELECT doc_id, pos, l.line, translate(regexp_replace(l.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) l
), shared AS (
  SELECT k, min(doc_id) AS first_id FROM line WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT line.*, coalesce(doc_id <> first_id, false) AS gone FROM line LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
reach(doc_id, hit) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON l.x = reach.hit)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(hit) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY 1
""",
    "op13_source_audit": r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), kept AS MATERIALIZED (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 10
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) t ON t.lang = g.lang AND t.source = g.source
), p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), q AS (
  SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (sum(l.n) + 2)) // (any_value(w.total) + 2 * any_value(w.v)) AS q
  FROM p l JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY 1) w ON w.lang = l.lang GROUP BY 1, 2
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), everyone AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), term AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM everyone UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 10
""",
}
