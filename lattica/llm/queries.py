"""The driver's queries for the operators of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import alignment, bpe, decontaminate, exact_dedup, html_extract, langid, line_dedup, near_dedup, quality, tool_calls, toxicity, txlog, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_tool_calls(*tool_calls.from_conversations(_table(spark, sf_dir, "conversations")))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.from_pages(_table(spark, sf_dir, "pages")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("in_history")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def op12_transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txlog.reassemble(txlog.from_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_html_extraction, op3_tool_calls, op4_warc_revisits, op5_exact_dedup, op6_toxicity, op7_quality, op8_bpe, op9_near_dedup, op10_langid, op11_alignment, op12_transaction_log, op13_line_dedup)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op3_tool_calls": """
WITH calls AS (
  SELECT conv_id, 'call-' || conv_id || '-' || turn AS call_id, turn AS seq, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, text, role,
    CASE WHEN role = 'user' AND turn >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS dep,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position
  FROM conversations WHERE role IN ('user', 'system')),
results AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, turn AS seq, text AS content FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'system')),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.seq, r.seq) AS seq, c.name, c.position, c.text, c.role, c.dep, c.seq AS call_seq, r.content, c.call_id IS NOT NULL AS is_call, r.call_id IS NOT NULL AS is_result,
    c.dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.call_id = c.dep) AS lost
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, seq, name,
  CASE WHEN NOT is_call THEN 'orphan_result' WHEN is_result THEN 'linked' ELSE 'no_result' END AS status,
  position, is_call AND text IS NOT NULL AND NOT lost AS valid,
  CASE WHEN NOT is_call THEN 'orphan result' ELSE concat_ws('; ', CASE WHEN text IS NULL THEN CASE WHEN role = 'user' THEN 'missing: prompt' ELSE 'missing: instructions' END END, CASE WHEN lost THEN 'dependency: ' || dep END) END AS errors,
  '{' || CASE WHEN NOT is_call THEN '' WHEN role = 'user' THEN '"arguments":{' || coalesce('"prompt":' || to_json(text)::VARCHAR || ',', '') || '"turn":' || call_seq || '},' ELSE '"arguments":{' || coalesce('"instructions":' || to_json(text)::VARCHAR, '') || '},' END
    || '"depends_on":[' || coalesce('"' || dep || '"', '') || '],"id":"' || call_id || '"' || coalesce(',"name":"' || name || '"', '') || coalesce(',"result":' || to_json(content)::VARCHAR, '') || '}' AS record
FROM linked""",
    "op4_warc_revisits": r"""
WITH page AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size, url,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)(\?[^#]*)?', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_extract(url, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(substr(regexp_extract(url, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS q
  FROM pages),
p AS (SELECT page_id, digest, size, '"' || substr(digest, 1, 16) || '"' AS etag, CASE WHEN regexp_matches(url, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://') THEN base || CASE WHEN q <> '' THEN '?' || q ELSE '' END ELSE trim(url) END AS canonical_url FROM page),
revisit AS (SELECT page_id * 2 + 1 AS record_id, canonical_url, page_id + 500 AS seen_at, digest, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"outdated"' ELSE etag END AS etag FROM p),
hit AS (SELECT record_id, max(b.page_id) AS page_id FROM revisit a JOIN p b ON a.canonical_url = b.canonical_url AND b.page_id < a.seen_at GROUP BY record_id),
found AS (SELECT a.record_id, a.canonical_url, a.seen_at, b.page_id, b.digest, b.size, b.etag,
    CASE WHEN b.page_id IS NULL THEN 'no earlier response' WHEN a.etag IS NOT NULL THEN CASE WHEN a.etag = b.etag THEN 'etag' ELSE 'etag differs' END WHEN a.digest = b.digest THEN 'digest' ELSE 'digest differs' END AS reason
  FROM revisit a LEFT JOIN hit USING (record_id) LEFT JOIN p b ON hit.page_id = b.page_id)
SELECT record_id, canonical_url, page_id * 2 AS response_id, reason IN ('etag', 'digest') AS resolved, reason, CASE WHEN reason IN ('etag', 'digest') THEN digest END AS digest,
  CASE WHEN reason IN ('etag', 'digest') THEN '{"cache-control":"max-age=60","content-length":"' || size || '","content-type":"text/html","date":"t' || seen_at || '","etag":' || to_json(etag)::VARCHAR || '}' END AS headers
FROM found""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = max(doc_id) OVER w, max(doc_id) OVER w IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_near_dedup": rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b AS doc_id, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op12_transaction_log": """
WITH crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
crc AS MATERIALIZED (SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL), crc_table),
log AS MATERIALIZED (
  SELECT doc_id AS seq, source AS src, h % 23 AS r, (h // 100) % 300 AS key, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN text END AS text
  FROM documents JOIN crc ON s = doc_id::VARCHAR),
txns AS (SELECT *, coalesce(sum((r <= 2)::INT) OVER (PARTITION BY src ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn FROM log),
walks AS (SELECT *, sum(CASE WHEN r IN (3, 4) THEN 1 WHEN r IN (5, 6) THEN -1 ELSE 0 END) OVER (PARTITION BY src, txn ORDER BY seq) AS walk FROM txns),
depths AS (SELECT *, walk - least(0, min(walk) OVER (PARTITION BY src, txn ORDER BY seq)) AS depth FROM walks),
levels AS (SELECT *, CASE WHEN r IN (5, 6) THEN coalesce(lag(depth) OVER (PARTITION BY src, txn ORDER BY seq), 0) ELSE depth END AS level,
  max(CASE WHEN r <= 2 THEN seq END) OVER (PARTITION BY src, txn) AS ended, max(CASE WHEN r <= 2 THEN r END) OVER (PARTITION BY src, txn) AS how FROM depths),
fate AS MATERIALIZED (SELECT * FROM (SELECT *, min(CASE WHEN r IN (5, 6) THEN seq END) OVER (PARTITION BY src, txn, level ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS undone FROM levels) WHERE r > 6),
done AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 4 + 1 AS epoch FROM log WHERE r <= 1),
alive AS (SELECT epoch, done.seq AS committed, fate.seq, key, text FROM fate JOIN done ON undone IS NULL AND how <= 1 AND ended = done.seq),
last_writes AS (SELECT * FROM alive QUALIFY row_number() OVER (PARTITION BY epoch, key ORDER BY committed DESC, seq DESC) = 1),
marks AS MATERIALIZED (SELECT epoch, key, CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(key || ':' || text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS mark FROM last_writes, crc_table),
moves AS (SELECT epoch, (mark IS NOT NULL)::BIGINT - (lag(mark) OVER w IS NOT NULL)::BIGINT AS dn, coalesce(mark, 0) - coalesce(lag(mark) OVER w, 0) AS dv FROM marks WINDOW w AS (PARTITION BY key ORDER BY epoch))
SELECT 'state' AS kind, epoch AS id, (sum(n) OVER (ORDER BY epoch))::BIGINT AS n, (sum(v) OVER (ORDER BY epoch))::BIGINT AS value
FROM (SELECT epoch, coalesce(sum(dn), 0) AS n, coalesce(sum(dv), 0) AS v FROM (SELECT DISTINCT epoch FROM done) LEFT JOIN moves USING (epoch) GROUP BY epoch)
UNION ALL SELECT CASE WHEN undone IS NOT NULL THEN 'rollback' ELSE 'abort' END, seq, coalesce(undone, ended), key::BIGINT FROM fate WHERE undone IS NOT NULL OR how IS NULL OR how = 2""",
    "op13_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id""",
}
