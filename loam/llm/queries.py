"""The corpus operators' queries, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.llm import common, exact_dedup, hard_negatives, katz, line_dedup, media, mixing, pieces, repair, sharding, simhash, toxicity, url_filter, warc


def op1_sharding(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    return sharding.shard(docs, "doc_id", "text").withColumnRenamed("row_id", "doc_id")


def op2_katz(spark, sf_dir):
    return katz.score_documents(common.read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(common.read(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    planned = mixing.plan(common.read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_url_filter(spark, sf_dir):
    return url_filter.judge(common.read(spark, sf_dir, "pages"))


def op6_warc(spark, sf_dir):
    path = common.new_path(spark, "warc")
    warc.write(common.read(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path, with_payload=False).where("kind = 'record'")
    return records.select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        warc.page_of("refers_to").alias("refers_to"),
    )


def op7_toxicity(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_media(spark, sf_dir):
    shown = media.documents_with_media(common.read(spark, sf_dir, "documents"))
    return shown.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op9_pieces(spark, sf_dir):
    return pieces.round_trips(common.read(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.near_groups(common.read(spark, sf_dir, "documents"))


def op11_repair(spark, sf_dir):
    turns = common.read(spark, sf_dir, "conversations")
    return repair.repair(turns, repair.damaged(turns))


def op12_line_dedup(spark, sf_dir):
    kept = line_dedup.deduplicated(common.read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(common.read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_katz": op2_katz,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_media": op8_media,
    "op9_pieces": op9_pieces,
    "op10_simhash": op10_simhash,
    "op11_repair": op11_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op1_sharding": """
WITH coded AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) * 1073741824
         + (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT >> 2) AS h
  FROM documents),
levels AS (SELECT doc_id, bytes, h, d.depth, h >> (60 - d.depth) AS prefix
           FROM coded, (SELECT unnest(range(0, 61)) AS depth) d),
totals AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
           FROM levels GROUP BY depth, prefix),
leaf AS (
  SELECT l.doc_id, l.bytes, l.h, l.depth, l.prefix, t.shard_bytes, t.shard_rows,
         row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS k
  FROM levels l JOIN totals t ON l.depth = t.depth AND l.prefix = t.prefix
  WHERE t.shard_bytes <= 1048576 OR t.shard_rows <= 1 OR l.depth = 60)
SELECT doc_id, bytes::BIGINT AS bytes,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
       depth::INT AS depth, shard_bytes, shard_rows, shard_bytes <= 1048576 AS fits
FROM leaf WHERE k = 1""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS text_md5,
         row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1 AS number
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight,
             3 * source_size AS bound FROM s),
r AS (
  SELECT *, bound / weight AS ratio,
         ((sum(source_size) OVER ())::BIGINT
          - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / ((sum(weight) OVER ())::BIGINT
          - coalesce(sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS level
  FROM w),
l AS (SELECT min_by(level, ratio) AS level FROM r WHERE level <= ratio),
t AS (SELECT source, source_size, least(bound::DOUBLE, l.level * weight) AS target FROM r, l),
c AS (
  SELECT d.doc_id, d.size, d.text_md5, d.number, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, ''), text_md5, number)), 1, 8))::BIGINT / 4294967296.0
                                        < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""",
    "op5_url_filter": r"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM a),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
s AS (
  SELECT page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path) GROUP BY page_id),
m(name, pattern) AS (VALUES ('gambling', '^(.*[.])?casino-[a-z0-9]+[.]'), ('pharmacy', '^(.*[.])?[a-z0-9]+-pills[.]'),
  ('spam farm', '[.]spam-farm[.]|^spam-farm[.]'), ('tracker', '^(.*[.])?ads-track\.example\.'), ('adult', '/adult/|-adult[.]')),
b AS (SELECT page_id, max_by(name, length(pattern)) AS pattern_rule FROM p JOIN m ON regexp_matches(p.host || p.path, m.pattern) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, s.rule,
       coalesce(s.verdict, CASE WHEN b.pattern_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN s.rule IS NULL THEN b.pattern_rule END AS pattern_rule
FROM p LEFT JOIN s USING (page_id) LEFT JOIN b USING (page_id)""",
    "op6_warc": """
WITH h AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + (((('0x' || substr(hex, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM h),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k""",
    "op11_repair": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(turn::VARCHAR, ' ') AS t, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
  FROM conversations),
coded AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv || ':' || t, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fault
  FROM raw),
turns AS (
  SELECT conv, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, (SELECT unnest([1, 2]) AS copy) c WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM turns),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS times, left(role, 1) AS c FROM numbered),
marked AS (
  SELECT conv, turn, role, text, i, c, bare = '' OR times > 1 AS gone,
         bare = '' AS blank, bare <> '' AND times > 1 AS duplicate,
         bare <> '' AND times = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(c) OVER (PARTITION BY conv ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM marked GROUP BY conv),
steps AS (  -- the least (cost, audit) of each state before turn i, insertions included: empty, s, u, a
  SELECT conv, 1::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS e, {'c': 1000000000::BIGINT, 'a': ''} AS s,
         {'c': 3::BIGINT, 'a': 'I'} AS u, {'c': 6::BIGINT, 'a': 'II'} AS a FROM counts
  UNION ALL
  SELECT conv, i, e, s, u1, list_min([a0, {'c': u1.c + 3, 'a': u1.a || 'I'}]) FROM (
    SELECT *, list_min([u0, {'c': e.c + 3, 'a': e.a || 'I'}, {'c': s.c + 3, 'a': s.a || 'I'}, {'c': a0.c + 3, 'a': a0.a || 'I'}]) AS u1 FROM (
      SELECT p.conv, p.i + 1 AS i,
        {'c': p.e.c + 4, 'a': p.e.a || 'D'} AS e,
        list_min([{'c': p.s.c + 4, 'a': p.s.a || 'D'}, {'c': p.e.c + CASE WHEN m.c = 's' AND NOT m.gone THEN cut ELSE 1000000000 END, 'a': p.e.a || 'K'}]) AS s,
        list_min([{'c': p.u.c + 4, 'a': p.u.a || 'D'}] || list_transform([p.e, p.s, p.a], lambda x: list_min([
          {'c': x.c + CASE WHEN m.c = 'u' AND NOT m.gone THEN cut ELSE 1000000000 END, 'a': x.a || 'K'},
          {'c': x.c + CASE WHEN NOT m.gone THEN cut + 3 ELSE 1000000000 END, 'a': x.a || 'R'}]))) AS u0,
        list_min([{'c': p.a.c + 4, 'a': p.a.a || 'D'},
          {'c': p.u.c + CASE WHEN m.c = 'a' AND NOT m.gone THEN cut ELSE 1000000000 END, 'a': p.u.a || 'K'},
          {'c': p.u.c + CASE WHEN NOT m.gone THEN cut + 3 ELSE 1000000000 END, 'a': p.u.a || 'R'}]) AS a0
      FROM steps p JOIN (SELECT *, CASE WHEN truncated THEN 3 ELSE 0 END AS cut FROM marked) m ON p.conv = m.conv AND p.i = m.i))),
best AS (SELECT s.conv, list_min([s.e, s.a]) AS b FROM steps s JOIN counts k ON s.conv = k.conv AND s.i = k.n + 1),
letters AS (SELECT conv, b.c AS cost, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS k FROM best),
edits AS (
  SELECT conv, audit, k, audit[k] AS edit, length(replace(audit[:k], 'I', '')) AS i, length(replace(audit[:k], 'D', '')) AS o FROM letters),
written AS (
  SELECT d.conv, d.o, d.edit, m.role, m.text, m.c,
         max(CASE WHEN d.o = 1 AND d.edit = 'K' AND m.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv) AS lead
  FROM edits d LEFT JOIN marked m ON d.conv = m.conv AND d.i = m.i AND d.edit <> 'I' WHERE d.edit <> 'D'),
repaired AS (
  SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY o) AS text
  FROM written GROUP BY conv)
SELECT r.conv_id, coalesce(k.gaps, 0)::BIGINT AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate,
       coalesce(k.truncated, 0) AS truncated, coalesce(k.illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost, coalesce(b.b.a, '') AS audit,
       sha256(coalesce(p.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM raw) r LEFT JOIN counts k USING (conv) LEFT JOIN best b USING (conv) LEFT JOIN repaired p USING (conv)""",
    "op12_line_dedup": r"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT s.*, c.keeper IS NOT NULL AND c.keeper <> s.doc_id AS dropped FROM keyed s LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
