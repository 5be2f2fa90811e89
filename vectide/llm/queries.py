"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, hnsw, jaccard, mixing, quality, sharding, tokenout, tokens, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_hnsw_dedup": hnsw.query,
    "op3_jaccard_join": jaccard.query,
    "op4_token_counts": tokens.query,
    "op5_token_binary": tokenout.query,
    "op6_decontamination": decontaminate.query,
    "op7_quality": quality.query,
    "op8_mixing": mixing.query,
    "op9_sharding": sharding.query,
    "op10_warc": warc.query,
}

_REACHED = """reached(id, other) AS (
  SELECT id, id FROM ids
  UNION
  SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a),
components AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)"""

_OP2 = f"""WITH RECURSIVE good AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
ids AS (SELECT vec_id AS id FROM embeddings),
{_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM components"""

_OP3 = f"""WITH RECURSIVE worded AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded),
flat AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.id AS a, b.id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ids AS (SELECT id FROM sets),
{_REACHED}
SELECT id AS doc_id, len(s) AS n_shingles, component_id FROM components JOIN sets USING (id)"""

# a schedule of runs of groups of one size: of all places (load, shard) that the groups of a run could start at, the lowest
_OP9 = """WITH RECURSIVE crcs AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, sha256(coalesce(text, '')) AS g,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)::BIGINT AS text_crc32
  FROM documents, crcs),
groups AS (SELECT g, sum(size)::BIGINT AS bytes FROM docs GROUP BY g),
runs AS (SELECT bytes, count(*)::BIGINT AS k, row_number() OVER (ORDER BY bytes DESC) AS run FROM groups GROUP BY bytes),
steps(run, bytes, took, loads) AS (
  SELECT 0::BIGINT, 0::BIGINT, list_transform(range(16), lambda i: 0::BIGINT), list_transform(range(16), lambda i: 0::BIGINT)
  UNION ALL
  SELECT run, bytes, took, list_transform(range(1, 17), lambda i: loads[i] + took[i] * bytes) FROM (
    SELECT run, bytes, loads, list_transform(range(1, 17), lambda i: len(list_filter(lowest, lambda p: p.shard = i))::BIGINT) AS took FROM (
      SELECT r.run, r.bytes, s.loads,
        list_sort(flatten(list_transform(range(1, 17), lambda i: list_transform(range(r.k), lambda j: {'load': s.loads[i] + j * r.bytes, 'shard': i}))))[1:r.k] AS lowest
      FROM steps s JOIN runs r ON r.run = s.run + 1))),
placed AS (
  SELECT g, len(list_filter(range(1, 17), lambda i: list_sum(took[1:i]) <= rank))::INT AS shard
  FROM (SELECT g, bytes, row_number() OVER (PARTITION BY bytes ORDER BY g) - 1 AS rank FROM groups) JOIN steps USING (bytes))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM docs JOIN placed USING (g)"""

_OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
bits AS (
  SELECT page_id, first, octet_length(encode(html))::BIGINT AS payload_bytes,
    array_to_string(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS b FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(b, 5 * i + j + 1, 1)::INT << (4 - j)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits"""

SQL: dict[str, str] = {"op2_hnsw_dedup": _OP2, "op3_jaccard_join": _OP3, "op9_sharding": _OP9, "op10_warc": _OP10}
