"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

OP1 = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(n.t) AS text_sha256, CAST(strlen(n.t) AS BIGINT) AS n_bytes
FROM n JOIN g ON n.t = g.t
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size) / weight AS cap_rate FROM s
), f AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY cap_rate, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (
  SELECT arg_min(level, cap_rate) AS rate FROM f WHERE level * weight <= cap
), t AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no,
         coalesce(least(cap::DOUBLE, rate * weight), cap::DOUBLE) AS target FROM f, r
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.source_no, CAST(floor(t.target) AS BIGINT) AS quota,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id), d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT source_no, CAST(floor(target) AS BIGINT) AS quota, CAST(ceil(floor(target) / 256) AS BIGINT) AS need,
         CAST(sum(floor(target)) OVER (ORDER BY source_no) - floor(target) AS BIGINT) AS lo, CAST(sum(floor(target)) OVER () AS BIGINT) AS total, count(*) OVER () AS sources
  FROM t
), p AS (
  SELECT n AS slot, (h - floor(h)) + (l - floor(l)) AS y, total FROM (
    SELECT n, total, CAST(n >> 20 AS DOUBLE) * 0.6077874097973108::DOUBLE AS h, CAST(n & 1048575 AS DOUBLE) * 0.6180339887498949::DOUBLE AS l
    FROM (SELECT total, unnest(range(CAST(ceil(total / 256) AS BIGINT))) AS n FROM (SELECT DISTINCT total FROM b)))
), m AS (
  SELECT slot, source_no, need, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, (y - floor(y)) * CAST(total AS DOUBLE) AS place FROM p) JOIN b ON place >= lo AND place < lo + quota
), k AS (
  SELECT slot, source_no, rank FROM m WHERE rank < need
  UNION ALL
  SELECT CAST(ceil(total / 256) AS BIGINT) - 1 + (rank - have) * sources + source_no, source_no, rank
  FROM (SELECT *, unnest(range(have, need)) AS rank FROM (SELECT b.*, (SELECT count(*) FROM m WHERE m.source_no = b.source_no) AS have FROM b) WHERE have < need)
), w AS (
  SELECT o.*, q, begins + q * source_size AS place FROM o, (VALUES (0), (1)) AS v(q) WHERE size > 0 AND begins + q * source_size < quota
), e AS (
  SELECT source_no, begins, min(k.slot) AS first_slot, count(DISTINCT k.slot) AS n_slots
  FROM (SELECT *, unnest(range(place // 256, (least(place + size, quota) - 1) // 256 + 1)) AS rank FROM w) JOIN k USING (source_no, rank) GROUP BY ALL
)
SELECT doc_id, size, source_size, target,
       greatest(0, least(o.begins + size, quota) - o.begins) + greatest(0, least(source_size + o.begins + size, quota) - source_size - o.begins) AS taken,
       CASE WHEN size > 0 THEN first_slot END AS first_slot, CASE WHEN size > 0 THEN coalesce(n_slots, 0) ELSE 0 END AS n_slots
FROM o LEFT JOIN e USING (source_no, begins)
"""

ORACLES = {"op1_exact_dedup": OP1, "op5_mix_sources": OP5}
