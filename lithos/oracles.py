"""DuckDB SQL for the registered queries."""

ORACLES = {
    "scan_all": """
SELECT o_orderkey AS entity_id FROM orders
""",
    "scan_multi_archetype": """
SELECT 'customer' AS archetype, c_custkey AS entity_id, c_acctbal AS acctbal FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier
""",
    "scan_optional_component": """
SELECT 'customer' AS archetype, c_custkey AS entity_id, c_mktsegment AS mktsegment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, CAST(NULL AS VARCHAR(20)) FROM supplier
""",
    "get_batch_order_dups": """
SELECT r.pos AS pos, p.p_size AS p_size FROM (SELECT 0 AS pos, 5 AS k UNION ALL SELECT 1, 5 UNION ALL SELECT 2, -1 UNION ALL SELECT 3, 1) r
LEFT JOIN part p ON p.p_partkey = r.k
""",
    "filter_eq": """
SELECT o_orderkey AS entity_id FROM orders WHERE o_orderpriority = '1-URGENT'
""",
    "filter_range_halfopen": """
SELECT p_partkey AS entity_id FROM part WHERE p_size >= 10 AND p_size < 20
""",
    "filter_range_unbounded": """
SELECT p_partkey AS entity_id FROM part WHERE p_size > 40
""",
    "filter_multi_and": """
SELECT o_orderkey AS entity_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_totalprice > 1000
""",
    "filter_custom_column": """
SELECT l_orderkey AS order_id, l_linenumber AS line FROM lineitem WHERE l_quantity * 2 > 60 AND l_returnflag <> 'N'
""",
    "filter_custom_cross_entity": """
SELECT o_orderkey AS entity_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_acctbal < 0
""",
    "spatial_within": """
SELECT vec_id AS entity_id FROM embeddings WHERE (CAST(embedding[1] AS DOUBLE) - 0.1) * (CAST(embedding[1] AS DOUBLE) - 0.1) + CAST(embedding[2] AS DOUBLE) * CAST(embedding[2] AS DOUBLE) <= 0.01
""",
    "spatial_intersects": """
SELECT vec_id AS entity_id FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) BETWEEN -0.1 AND 0.1 AND CAST(embedding[2] AS DOUBLE) BETWEEN 0.0 AND 0.2
""",
    "join_inner_presence": """
SELECT d.doc_id AS entity_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""",
    "join_left_noop": """
SELECT d.doc_id AS entity_id FROM documents d
""",
    "join_batched_columns": """
SELECT d.doc_id AS entity_id, d.n_chars AS n_chars, l.quality AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id
""",
    "join_inner_filtered": """
SELECT d.doc_id AS entity_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND d.lang = 'en'
""",
    "er_inner": """
SELECT o_orderkey AS entity_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
""",
    "er_left_noop": """
SELECT o_orderkey AS entity_id FROM orders
""",
    "er_dead_reference": """
SELECT o_orderkey AS entity_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
""",
    "er_chained": """
SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS supp FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)
""",
    "er_multi_hop": """
SELECT c_custkey AS entity_id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2))
""",
    "agg_all": """
SELECT CAST(COUNT(*) AS DOUBLE) AS cnt, SUM(l_quantity) AS sum_qty, MIN(l_quantity) AS min_qty, MAX(l_quantity) AS max_qty, ROUND(AVG(l_quantity), 6) AS avg_qty FROM lineitem
""",
    "agg_filtered": """
SELECT CAST(COUNT(*) AS DOUBLE) AS cnt, ROUND(SUM(o_totalprice), 2) AS sum_price FROM orders WHERE o_orderstatus = 'F'
""",
    "agg_empty": """
SELECT CAST(COUNT(*) AS DOUBLE) AS cnt, COALESCE(SUM(l_quantity), 0.0) AS sum_qty FROM lineitem WHERE l_quantity < 0
""",
    "agg_partial_presence": """
SELECT CAST(COUNT(*) AS DOUBLE) AS cnt, CAST(SUM(seg_len) AS DOUBLE) AS sum_seg_len
FROM (SELECT LENGTH(c_mktsegment) AS seg_len FROM customer UNION ALL SELECT CAST(NULL AS BIGINT) FROM supplier) t
""",
    "agg_er_join": """
SELECT CAST(COUNT(*) AS DOUBLE) AS cnt, ROUND(SUM(o_totalprice), 2) AS sum_price FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
""",
    "changed_archetype_granular": """
SELECT event_id AS entity_id FROM events WHERE event_type IN
(SELECT event_type FROM events GROUP BY event_type HAVING MAX(ts) > TIMESTAMP '2024-01-30 23:28:00')
""",
    "changed_row_granular": """
SELECT event_id AS entity_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00'
""",
    "subscription_eq_changed": """
SELECT event_id AS entity_id FROM events WHERE event_type = 'purchase' AND event_type IN
(SELECT event_type FROM events GROUP BY event_type HAVING MAX(ts) > TIMESTAMP '2024-01-15 00:00:00')
""",
    "debounce_hash": """
SELECT event_id AS entity_id FROM (SELECT event_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) t
WHERE prev IS NULL OR prev <> event_type
""",
    "retention_after_10": """
SELECT p_partkey AS entity_id, p_size - 10 AS remaining FROM part WHERE p_size > 10
""",
    "changeset_fold": """
SELECT user_id AS entity_id, event_id AS last_seq FROM (SELECT user_id, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t
WHERE rn = 1 AND event_type <> 'error'
""",
    "wal_replay_from": """
SELECT user_id AS entity_id, MAX(event_id) AS last_seq FROM events WHERE event_id >= 500 GROUP BY user_id
""",
    "lsm_compact_newest_wins": """
SELECT event_type AS archetype, user_id AS entity_id, event_id AS row_id FROM (SELECT event_type, user_id, event_id, ROW_NUMBER() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 4 DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1
""",
    "blob_orphans": """
SELECT DISTINCT url AS blob_key FROM pages WHERE page_id % 5 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 <> 0)
""",
    "metrics_archetypes": """
SELECT 'customer' AS archetype, COUNT(*) AS entity_count FROM customer UNION ALL SELECT 'supplier', COUNT(*) FROM supplier UNION ALL SELECT 'part', COUNT(*) FROM part
""",
    "move_wrap": """
SELECT s_suppkey AS entity_id, ROUND(s_acctbal + COS(s_nationkey) * 10 - FLOOR((s_acctbal + COS(s_nationkey) * 10) / 500) * 500, 4) AS pos_x FROM supplier
""",
    "worm_metabolism": """
SELECT p_partkey AS entity_id, GREATEST(p_size - 5, 0) AS energy, CASE WHEN GREATEST(p_size - 5, 0) < 20 THEN CAST(0.9 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS worm_size FROM part
""",
    "life_step": """
WITH g AS (SELECT ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS i, p_size % 2 = 0 AS alive FROM part),
d AS (SELECT MAX(i) + 1 AS n FROM g),
c AS (SELECT i, i % 10 AS x, CAST(FLOOR(i / 10) AS BIGINT) AS y, alive FROM g),
o AS (SELECT a.dx AS dx, b.dy AS dy FROM (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) a CROSS JOIN (SELECT -1 AS dy UNION ALL SELECT 0 UNION ALL SELECT 1) b WHERE NOT (a.dx = 0 AND b.dy = 0)),
k AS (SELECT c.i AS i, c.alive AS alive, ((c.y + o.dy + CAST(FLOOR(d.n / 10) AS BIGINT)) % CAST(FLOOR(d.n / 10) AS BIGINT)) * 10 + ((c.x + o.dx + 10) % 10) AS j FROM c CROSS JOIN o CROSS JOIN d)
SELECT k.i AS entity_id, CASE WHEN SUM(CASE WHEN t.alive THEN 1 ELSE 0 END) = 3 OR (MAX(CASE WHEN k.alive THEN 1 ELSE 0 END) = 1 AND SUM(CASE WHEN t.alive THEN 1 ELSE 0 END) = 2) THEN 1 ELSE 0 END AS alive
FROM k JOIN c t ON t.i = k.j GROUP BY k.i
""",
    "torus_radius": """
SELECT entity_id FROM (SELECT s_suppkey AS entity_id, ABS(s_acctbal - FLOOR(s_acctbal / 500) * 500 - 5) AS ax, ABS(s_suppkey % 500 - 5) AS ay FROM supplier) t
WHERE LEAST(ax, 500 - ax) * LEAST(ax, 500 - ax) + LEAST(ay, 500 - ay) * LEAST(ay, 500 - ay) <= 10000
""",
    "neighbours_within": """
WITH p AS (SELECT s_suppkey AS id, s_acctbal - floor(s_acctbal / 500) * 500 AS x, CAST(s_suppkey % 500 AS DOUBLE) AS y FROM supplier),
d AS (
  SELECT a.id AS entity_id, b.id AS other, least(abs(a.x - b.x), 500 - abs(a.x - b.x)) AS dx, least(abs(a.y - b.y), 500 - abs(a.y - b.y)) AS dy
  FROM p a JOIN p b ON a.id <> b.id)
SELECT entity_id, other, round(dx * dx + dy * dy, 4) AS d2 FROM d WHERE dx * dx + dy * dy <= 400
""",
    "worm_step": """
WITH w AS (SELECT p_partkey AS entity_id, p_partkey * 7.0::DOUBLE - floor(p_partkey * 7.0::DOUBLE / 500) * 500 AS x, p_size / 8.0::DOUBLE AS h, least(greatest(p_size / 100.0::DOUBLE, 0.1), 1.0) AS step FROM part),
m AS (SELECT entity_id, x + cos(h) * step AS x, 1.0 + sin(h) * step AS y FROM w)
SELECT entity_id, round(x - floor(x / 500) * 500, 4) AS pos_x, round(y - floor(y / 500) * 500, 4) AS pos_y FROM m
""",
    "gravity_step": """
WITH b AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey * 19.5::DOUBLE AS x, n_regionkey * 97.0::DOUBLE AS y, 1.0::DOUBLE + n_regionkey AS m FROM nation),
p AS (SELECT a.id, c.m, c.x - a.x AS dx0, c.y - a.y AS dy0 FROM b a JOIN b c ON a.id <> c.id),
d AS (SELECT id, m, dx0 - 500 * round(dx0 / 500) AS dx, dy0 - 500 * round(dy0 / 500) AS dy FROM p),
f AS (SELECT id, sum(m * dx / power(dx * dx + dy * dy + 1, 1.5)) * 0.1::DOUBLE AS vx, sum(m * dy / power(dx * dx + dy * dy + 1, 1.5)) * 0.1::DOUBLE AS vy FROM d GROUP BY id),
s AS (SELECT b.id, b.x + f.vx * 0.1::DOUBLE AS x, b.y + f.vy * 0.1::DOUBLE AS y, f.vx, f.vy FROM b JOIN f USING (id))
SELECT id AS entity_id, round(x - floor(x / 500) * 500, 6) AS pos_x, round(y - floor(y / 500) * 500, 6) AS pos_y,
  CASE WHEN round(vx, 6) = 0 THEN 0.0::DOUBLE ELSE round(vx, 6) END AS vel_x, CASE WHEN round(vy, 6) = 0 THEN 0.0::DOUBLE ELSE round(vy, 6) END AS vel_y FROM s
""",
    "boids_step": """
WITH b AS (
  SELECT s_suppkey AS id, s_acctbal - floor(s_acctbal / 500) * 500 AS x, s_suppkey * 37.5::DOUBLE - floor(s_suppkey * 37.5::DOUBLE / 500) * 500 AS y,
    cos(s_nationkey) AS vx, sin(s_nationkey) AS vy FROM supplier),
p AS (SELECT a.id, c.vx AS ovx, c.vy AS ovy, c.x - a.x AS dx0, c.y - a.y AS dy0 FROM b a JOIN b c ON a.id <> c.id),
q AS (SELECT id, ovx, ovy, dx0 - 500 * round(dx0 / 500) AS dx, dy0 - 500 * round(dy0 / 500) AS dy FROM p),
d AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM q WHERE dx * dx + dy * dy >= 0.000001 AND dx * dx + dy * dy < 2500),
m AS (
  SELECT id, avg(-dx / (d * d)) FILTER (WHERE d < 25) AS sx, avg(-dy / (d * d)) FILTER (WHERE d < 25) AS sy,
    avg(ovx) AS ax, avg(ovy) AS ay, avg(dx) AS cx, avg(dy) AS cy FROM d GROUP BY id),
f AS (
  SELECT b.*, coalesce(sx, 0) * 1.5::DOUBLE + coalesce(ax - vx, 0) + coalesce(cx, 0) AS fx, coalesce(sy, 0) * 1.5::DOUBLE + coalesce(ay - vy, 0) + coalesce(cy, 0) AS fy
  FROM b LEFT JOIN m USING (id)),
a AS (SELECT *, CASE WHEN sqrt(fx * fx + fy * fy) > 0.5 THEN 0.5::DOUBLE / sqrt(fx * fx + fy * fy) ELSE 1.0::DOUBLE END AS k FROM f),
v AS (SELECT id, x, y, vx + fx * k AS vx, vy + fy * k AS vy FROM a),
w AS (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy) > 4 THEN 4::DOUBLE / sqrt(vx * vx + vy * vy) ELSE 1.0::DOUBLE END AS k FROM v),
s AS (SELECT id, vx * k AS vx, vy * k AS vy, x + vx * k AS x, y + vy * k AS y FROM w)
SELECT id AS entity_id, round(x - floor(x / 500) * 500, 6) AS pos_x, round(y - floor(y / 500) * 500, 6) AS pos_y, round(vx, 6) AS vel_x, round(vy, 6) AS vel_y FROM s
""",
    "scan_counted": """
SELECT p_partkey AS entity_id FROM part WHERE p_size = 7
""",
    "query_table_exact": """
SELECT s_suppkey AS entity_id, s_acctbal AS acctbal FROM supplier
""",
    "query_flat_structs": """
SELECT s_suppkey AS entity_id, s_nationkey AS nation, s_acctbal AS balance FROM supplier
""",
    "query_changed_since": """
SELECT 'supplier' AS archetype, s_suppkey AS entity_id FROM supplier
""",
    "iter_sparse": """
SELECT doc_id AS entity_id, quality AS value FROM labels
""",
    "get_batch_unique": """
SELECT r.pos AS pos, CASE WHEN r.pos <> 1 THEN p.p_size END AS p_size FROM (SELECT 0 AS pos, 5 AS k UNION ALL SELECT 1, 5 UNION ALL SELECT 2, 1) r
LEFT JOIN part p ON p.p_partkey = r.k
""",
    "index_btree_range": """
SELECT p_partkey AS entity_id FROM part WHERE p_size >= 3 AND p_size < 9
""",
    "index_hash_eq": """
SELECT p_partkey AS entity_id, p_size FROM part WHERE p_brand = 'Brand#12'
""",
    "index_updated": """
SELECT p_partkey AS entity_id FROM part WHERE p_size < 5
""",
    "index_stale_revalidated": """
SELECT p_partkey AS entity_id FROM part WHERE p_size < 5
""",
    "spatial_index_candidates": """
SELECT s_suppkey AS entity_id FROM supplier WHERE s_acctbal BETWEEN 1000 AND 2000
""",
    "subscription_built": """
SELECT o_orderkey AS entity_id FROM orders WHERE o_orderstatus = 'P'
""",
    "view_of_last_delta": """
SELECT s_suppkey AS entity_id FROM supplier
""",
    "aggregate_result": """
SELECT 'COUNT(*)' AS label, CAST(count(*) AS DOUBLE) AS value FROM part UNION ALL SELECT 'MAX(p_size)', CAST(max(p_size) AS DOUBLE) FROM part
""",
    "execute_collect": """
SELECT CAST(n_nationkey AS BIGINT) AS entity_id FROM nation WHERE n_regionkey = 1
""",
    "execute_stream": """
SELECT CAST(n_nationkey AS BIGINT) AS entity_id FROM nation
""",
    "plan_chunks": """
SELECT p_partkey AS entity_id, CAST(p_size * 2 AS BIGINT) AS twice FROM part
""",
    "changeset_applied": """
SELECT CAST(n_nationkey AS BIGINT) AS entity_id, n_name, CASE n_nationkey WHEN 1 THEN 100 WHEN 2 THEN 102 WHEN 4 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 3
UNION ALL SELECT 1000, 'NOWHERE', 103
""",
    "batch_mutations": """
SELECT p_partkey AS entity_id, CASE WHEN p_size < 10 THEN p_size + 1000 ELSE p_size END AS p_size FROM part WHERE p_size <= 25
""",
    "reducer_call_optimistic": """
SELECT s_suppkey AS entity_id, round(s_acctbal + 100, 2) AS balance FROM supplier
""",
    "reducer_durable_recovered": """
SELECT s_suppkey AS entity_id, round(s_acctbal + 100, 2) AS balance FROM supplier
""",
    "wal_state_folded": """
SELECT s_suppkey AS entity_id, round(CASE WHEN s_nationkey = 1 THEN s_acctbal + 1 ELSE s_acctbal END, 2) AS balance FROM supplier
""",
    "retention_run": """
SELECT p_partkey AS entity_id, p_size - 2 AS remaining FROM part WHERE p_size > 2
""",
    "snapshot_round_trip": """
SELECT d.doc_id AS entity_id, d.n_chars AS n_chars, l.quality AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id
""",
    "lsm_store_scanned": """
SELECT user_id AS entity_id, event_id AS row_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1
""",
    "metrics_change": """
SELECT -count(*) AS entities, CAST(0 AS BIGINT) AS archetypes FROM supplier WHERE s_nationkey = 1
""",
}
