"""DuckDB SQL for each query of the catalog, and the constants that both sides share."""

from __future__ import annotations

SHARDS = 4
RETAINED = 1024
HALF = 5_000
CUTOFF = 1_705_300_000_000
INTERVAL_MS = 6 * 3600 * 1000
IDLE_MS = 5 * 60 * 1000
NAMES = ["orders", "sqlite_sequence", "SQLITE_stat1", "sqliteXfoo", "__logfold__events", "__LOGFOLD__x", "XXlogfoldYYfoo", "books", " books ", "_sqlite_x", ""]
#: (node, ts in ms) of attempts on one lease.
LEASE_ATTEMPTS = [(1, 0), (2, 4_000), (1, 5_000), (2, 14_999), (2, 15_000), (3, 15_001), (1, 24_999), (3, 25_000), (3, 29_000), (1, 39_000), (2, 39_001)]

CHG = """chg AS (SELECT event_id AS gid, 'events' AS table_name, user_id AS pk,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS type,
  value, props, epoch_us(ts) // 1000 AS created_at, event_id % 3 + 1 AS node_id,
  CASE WHEN event_id % 10 < 8 THEN 1 ELSE 0 END AS state FROM events)"""
ORD = """ord AS (SELECT o_orderkey AS gid, 'orders' AS table_name, o_custkey AS pk,
  CASE o_orderstatus WHEN 'O' THEN 'insert' WHEN 'F' THEN 'update' ELSE 'delete' END AS type,
  o_totalprice AS value, o_orderpriority AS props, epoch_us(o_orderdate) // 1000 AS created_at,
  o_orderkey % 3 + 1 AS node_id, CASE WHEN o_orderkey % 10 < 8 THEN 1 ELSE 0 END AS state FROM orders)"""
BOTH = f"{CHG}, {ORD}, both_logs AS (SELECT * FROM chg UNION ALL SELECT * FROM ord)"


def _bytes(said: str) -> str:
    return ", ".join(str(b) for b in said.encode())


def _cbor_int(x: str) -> str:
    cases = [f"WHEN {x} < 24 THEN [{x}]"]
    for lead, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        digits = ", ".join(f"({x} // {256 ** k}) % 256" for k in reversed(range(width)))
        bound = f"WHEN {x} < {256**width} THEN" if width < 8 else "ELSE"
        cases.append(f"{bound} [{lead}, {digits}]")
    return f"CASE {' '.join(cases)} END"


#: The key's bytes as a list, and the hash over them in 128-bit arithmetic.
KEY_BYTES = f"list_concat(list_concat([159, {0x60 + 6}, {_bytes('events')}, 130, {0x60 + 7}, {_bytes('user_id')}]::BIGINT[], ({_cbor_int('pk')})::BIGINT[]), [255]::BIGINT[])"
HASH = f"list_reduce(list_transform({KEY_BYTES}, lambda b: b::HUGEINT), lambda a, b: xor((a * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, b), 14695981039346656037::HUGEINT)"
KEYS = f"keys AS (SELECT pk, {HASH} AS h FROM (SELECT DISTINCT pk FROM chg))"
STREAM = f"{CHG}, {KEYS}, stream AS (SELECT chg.*, (h % {SHARDS} + 1)::INTEGER AS shard, row_number() OVER (PARTITION BY h % {SHARDS} ORDER BY gid) AS seq FROM chg JOIN keys USING (pk))"
KEPT = f"{STREAM}, kept AS (SELECT shard, seq FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq DESC) AS back FROM stream) WHERE back <= {RETAINED})"
POINTS = f"{STREAM}, points AS (SELECT * FROM stream WHERE shard = 1 AND seq % {RETAINED // SHARDS} = 0)"
STATE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY gid DESC) AS back FROM {0}) WHERE back = 1 AND type <> 'delete')"
LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY gid DESC) AS back FROM {0}) WHERE back = 1)"


def all_sql() -> dict[str, str]:
    names = ", ".join(f"('{n}')" for n in NAMES)
    attempts = ", ".join(f"({n}, {t})" for n, t in LEASE_ATTEMPTS)
    return {
        "q01_list_tables": f"""SELECT name, NOT name ILIKE 'sqlite_%' AND NOT name ILIKE '__logfold__%' AS user_table,
            trim(name) <> '' AND NOT starts_with(trim(name), 'sqlite_') AND NOT starts_with(trim(name), '__logfold__') AS watched,
            name ILIKE '__logfold__%' AS own FROM (VALUES {names}) AS t(name)""",
        "q02_table_schema": """SELECT DISTINCT column_name AS name, ordinal_position::BIGINT AS ordinal, data_type AS type, column_name = 'o_orderkey' AS pk
            FROM information_schema.columns WHERE table_name = 'orders'""",
        "q03_pending_scan": f"WITH {CHG} SELECT * FROM chg WHERE state = 0 ORDER BY gid LIMIT 512",
        "q04_row_image": f"""WITH {CHG}, o AS (SELECT *, lag(value) OVER w AS old_value, lag(props) OVER w AS old_props FROM chg WINDOW w AS (PARTITION BY pk ORDER BY gid))
            SELECT gid, pk, type, CASE type WHEN 'delete' THEN old_value ELSE value END AS image_value,
            CASE type WHEN 'delete' THEN old_props ELSE props END AS image_props, 0 AS log_state FROM o""",
        "q05_diff_capture": """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
            CASE WHEN o_orderkey % 10 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 3
            UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 = 5)
            SELECT CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN a.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS type,
            coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
            CASE WHEN a.o_orderkey IS NULL THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus,
            CASE WHEN a.o_orderkey IS NULL THEN b.o_totalprice ELSE a.o_totalprice END AS o_totalprice
            FROM orders b FULL OUTER JOIN a ON a.o_orderkey = b.o_orderkey
            WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
        "q06_global_log": f"WITH {CHG} SELECT row_number() OVER (ORDER BY gid) AS id, gid AS change_table_id, table_name, created_at FROM chg",
        "q07_fetch_rows": f"WITH {CHG} SELECT pk, value, props, type FROM chg WHERE state = 0",
        "q08_mark_published": f"""WITH {CHG}, m AS (SELECT gid, CASE WHEN gid <= (SELECT count(*) // 2 FROM chg) THEN 1 ELSE 0 END AS state FROM chg)
            SELECT state, count(*) AS n, count(*) FILTER (state = 0) AS global_rows, min(gid) AS first_gid FROM m GROUP BY state""",
        "q09_cleanup": f"WITH {BOTH} SELECT coalesce(table_name, '(all)') AS table_name, count(*) AS removed FROM both_logs WHERE state = 1 AND created_at <= {CUTOFF} GROUP BY ROLLUP (table_name)",
        "q10_global_join": f"WITH {BOTH} SELECT table_name, gid AS change_table_id, pk, type FROM both_logs WHERE state = 0",
        "q11_lww_state": f"WITH {CHG} SELECT pk, gid, type, value, props, node_id FROM {STATE.format('chg')}",
        "q12_apply_upsert": f"""WITH {CHG}, base AS (SELECT * FROM {STATE.format(f'(SELECT * FROM chg WHERE gid < {HALF})')}),
            later AS (SELECT * FROM {LATEST.format(f'(SELECT * FROM chg WHERE gid >= {HALF})')})
            SELECT pk, gid, type, value, props, node_id, 'applied' AS origin FROM later WHERE type <> 'delete'
            UNION ALL SELECT pk, gid, type, value, props, node_id, 'base' FROM base WHERE pk NOT IN (SELECT pk FROM later)""",
        "q13_apply_delete": """WITH r AS (SELECT nullif(o_custkey % 20, 0) AS k1, o_orderpriority AS k2, count(*) AS n FROM orders GROUP BY 1, 2)
            SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r g WHERE (g.k1 IS NULL OR g.k1 % 3 = 0) AND (g.k2 LIKE '1%' OR g.k2 LIKE '3%')
            AND g.k1 IS NOT DISTINCT FROM r.k1 AND g.k2 IS NOT DISTINCT FROM r.k2)""",
        "q14_shard_key": f"WITH {CHG}, {KEYS} SELECT pk, (h // 4294967296)::BIGINT AS hash_hi, (h % 4294967296)::BIGINT AS hash_lo, (h % {SHARDS} + 1)::INTEGER AS shard FROM keys",
        "q15_shard_seq": f"WITH {STREAM} SELECT shard, seq, gid, pk FROM stream",
        "q16_pending_count": f"WITH {BOTH} SELECT table_name, count(*) FILTER (state = 0) AS pending, count(*) AS total FROM both_logs GROUP BY table_name",
        "q17_orphans": f"WITH {CHG} SELECT gid AS change_table_id, table_name FROM chg WHERE gid % 7 <> 0 AND gid NOT IN (SELECT gid FROM chg WHERE state = 0)",
        "q18_resume": f"WITH {STREAM} SELECT shard, seq, gid FROM stream WHERE seq > shard * 100",
        "q19_retention": f"WITH {KEPT} SELECT shard, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS kept FROM kept GROUP BY shard",
        "q20_gap_check": f"""WITH {KEPT}, b AS (SELECT shard, shard::BIGINT * 100 AS saved_seq, min(seq) AS first_seq FROM kept GROUP BY shard)
            SELECT *, saved_seq < first_seq AS behind, (SELECT bool_or(saved_seq < first_seq) FROM b) AS restore FROM b""",
        "q21_snapshot_points": f"WITH {POINTS} SELECT shard, seq, gid, created_at FROM points",
        "q22_snapshot_rows": f"WITH {POINTS}, c AS (SELECT * FROM chg WHERE gid <= coalesce((SELECT max(gid) FROM points), -1)) SELECT pk, gid, type, value, props FROM {STATE.format('c')}",
        "q23_restore_replay": f"WITH {CHG} SELECT pk, gid, type, value, props, node_id FROM {STATE.format('chg')}",
        "q24_digest": f"""WITH {CHG}, s AS (SELECT md5(concat_ws('|', gid, pk, props, type)) AS m FROM {STATE.format('chg')})
            SELECT count(*) AS n, coalesce(sum(('0x' || substr(m, 1, 8))::BIGINT), 0)::BIGINT AS checksum FROM s""",
        "q25_log_sizes": f"WITH {STREAM} SELECT shard, count(*) AS messages, sum(strlen(props) + strlen(type) + 24)::BIGINT AS payload_bytes FROM stream GROUP BY shard",
        "q26_lease": f"""WITH RECURSIVE a AS (SELECT node, ts, row_number() OVER (ORDER BY ts, node) AS i FROM (VALUES {attempts}) AS t(node, ts)),
            r AS (SELECT i, node, ts, true AS granted, node AS holder, ts AS held FROM a WHERE i = 1
            UNION ALL SELECT a.i, a.node, a.ts, r.holder = a.node OR r.held + 10000 <= a.ts,
            CASE WHEN r.holder = a.node OR r.held + 10000 <= a.ts THEN a.node ELSE r.holder END,
            CASE WHEN r.holder = a.node OR r.held + 10000 <= a.ts THEN a.ts ELSE r.held END FROM r JOIN a ON a.i = r.i + 1)
            SELECT node::BIGINT AS node, ts::BIGINT AS ts, granted FROM r""",
        "q27_interval_due": f"""WITH {POINTS}, t AS (SELECT seq, created_at, lag(created_at) OVER (ORDER BY seq) AS previous_at FROM points)
            SELECT *, previous_at IS NULL OR created_at - previous_at >= {INTERVAL_MS} AS due FROM t""",
        "q28_union_logs": f"WITH {BOTH} SELECT table_name, type, count(*) AS n, max(gid) AS last_gid FROM both_logs GROUP BY table_name, type",
        "q29_stream_names": f"""SELECT s::INTEGER AS shard, c AS compressed, 'logfold-changes-' || s || CASE WHEN c THEN '-c' ELSE '' END AS stream,
            'logfold-change-log-' || s AS subject FROM range(1, {SHARDS + 1}) AS r(s), (VALUES (false), (true)) AS v(c)""",
        "q30_metrics": f"WITH {CHG} SELECT floor(value / 10)::BIGINT AS bucket, count(*) FILTER (state = 1) AS published, count(*) FILTER (state = 0) AS pending FROM chg GROUP BY 1",
        "q31_envelope": f"WITH {CHG} SELECT gid, pk, type, value, props, created_at FROM chg",
        "q32_idle_gaps": f"WITH {CHG}, g AS (SELECT gid, created_at, created_at - lag(created_at) OVER (ORDER BY gid) AS idle_ms FROM chg) SELECT * FROM g WHERE idle_ms > {IDLE_MS}",
        "q33_by_origin": f"""WITH {CHG}, w AS (SELECT node_id, count(*) AS winners FROM {STATE.format('chg')} GROUP BY node_id)
            SELECT node_id, count(*) AS changes, coalesce(any_value(winners), 0) AS winners FROM chg LEFT JOIN w USING (node_id) GROUP BY node_id""",
    }
