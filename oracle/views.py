"""The telemetry mappings of ``vitalgrid.sources.testbed``, stated in SQL.

``with_views(sql)`` puts the mappings a query names (``fx_*``) in front of it as
common table expressions.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["fx_events"] = """
SELECT event_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value*100) AS BIGINT) AS c,
       CAST(user_id % 25 AS BIGINT) AS target_id
FROM events"""

VIEWS["fx_targets"] = """
SELECT c_custkey + 1000 AS target_id, CAST(c_nationkey AS BIGINT) AS cluster_id, 'host' || c_nationkey AS host,
       '5432' AS port, c_name AS database, CASE WHEN c_custkey % 3 <> 0 THEN 'sys' || c_nationkey ELSE '' END AS system_identifier,
       CASE c_custkey % 7 WHEN 0 THEN 'rds' WHEN 1 THEN 'neon' ELSE 'unknown' END AS provider, c_custkey % 5 = 0 AS is_replica
FROM customer"""

VIEWS["fx_instances"] = """
SELECT k + 1000 AS target_id, CAST(0 AS BIGINT) AS snapshot_id, collected_at, database, cluster_id,
       CASE k % 7 WHEN 0 THEN 'rds' WHEN 1 THEN 'neon' ELSE 'unknown' END AS provider, k % 5 = 0 AS is_replica,
       k % 4 AS replica_count, k % 3 AS sync_count, (k*7) % 200 AS connections_used,
       CAST(CASE WHEN k % 6 = 0 THEN 500 ELSE 200 END AS BIGINT) AS connections_max,
       b*2200 AS max_xid_age, (b*1700 + k*1000) % 2100000000 AS max_mxid_age, last_archived_at, last_failed_at, failed_count,
       CASE WHEN k % 13 = 0 THEN failed_count ELSE 0 END AS failed_increase,
       CASE WHEN k % 9 <> 0 THEN CAST(n AS DOUBLE)*1.5 END AS wal_bytes_per_sec,
       CASE WHEN k % 4 <> 0 THEN price*40 END AS wal_dir_bytes, urgent AS checkpoints_req, n - urgent AS checkpoints_timed,
       k % 8 <> 0 AS statements_enabled, k % 6 AS statements_dealloc, 4000 + (k*13) % 1200 AS statements_count,
       CAST(5000 AS BIGINT) AS statements_max,
       CASE WHEN k % 10 <> 0 THEN collected_at - (k % 50)*86400 END AS stats_reset_at,
       collected_at - (k % 90)*86400 - 600 AS postmaster_start_at,
       CASE WHEN k % 23 = 0 THEN k % 5 ELSE 0 END AS conflict_snapshot, CASE WHEN k % 19 = 0 THEN 2 ELSE 0 END AS conflict_lock,
       CASE WHEN k % 29 = 0 THEN 3 ELSE 0 END AS conflict_bufferpin, 0 AS conflict_deadlock, 0 AS conflict_tablespace
FROM (SELECT c_custkey AS k, c_name AS database, CAST(c_nationkey AS BIGINT) AS cluster_id, abs(CAST(round(c_acctbal*100) AS BIGINT)) AS b,
             last_archived_at, last_failed_at, coalesce(n, 0) AS n, coalesce(urgent, 0) AS urgent, coalesce(failed_count, 0) AS failed_count,
             coalesce(price, 0) AS price, coalesce(newest, 946684800) + 172800*(c_custkey % 3) AS collected_at
      FROM customer LEFT JOIN (
        SELECT o_custkey, count(*) AS n, CAST(max(CASE WHEN o_orderstatus='F' THEN epoch(o_orderdate) END) AS BIGINT) AS last_archived_at,
               CAST(max(CASE WHEN o_orderstatus='P' THEN epoch(o_orderdate) END) AS BIGINT) AS last_failed_at,
               CAST(max(epoch(o_orderdate)) AS BIGINT) AS newest, count(*) FILTER (o_orderstatus='P') AS failed_count,
               count(*) FILTER (left(o_orderpriority,1)='1') AS urgent, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS price
        FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""

VIEWS["fx_params"] = """
SELECT target_id, u.n AS name, u.v AS value FROM (
  SELECT c_custkey + 1000 AS target_id, unnest([
    {'n': 'fsync', 'v': CASE WHEN c_custkey % 31 = 0 THEN 'off' ELSE 'on' END},
    {'n': 'full_page_writes', 'v': CASE WHEN c_custkey % 37 = 1 THEN 'off' ELSE 'on' END},
    {'n': 'autovacuum', 'v': CASE WHEN c_custkey % 41 = 2 THEN 'off' ELSE 'on' END},
    {'n': 'track_io_timing', 'v': CASE WHEN c_custkey % 5 = 3 THEN 'off' ELSE 'on' END},
    {'n': 'data_checksums', 'v': CASE WHEN c_custkey % 6 = 4 THEN 'off' ELSE 'on' END},
    {'n': 'ignore_checksum_failure', 'v': CASE WHEN c_custkey % 43 = 5 THEN 'on' ELSE 'off' END},
    {'n': 'archive_mode', 'v': CASE c_custkey % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'always' ELSE 'on' END},
    {'n': 'archive_timeout', 'v': CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE (1 + b % 90) || 'min' END},
    {'n': 'wal_level', 'v': CASE WHEN c_custkey % 11 = 0 THEN 'minimal' ELSE 'replica' END},
    {'n': 'work_mem', 'v': (1 + b % 64) || 'MB'},
    {'n': 'effective_cache_size', 'v': (1 + b % 8) || 'GB'},
    {'n': 'max_connections', 'v': CASE WHEN c_custkey % 6 = 0 THEN '500' ELSE '200' END},
    {'n': 'max_wal_size', 'v': (1 + b % 4) || 'GB'},
    {'n': 'random_page_cost', 'v': CAST(1 + b % 5 AS VARCHAR)},
    {'n': 'statement_timeout', 'v': CASE WHEN b % 2 = 0 THEN '0' ELSE '30s' END},
    {'n': 'synchronous_commit', 'v': CASE c_custkey % 5 WHEN 4 THEN 'off' WHEN 3 THEN 'remote_apply' ELSE 'on' END},
    {'n': 'synchronous_standby_names', 'v': CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ANY 2 (s1, s2, s3)' ELSE 's1' END},
    {'n': 'autovacuum_max_workers', 'v': CAST(1 + b % 3 AS VARCHAR)},
    {'n': 'ssl_key_file', 'v': (b % 7) || '.key'}]) AS u
  FROM (SELECT *, abs(CAST(round(c_acctbal*100) AS BIGINT)) AS b FROM customer))"""

VIEWS["fx_settings"] = """
SELECT target_id, snapshot_id, name,
       CASE WHEN name IN ('fsync','autovacuum','track_io_timing') THEN CASE WHEN b % 10 < 3 THEN 'off' ELSE 'on' END
            WHEN name = 'work_mem' THEN (1 + b % 64) || 'MB' WHEN name = 'archive_timeout' THEN (1 + b % 30) || 'min'
            WHEN name = 'statement_timeout' THEN CASE WHEN b % 2 = 0 THEN '0' ELSE '30s' END
            WHEN name = 'ssl_key_file' THEN '/etc/k' || (b % 7) ELSE CAST(1 + b % 5 AS VARCHAR) END AS value
FROM (SELECT CAST(c_nationkey AS BIGINT) AS target_id, CAST((c_custkey // 8) % 4 AS BIGINT) AS snapshot_id,
             ['fsync','autovacuum','work_mem','archive_timeout','statement_timeout','ssl_key_file','track_io_timing','random_page_cost'][c_custkey % 8 + 1] AS name,
             max_by(abs(CAST(round(c_acctbal*100) AS BIGINT)), c_custkey) AS b
      FROM customer GROUP BY 1, 2, 3)"""

VIEWS["fx_db_counters"] = """
SELECT target_id, slot AS snapshot_id, slot*21600 AS collected_at, numbackends,
       CAST(sum(xc) OVER w AS BIGINT) AS xact_commit, CAST(sum(xr) OVER w AS BIGINT) AS xact_rollback,
       CAST(sum(bh) OVER w AS BIGINT) AS blks_hit, CAST(sum(br) OVER w AS BIGINT) AS blks_read,
       CAST(sum(tb) OVER w AS BIGINT) AS temp_bytes, CAST(sum(dl) OVER w AS BIGINT) AS deadlocks,
       CAST(sum(tr) OVER w AS BIGINT) AS tup_returned, CAST(sum(tw) OVER w AS BIGINT) AS tup_written,
       epoch_id*40*21600 AS stats_reset_at, (slot // 80)*80*21600 AS postmaster_start_at
FROM (SELECT target_id, sec // 21600 AS slot, (sec // 21600) // 40 AS epoch_id, count(*) AS numbackends,
             40*count(*) FILTER (event_type <> 'error') AS xc, 40*count(*) FILTER (event_type = 'error') AS xr,
             sum(c) AS bh, sum(20*k) AS br, sum(c*(target_id % 4)*20000000) AS tb,
             count(*) FILTER (event_type = 'error' AND c > 10000) AS dl, sum(k*100) AS tr, sum(k) AS tw
      FROM fx_events GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY target_id, epoch_id ORDER BY slot ROWS UNBOUNDED PRECEDING)"""

VIEWS["fx_cluster_snapshots"] = """
SELECT target_id, cluster_id, database, CASE i WHEN 0 THEN 0 WHEN 1 THEN 7200 ELSE 7400 END + cluster_id*7 + (target_id - 1000) % 50 AS collected_at
FROM fx_targets, (SELECT unnest([0, 1, 2]) AS i) WHERE i <> 1 OR (target_id - 1000) % 4 <> 0"""

VIEWS["fx_close"] = """
SELECT target_id, sec // 21600 AS slot, i, k, c, 3*(sec // 21600) + i AS snapshot_id, (sec // 21600)*21600 + 600*i AS collected_at
FROM fx_events, (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS i)"""

VIEWS["fx_close_counters"] = """
SELECT target_id, snapshot_id, collected_at, count(*) AS numbackends, (collected_at - 300) // 64800 * 64800 + 300 AS stats_reset_at,
       (collected_at - 900) // 259200 * 259200 + 900 AS postmaster_start_at FROM fx_close GROUP BY 1, 2, 3"""

VIEWS["fx_close_statements"] = """
SELECT target_id, snapshot_id, collected_at, k % 3 AS queryid, (i + 1)*count(*) AS calls,
       (i + 1)*count(*)*1000*CASE WHEN i = 2 THEN 10 + max(c % 30) ELSE 4 END AS total_us FROM fx_close GROUP BY target_id, snapshot_id, collected_at, i, k % 3"""

VIEWS["fx_ash"] = """
SELECT target_id, sec // 604800 AS window_id, sec AS sample_at, event_id AS pid, k % 5 + 1 AS query_id,
  CASE WHEN event_type = 'click' THEN NULL
       WHEN user_id % 5 = 0 AND event_type IN ('view','error','signup') THEN 'IO'
       WHEN user_id % 5 = 1 AND event_type IN ('error','signup') THEN 'LWLock'
       WHEN user_id % 5 = 2 AND event_type IN ('error','signup') THEN 'Lock'
       WHEN event_type = 'view' THEN 'IO' WHEN event_type = 'purchase' THEN 'Client'
       WHEN event_type = 'signup' THEN 'LWLock' ELSE 'Lock' END AS wait_event_type,
  CASE WHEN event_type = 'click' THEN NULL
       WHEN user_id % 5 = 1 AND event_type IN ('error','signup') THEN 'BufferMapping' ELSE event_type END AS wait_event
FROM fx_events"""

VIEWS["fx_activity"] = """
SELECT target_id, sec // 86400 AS snapshot_id, event_id AS pid,
  CASE WHEN event_type IN ('click','error') THEN 'active' WHEN event_type = 'view' THEN 'idle'
       WHEN event_type = 'purchase' THEN 'idle in transaction' ELSE 'idle in transaction (aborted)' END AS state,
  CASE WHEN event_type = 'error' THEN 'Lock' WHEN event_type IN ('view','purchase') THEN 'Client' ELSE '' END AS wait_event_type,
  CASE WHEN k % 6 = 0 THEN '' ELSE 'app' || (k % 6) END AS app_name, 'u' || (user_id % 3) AS username,
  CAST(3*floor(value)*CASE WHEN event_id % 20 = 0 THEN 30 ELSE 1 END AS BIGINT) AS xact_age_s, CAST(floor(value) AS BIGINT) AS query_age_s,
  CASE WHEN event_id % 20 = 0 THEN 'autovacuum worker' ELSE 'client backend' END AS backend_type
FROM fx_events"""

VIEWS["fx_lock_waits"] = """
SELECT target_id, sec // 86400 AS snapshot_id, event_id AS blocked_pid, CAST(floor(value) AS BIGINT) AS wait_s
FROM fx_events WHERE event_type = 'error' AND value > 80"""

VIEWS["fx_statements"] = """
SELECT target_id, snapshot_id, queryid, CAST(sum(n) OVER w AS BIGINT) AS calls, CAST(sum(us) OVER w AS BIGINT) AS total_us,
       CAST(sum(q) OVER w AS BIGINT) AS rows, CAST(sum(ln) OVER w AS BIGINT) AS blks_hit, CAST(sum(n) OVER w AS BIGINT) AS blks_read,
       CASE WHEN queryid % 10 = 0 THEN 'SET work_mem = ' || queryid WHEN queryid % 10 = 1 THEN '  begin'
            WHEN queryid % 10 = 2 THEN 'SELECT * FROM pg_stat_statements'
            WHEN queryid % 10 = 3 THEN 'UPDATE t' || queryid || ' SET a = $1'
            ELSE 'SELECT a FROM t' || queryid || ' WHERE b = $1 AND c > 10' END AS query,
       (snapshot_id - 1970)*365*86400 AS collected_at
FROM (SELECT CAST(l_suppkey % 25 AS BIGINT) AS target_id, CAST(year(l_shipdate) AS BIGINT) AS snapshot_id, CAST(l_partkey % 40 AS BIGINT) AS queryid,
             count(*) AS n, sum(CAST(round(l_extendedprice*100) AS BIGINT) * CASE WHEN year(l_shipdate) % 3 = 1 AND l_partkey % 3 = 1 THEN 40 ELSE 1 END) AS us,
             sum(CAST(l_quantity AS BIGINT)) AS q, sum(l_linenumber) AS ln
      FROM lineitem GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY target_id, queryid ORDER BY snapshot_id ROWS UNBOUNDED PRECEDING)"""

VIEWS["fx_table_stats"] = """
SELECT *, CASE WHEN mk % 2 <> 0 THEN collected_at - 3600 END AS last_vacuum, CASE WHEN mk % 3 <> 0 THEN collected_at - 7200 END AS last_autovacuum,
       CASE WHEN mk % 4 <> 0 THEN collected_at - 3600 END AS last_analyze,
       CASE WHEN mk % 4 <> 0 AND mk % 5 = 0 THEN collected_at - 1800 END AS last_autoanalyze,
       CASE WHEN mk % 41 = 0 THEN 'off' END AS rel_autovacuum_enabled,
       CASE WHEN mk % 10 = 1 THEN CAST(0.05 AS DOUBLE) END AS rel_vacuum_scale, CASE WHEN mk % 11 = 1 THEN CAST(500 AS DOUBLE) END AS rel_vacuum_threshold,
       CASE WHEN mk % 12 = 1 THEN CAST(0.02 AS DOUBLE) END AS rel_analyze_scale, CASE WHEN mk % 13 = 1 THEN CAST(5000 AS DOUBLE) END AS rel_analyze_threshold,
       CASE WHEN live_tuples + dead_tuples > 0 THEN round(CAST(dead_tuples AS DOUBLE)/CAST(live_tuples + dead_tuples AS DOUBLE)*10000)/10000 ELSE 0 END AS dead_ratio
FROM (SELECT CAST(c_nationkey AS BIGINT) AS target_id, CAST(year(o_orderdate) AS BIGINT) AS snapshot_id, CAST((year(o_orderdate) - 1970)*365*86400 AS BIGINT) AS collected_at,
             'public' AS schema, 't' || (c_custkey % 6) AS "table", CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS total_bytes,
             4000*count(*) AS live_tuples, 3000*count(*) FILTER (o_orderstatus='P') AS dead_tuples,
             CAST(sum(CASE WHEN left(o_orderpriority,1)='1' THEN 900 ELSE 100 END) AS BIGINT) AS seq_scans,
             CAST(sum(CASE WHEN c_custkey % 2 = 0 THEN 60 ELSE 300 END) AS BIGINT) AS index_scans,
             CAST(sum(c_custkey % 2000) AS BIGINT) AS mods_since_analyze, 2500*count(*) AS updates,
             CAST(sum(CASE WHEN left(o_orderpriority,1)='5' THEN 2500 ELSE 800 END) AS BIGINT) AS hot_updates, max(c_custkey) AS mk
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5)"""

VIEWS["fx_indexes"] = """
SELECT CAST(p_size % 25 AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, 'public' AS schema, 't' || (p_partkey % 4) AS "table",
       'ix' || p_partkey AS index, p_partkey AS indexrelid, CASE WHEN p_partkey % 11 = 0 THEN 'gin' ELSE 'btree' END AS method,
       [1 + p_partkey % 2, 1 + (p_partkey // 7) % 3, 1 + (p_partkey // 3) % 4][1:1 + p_partkey % 3] AS indkey,
       p_partkey % 17 = 0 AS is_primary, p_partkey % 13 = 0 AS is_unique, false AS is_exclusion, p_partkey % 37 = 0 AS is_replident,
       p_partkey % 19 = 0 AS is_partial, p_partkey % 23 = 0 AS is_expression, (p_partkey % 17 = 0 OR p_partkey % 13 = 0) AS backs_constraint,
       p_partkey % 29 = 0 AS is_invalid, p_partkey % 2 = 0 AS is_ready, p_partkey % 31 <> 0 AS is_live,
       CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 1000 END AS scans, (p_partkey % 50)*40000 + 10000 AS bytes
FROM part"""

VIEWS["fx_foreign_keys"] = """
SELECT CAST(s_nationkey AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, 'public' AS schema, 't' || (s_suppkey % 4) AS "table",
       'fk' || s_suppkey AS "constraint", [1 + s_suppkey % 3, 1 + s_suppkey % 2][1:1 + s_suppkey % 2] AS conkey,
       abs(CAST(round(s_acctbal*100) AS BIGINT))*10000 AS child_bytes
FROM supplier"""

VIEWS["fx_partition_edges"] = """
SELECT CAST(n_regionkey AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(1 AS BIGINT), 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0"""

VIEWS["fx_partition_leaves"] = """
SELECT CAST(n_regionkey AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, 'c' || c_custkey AS child, abs(CAST(round(c_acctbal*100) AS BIGINT))*1000 AS total_bytes, c_custkey % 500 * 10 AS live_tuples,
       c_custkey % 97 AS seq_scans, c_custkey % 89 AS index_scans FROM customer JOIN nation ON n_nationkey = c_nationkey"""

VIEWS["fx_schema_objects"] = """
SELECT CAST(p_size % 25 AS BIGINT) AS target_id, s.snapshot_id, s.snapshot_id*86400 AS collected_at,
       ['index','table','column','constraint'][p_partkey % 4 + 1] AS kind, 'public.' || p_brand || '.o' || p_partkey AS identity,
       p_type || CASE WHEN (p_partkey + s.snapshot_id) % 9 = 0 THEN ' v2' ELSE '' END AS definition,
       (p_partkey % 29 = 0 AND p_partkey % 4 = 0) AS invalid, p_partkey % 8 <> 0 AS ready, p_partkey % 31 <> 0 AS live,
       CASE WHEN p_partkey % 29 = 0 AND p_partkey % 4 = 0 THEN (p_partkey % 50)*40000 ELSE 0 END AS bytes
FROM part, (SELECT CAST(unnest([1,2,3]) AS BIGINT) AS snapshot_id) s WHERE (p_partkey*s.snapshot_id) % 7 <> 3"""

VIEWS["fx_sequences"] = """
SELECT CAST(p_size % 25 AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, 'public' AS schema, 'sq' || p_partkey AS name,
       't' || (p_partkey % 4) || '.id' AS owned_by, ['int2','int4','int8'][p_partkey % 3 + 1] AS type,
       CASE WHEN p_partkey % 53 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN (37*p_partkey) % 32767
            WHEN p_partkey % 3 = 1 THEN (1048573*p_partkey) % 2147483647 ELSE 1000003*p_partkey END AS last_value,
       [32767, 2147483647, 9223372036854775807][p_partkey % 3 + 1] AS ceiling
FROM part"""

VIEWS["fx_narrow_columns"] = """
SELECT CAST(p_size % 25 AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, 'public' AS schema, 't' || (p_partkey % 400) AS "table",
       'c' || p_partkey AS "column",
       CASE WHEN p_partkey % 4 = 0 AND p_size % 25 < 5 THEN 'int2' WHEN p_partkey % 4 = 1 THEN 'int4' ELSE 'int8' END AS type,
       p_partkey % 6 = 0 AS is_identity, p_partkey % 5 = 0 AS owns_sequence
FROM part"""

VIEWS["fx_slots"] = """
SELECT CAST(s_nationkey AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, 'slot' || s_suppkey AS name, s_suppkey % 2 = 0 AS active,
       abs(CAST(round(s_acctbal*100) AS BIGINT))*10000 AS retained_bytes, CASE WHEN s_suppkey % 17 = 0 THEN 'lost' ELSE 'extended' END AS wal_status
FROM supplier"""

VIEWS["fx_replicas"] = """
SELECT CAST(s_nationkey AS BIGINT) AS target_id, s.snapshot_id, s.snapshot_id*86400 AS collected_at,
       CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'standby' || s_suppkey END AS app_name, '10.0.0.' || s_suppkey AS client_addr,
       ['sync','quorum','async'][s_suppkey % 3 + 1] AS sync_state,
       CASE WHEN s_suppkey % 8 <> 0 THEN CAST(abs(CAST(round(s_acctbal*100) AS BIGINT)) AS DOUBLE)/2000.0 END AS replay_lag_sec
FROM supplier, (SELECT CAST(unnest([1,2,3]) AS BIGINT) AS snapshot_id) s WHERE (s_suppkey*s.snapshot_id) % 5 <> 2"""

VIEWS["fx_subscriptions"] = """
SELECT CAST(s_nationkey AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, 'sub' || s_suppkey AS name, s_suppkey % 4 <> 0 AS worker_running
FROM supplier"""

VIEWS["fx_horizon"] = """
SELECT CAST(s_nationkey AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id,
       ['backend','replication_slot','standby_feedback','prepared_xact'][s_suppkey % 4 + 1] AS source, 'h' || s_suppkey AS holder,
       abs(CAST(round(s_acctbal*100) AS BIGINT))*2000 AS xmin_age,
       CASE WHEN s_suppkey % 4 = 3 THEN abs(CAST(round(s_acctbal*100) AS BIGINT)) // 100 ELSE 0 END AS age_s
FROM supplier"""

VIEWS["fx_checksum_failures"] = """
SELECT CAST(c_nationkey AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id,
       CASE WHEN c_custkey % 120 <> 0 THEN c_name END AS database, c_custkey % 7 AS failures
FROM customer WHERE c_custkey % 60 = 0"""

VIEWS["fx_progress"] = """
SELECT CAST(s_nationkey AS BIGINT) AS target_id, CAST(1 AS BIGINT) AS snapshot_id, s_suppkey AS pid,
       ['vacuum','create_index','cluster','analyze','basebackup','copy'][s_suppkey % 6 + 1] AS operation, 'public.t' || (s_suppkey % 4) AS relation,
       'scanning' AS phase, s_suppkey % 50 AS done, (s_suppkey % 5)*25 AS total
FROM supplier"""

VIEWS["fx_wal_io"] = """
SELECT target_id, snapshot_id, (snapshot_id - 1970)*365*86400 AS collected_at, CAST(sum(wb) OVER w AS BIGINT) AS wal_bytes,
       CAST(sum(wr) OVER w AS BIGINT) AS wal_records, CAST(sum(cr) OVER w AS BIGINT) AS checkpoints_req,
       CAST(sum(ct) OVER w AS BIGINT) AS checkpoints_timed, CAST(sum(bw) OVER w AS BIGINT) AS buffers_written
FROM (SELECT CAST(l_suppkey % 25 AS BIGINT) AS target_id, CAST(year(l_shipdate) AS BIGINT) AS snapshot_id,
             sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS wb, count(*) AS wr, count(*) FILTER (l_returnflag='A') AS cr,
             count(*) FILTER (l_returnflag<>'A') AS ct, sum(CASE WHEN l_returnflag='R' THEN 3 ELSE 1 END) AS bw
      FROM lineitem GROUP BY 1, 2)
WINDOW w AS (PARTITION BY target_id ORDER BY snapshot_id ROWS UNBOUNDED PRECEDING)"""

VIEWS["fx_snapshots"] = """
SELECT event_id AS snapshot_id, target_id, sec AS collected_at, length(event_type)*100 + k AS doc_bytes FROM fx_events"""

VIEWS["fx_hourly"] = """
SELECT target_id, (sec // 3600)*3600 AS collected_at, max(k) AS k FROM fx_events GROUP BY 1, 2"""

VIEWS["fx_rule_runs"] = """
SELECT target_id, event_type AS rule, sec // 86400 AS run, max(value) > 120 AS matched FROM fx_events GROUP BY 1, 2, 3"""

VIEWS["fx_sql_text"] = """
SELECT doc_id, 'SELECT * FROM t WHERE a = $1 AND b = ''' || text || ''' AND n = ' || doc_id || '.5 ' || text AS query FROM documents"""


def _needed(sql: str, views: dict[str, str]) -> set[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\b[a-z]\w*_\w+\b", todo.pop()):
            if name in views and name not in found:
                found.add(name)
                todo.append(views[name])
    return found


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    views = {**VIEWS, **(extra or {})}
    needed = _needed(sql, views)
    ctes = [f"{name} AS ({body})" for name, body in views.items() if name in needed]
    body = sql.strip()
    if body.startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + body
