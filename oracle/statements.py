"""One SQL statement per query of ``vitalgrid.plans.workload``."""

from __future__ import annotations

from oracle.findings import FAMILY_SQL, VIEWS, grouped
from oracle.views import with_views
from vitalgrid.plans.families import FAMILIES, FAMILY_OF

S: dict[str, str] = {}

AS_OF = 1706659200
LAG = "WINDOW w AS (PARTITION BY target_id ORDER BY collected_at)"

EXTRA = dict(VIEWS)
EXTRA["v_verdict_log"] = """
SELECT target_id, 'ix' || (snapshot_id % 500) AS index,
       CASE WHEN doc_bytes % 3 = 0 THEN 'found_in_code' WHEN doc_bytes % 3 = 1 THEN 'not_found_in_code' ELSE 'inconclusive' END AS verdict,
       collected_at*1000000 + snapshot_id AS checked_at FROM fx_snapshots"""
EXTRA["v_workload"] = r"""
SELECT * FROM fx_statements WHERE NOT regexp_matches(query, '(?i)^\s*(set|show|reset|begin|commit|rollback|discard|deallocate|start)\b')
  AND query NOT ILIKE '%pg_stat_statements%' AND calls > 0"""
EXTRA["v_minute"] = """
SELECT target_id, (sample_at // 60)*60 AS bucket_at, coalesce(wait_event_type, 'CPU') AS wait_type, coalesce(wait_event, '') AS wait_event, count(*) AS samples
FROM fx_ash GROUP BY 1, 2, 3, 4"""
EXTRA["v_table_pairs"] = """
SELECT n.target_id, n.snapshot_id, 'public.' || n."table" AS subject, b.seq_scans AS b_seq, n.seq_scans, b.dead_ratio AS b_dead, n.dead_ratio, base_at
FROM v_tables n JOIN (SELECT target_id, snapshot_id, lag(snapshot_id) OVER w AS base, lag(seen) OVER w AS base_at
  FROM (SELECT target_id, snapshot_id, max(collected_at) AS seen FROM fx_table_stats GROUP BY 1, 2) WINDOW w AS (PARTITION BY target_id ORDER BY seen)) h
  ON h.target_id = n.target_id AND h.snapshot_id = n.snapshot_id
JOIN v_tables b ON b.target_id = n.target_id AND b.snapshot_id = h.base AND b."table" = n."table" """
EXTRA["v_config"] = """
WITH h AS (SELECT target_id, snapshot_id, lag(snapshot_id) OVER w AS base FROM (SELECT DISTINCT target_id, snapshot_id FROM fx_settings)
           WINDOW w AS (PARTITION BY target_id ORDER BY snapshot_id)),
     cur AS (SELECT s.*, h.base FROM fx_settings s JOIN h USING (target_id, snapshot_id) WHERE base IS NOT NULL),
     old AS (SELECT h.target_id, h.snapshot_id, h.base, s.name, s.value FROM h JOIN fx_settings s ON s.target_id = h.target_id AND s.snapshot_id = h.base)
SELECT target_id, snapshot_id, 'config.changed' AS kind, name AS object,
       CASE WHEN old.value IS NULL THEN NULL WHEN regexp_matches(name, '(?i)(password|_key$|^ssl_.*_file$)') THEN '«redacted»' ELSE old.value END AS before,
       CASE WHEN cur.value IS NULL THEN NULL WHEN regexp_matches(name, '(?i)(password|_key$|^ssl_.*_file$)') THEN '«redacted»' ELSE cur.value END AS after,
       coalesce(cur.base, old.base)*86400 AS occurred_after, snapshot_id*86400 AS occurred_before, CAST(0.5 AS DOUBLE) AS confidence
FROM cur FULL OUTER JOIN old USING (target_id, snapshot_id, name) WHERE cur.value IS DISTINCT FROM old.value"""
EXTRA["v_evidence"] = """
SELECT target_id, snapshot_id, 'table_bloat' AS id, 'public.' || "table" AS object, 0 AS size FROM v_tables WHERE dead_ratio >= 0.2 AND live_tuples + dead_tuples >= 10000
UNION ALL SELECT target_id, snapshot_id, 'seq_scan_heavy', 'public.' || "table", 0 FROM v_tables WHERE live_tuples >= 50000 AND seq_scans + index_scans >= 100 AND seq_scans > 2*index_scans
UNION ALL SELECT target_id, snapshot_id, 'autovacuum_disabled_on_table', 'public.' || "table", 0 FROM v_tables WHERE rel_autovacuum_enabled = 'off'
UNION ALL SELECT target_id, snapshot_id, 'table_never_vacuumed', 'public.' || "table", 0 FROM v_tables WHERE live_tuples >= 10000 AND last_vacuum IS NULL AND last_autovacuum IS NULL
UNION ALL SELECT target_id, snapshot_id, 'autovacuum_starved', 'public.' || "table", 0 FROM v_tables WHERE live_tuples >= 10000 AND last_vacuum IS NOT NULL AND last_autovacuum IS NULL AND dead_tuples >= 1.5*vac_trigger
UNION ALL SELECT target_id, snapshot_id, 'stale_statistics', 'public.' || "table", 0 FROM v_tables WHERE live_tuples >= 10000 AND NOT (last_analyze IS NULL AND last_autoanalyze IS NULL) AND mods_since_analyze >= 2*ana_trigger
UNION ALL SELECT target_id, snapshot_id, 'never_analyzed', 'public.' || "table", 0 FROM v_tables WHERE live_tuples >= 10000 AND last_analyze IS NULL AND last_autoanalyze IS NULL
UNION ALL SELECT target_id, snapshot_id, 'low_hot_update_ratio', 'public.' || "table", 0 FROM v_tables WHERE updates >= 10000 AND CAST(hot_updates AS DOUBLE)/updates < 0.5"""
for f in FAMILIES:
    EXTRA["v_family_" + f] = FAMILY_SQL[f]

# --- A ---
S["target_fingerprints"] = """SELECT target_id, left(sha256(CASE WHEN system_identifier <> '' THEN system_identifier || '|' || database
  ELSE host || '|' || port || '|' || database END), 16) AS fingerprint FROM fx_targets"""
S["fingerprint_collisions"] = """
SELECT fingerprint, count(DISTINCT db) AS databases, count(*) AS targets FROM (
  SELECT 'db' || (target_id % 100) AS db, left(sha256(CASE WHEN system_identifier <> '' THEN system_identifier || '|' || 'db' || (target_id % 100)
    ELSE host || '|' || port || '|' || 'db' || (target_id % 100) END), 16) AS fingerprint FROM fx_targets) GROUP BY 1 HAVING count(*) > 1"""
S["schema_hashes"] = "SELECT target_id, snapshot_id, identity, left(sha256(kind || chr(0) || identity || chr(0) || definition), 16) AS definition_hash FROM fx_schema_objects"
S["list_baselines"] = """SELECT target_id, count(*) AS snapshots, min(collected_at) AS oldest, max(collected_at) AS newest,
  'db' || (max_by(snapshot_id, collected_at*1000000 + snapshot_id) % 7) AS database FROM fx_snapshots GROUP BY 1"""
S["latest_verdicts"] = "SELECT * FROM v_verdict_log QUALIFY row_number() OVER (PARTITION BY target_id, index ORDER BY checked_at DESC) = 1"
S["trend_scalars"] = "SELECT target_id, snapshot_id, tps, cache_hit_ratio AS cache_hit, CASE WHEN connections > 0 THEN connections END AS connections FROM v_rates"
S["trend_scalars_full"] = """
SELECT r.target_id, r.snapshot_id, tps, connections, longest_xact_s FROM (SELECT target_id, snapshot_id // 4 AS snapshot_id, max(tps) AS tps, max(connections) AS connections FROM v_rates GROUP BY 1, 2) r
LEFT JOIN v_activity a USING (target_id, snapshot_id)"""

# --- B ---
S["scrub_corpus"] = r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '\$[A-Za-z0-9_]*\$[\s\S]*?\$[A-Za-z0-9_]*\$', '$REDACTED$', 'g'),
  '''(?:[^'']|'''')*''', '''?''', 'g'), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '?', 'g'),
  '\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b', '?', 'g'),
  '(^|[^$A-Za-z0-9_])\d+(?:\.\d+)?\b', '\1?', 'g') AS scrubbed FROM fx_sql_text"""
S["redact_connections"] = """
SELECT target_id, CASE target_id % 3 WHEN 0 THEN 'postgres://app' || target_id || ':REDACTED@' || host || ':' || port || '/' || database
  WHEN 1 THEN 'host=' || host || ' Password = REDACTED dbname=' || database ELSE 'postgres://app@' || host || '/x' END AS connection FROM fx_targets"""
S["workload_statements"] = "SELECT target_id, snapshot_id, count(*) AS statements, CAST(sum(calls) AS BIGINT) AS calls FROM v_workload GROUP BY 1, 2"
S["normalise_settings"] = r"""
SELECT target_id, name, CASE WHEN regexp_matches(name, '(?i)(password|_key$|^ssl_.*_file$)') THEN '«redacted»' ELSE value END AS value,
  CASE WHEN name IN ('work_mem','effective_cache_size','max_wal_size') THEN CAST(regexp_extract(value, '^(\d+)', 1) AS BIGINT) * CASE WHEN value LIKE '%MB' THEN 1048576 ELSE 1073741824 END END AS bytes_value,
  CASE WHEN name IN ('archive_timeout','statement_timeout') THEN CAST(regexp_extract(value, '^(\d+)', 1) AS BIGINT) *
    CASE WHEN value LIKE '%min' THEN 60000000 WHEN value LIKE '%s' THEN 1000000 ELSE 1 END END AS micros_value,
  CASE WHEN value = 'on' THEN true WHEN value = 'off' THEN false END AS bool_value,
  CASE WHEN name = 'synchronous_standby_names' THEN CAST(CASE WHEN value = '' THEN 0 WHEN value LIKE 'ANY 2%' THEN 2 ELSE 1 END AS BIGINT) END AS required_standbys
FROM fx_params"""
S["search_terms"] = """
SELECT target_id, index, array_to_string(list_distinct_ordered, ',') AS terms FROM (
  SELECT target_id, index, list_filter(flat, lambda x, i: list_position(flat, x) = i) AS list_distinct_ordered FROM (
    SELECT target_id, index, flatten(list_transform(indkey, lambda n: CASE n
      WHEN 1 THEN ['customerId','customerId','customer_id','CustomerId','CUSTOMER_ID'] WHEN 2 THEN ['status_code','statusCode','status_code','StatusCode','STATUS_CODE']
      WHEN 3 THEN ['createdAt','createdAt','created_at','CreatedAt','CREATED_AT'] ELSE ['HTTPStatus','httpStatus','http_status','HttpStatus','HTTP_STATUS'] END)) AS flat FROM fx_indexes))"""
S["object_classes"] = """
SELECT target_id, 'slot' AS object_class, true AS stable, count(*) AS n FROM fx_slots GROUP BY 1
UNION ALL SELECT target_id, 'relation', true, count(*) FROM fx_indexes GROUP BY 1 UNION ALL SELECT target_id, 'cluster', false, count(*) FROM fx_lock_waits GROUP BY 1"""
S["identity_parts"] = """SELECT target_id, snapshot_id, identity, split_part(identity, '.', 1) AS schema, split_part(identity, '.', 2) AS "table", split_part(identity, '.', 3) AS name FROM fx_schema_objects"""
S["human_figures"] = """
SELECT target_id, snapshot_id, "table", CASE WHEN live_tuples >= 1000000 THEN printf('%.1fM', live_tuples/1e6) WHEN live_tuples >= 1000 THEN printf('%.1fk', live_tuples/1e3) ELSE CAST(live_tuples AS VARCHAR) END AS rows,
  CASE WHEN m >= 86400 THEN printf('%.0fd', m/86400.0) WHEN m >= 3600 THEN printf('%.0fh', m/3600.0) WHEN m >= 60 THEN printf('%.0fm', m/60.0) ELSE m || 's' END AS duration,
  CASE WHEN m >= 86400 THEN (m // 86400) || 'd ' ELSE '' END || printf('%02d:%02d:%02d', m % 86400 // 3600, m % 3600 // 60, m % 60) AS clock,
  printf('%04x', total_bytes & 65535) AS tag
FROM (SELECT *, mods_since_analyze AS m FROM fx_table_stats)"""
S["metric_labels"] = r"""SELECT doc_id, replace(replace(replace(query || '"\x"', '\', '\\'), '"', '\"'), chr(10), '\n') AS label FROM fx_sql_text"""
S["progress_operations"] = """SELECT target_id, pid, operation, relation, phase, CASE WHEN total > 0 THEN round(CAST(done*100 AS DOUBLE)/total*10)/10 END AS pct FROM fx_progress"""

# --- C ---
S["health_rates"] = """SELECT target_id, snapshot_id, collected_at, connections, sample_seconds, tps, commits_per_sec, rollbacks_per_sec, rollback_ratio, cache_hit_ratio, cache_blocks,
  deadlocks_per_min, temp_bytes_per_sec, tup_returned_per_sec, tup_written_per_sec,
  CASE WHEN first THEN 'unavailable' WHEN tps IS NULL OR commits_per_sec IS NULL OR rollbacks_per_sec IS NULL THEN 'reset_during_sample' ELSE 'sampled' END AS exactness FROM v_rates"""
S["health_rates_net"] = f"""
SELECT target_id, snapshot_id, CASE WHEN cb + xact_rollback >= pc + pr THEN CAST(cb + xact_rollback - pc - pr AS DOUBLE)/dt END AS tps, CASE WHEN cb >= pc THEN CAST(cb - pc AS DOUBLE)/dt END AS commits_per_sec,
  CASE WHEN cb >= pc AND xact_rollback >= pr AND cb - pc + xact_rollback - pr > 0 THEN round(CAST(xact_rollback - pr AS DOUBLE)/(cb - pc + xact_rollback - pr)*10000)/10000 END AS rollback_ratio
FROM (SELECT *, CASE WHEN xact_commit - 5*numbackends >= pc THEN xact_commit - 5*numbackends ELSE xact_commit END AS cb FROM (
  SELECT *, collected_at - lag(collected_at) OVER w AS dt, lag(xact_commit) OVER w AS pc, lag(xact_rollback) OVER w AS pr FROM fx_db_counters {LAG}))"""
S["wal_rates"] = f"""SELECT target_id, snapshot_id, round(CAST(wal_bytes - pb AS DOUBLE)/dt*100)/100 AS wal_bytes_per_sec, round(CAST(wal_records - pr AS DOUBLE)/dt*100)/100 AS wal_records_per_sec,
  CASE WHEN dt IS NULL THEN 'unavailable' ELSE 'sampled' END AS exactness FROM (SELECT *, collected_at - lag(collected_at) OVER w AS dt, lag(wal_bytes) OVER w AS pb, lag(wal_records) OVER w AS pr FROM fx_wal_io {LAG})"""
S["io_rates"] = f"""SELECT target_id, snapshot_id, checkpoints_timed, checkpoints_req, round(CAST(buffers_written - pb AS DOUBLE)/dt*100)/100 AS buffers_written_per_sec
FROM (SELECT *, collected_at - lag(collected_at) OVER w AS dt, lag(buffers_written) OVER w AS pb FROM fx_wal_io {LAG})"""
S["stats_window"] = "SELECT target_id, snapshot_id, collected_at, window_age_seconds, stats_window_days FROM v_instances"
S["counter_resets"] = f"""
SELECT target_id, snapshot_id, collected_at, prev_snapshot_id, reason, age AS age_seconds,
  CASE WHEN age >= 86400 THEN (age // 86400) || 'd ' ELSE '' END || printf('%02d:%02d:%02d', age % 86400 // 3600, age % 3600 // 60, age % 60) AS age_text
FROM (SELECT *, CASE WHEN stats_reset_at > pr THEN 'stats_reset' WHEN postmaster_start_at > pp THEN 'server_restart' END AS reason,
             collected_at - CASE WHEN stats_reset_at > pr THEN stats_reset_at ELSE postmaster_start_at END AS age
      FROM (SELECT *, lag(snapshot_id) OVER w AS prev_snapshot_id, lag(stats_reset_at) OVER w AS pr, lag(postmaster_start_at) OVER w AS pp FROM fx_db_counters {LAG})) WHERE reason IS NOT NULL"""
S["interval_mean"] = """
SELECT target_id, snapshot_id, queryid, calls - pc AS interval_calls, CASE WHEN calls > pc THEN round(CAST(total_us - pt AS DOUBLE)/((calls - pc)*1000)*10000)/10000 END AS interval_mean_ms
FROM (SELECT *, lag(calls) OVER w AS pc, lag(total_us) OVER w AS pt FROM fx_statements WINDOW w AS (PARTITION BY target_id, queryid ORDER BY collected_at)) WHERE pc IS NOT NULL"""

# --- D ---
S["activity_breakdown"] = """SELECT target_id, snapshot_id, state, wait_event_type, count(*) AS n, max(xact_age_s) AS max_xact_age_s, max(query_age_s) FILTER (state='active') AS max_active_age_s,
  count(*) FILTER (backend_type='autovacuum worker') AS autovacuum_workers, max(xact_age_s) FILTER (backend_type='autovacuum worker') AS autovacuum_max_age_s FROM fx_activity GROUP BY 1, 2, 3, 4"""
S["activity_rollup"] = "SELECT target_id, snapshot_id, total, active, idle, idle_in_transaction, waiting, longest_xact_s, longest_active_s, autovacuum_workers, av_age AS autovacuum_max_age_s FROM v_activity"
S["activity_maps"] = """
SELECT target_id, snapshot_id, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT state AS k, count(*) AS n FROM fx_activity b WHERE b.target_id = a.target_id AND b.snapshot_id = a.snapshot_id GROUP BY 1)) AS by_state,
  coalesce((SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT wait_event_type AS k, count(*) AS n FROM fx_activity b WHERE b.target_id = a.target_id AND b.snapshot_id = a.snapshot_id AND wait_event_type <> '' GROUP BY 1)), '') AS wait_events
FROM (SELECT DISTINCT target_id, snapshot_id FROM fx_activity) a"""
S["activity_maps"] = """
WITH s AS (SELECT target_id, snapshot_id, string_agg(state || '=' || n, ',' ORDER BY state) AS by_state FROM (SELECT target_id, snapshot_id, state, count(*) AS n FROM fx_activity GROUP BY 1, 2, 3) GROUP BY 1, 2),
     e AS (SELECT target_id, snapshot_id, string_agg(w || '=' || n, ',' ORDER BY w) AS wait_events FROM (SELECT target_id, snapshot_id, wait_event_type AS w, count(*) AS n FROM fx_activity WHERE wait_event_type <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT target_id, snapshot_id, by_state, wait_events FROM s FULL OUTER JOIN e USING (target_id, snapshot_id)"""
S["connection_groups"] = """SELECT target_id, snapshot_id, CASE WHEN app_name = '' THEN '(none)' ELSE app_name END AS app_name, username, state, count(*) AS n,
  row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY count(*) DESC, CASE WHEN app_name = '' THEN '(none)' ELSE app_name END, username, state) AS rank FROM fx_activity GROUP BY 1, 2, 3, 4, 5 QUALIFY rank <= 10"""
S["connection_groups"] = """SELECT *, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY n DESC, app_name, username, state) AS rank FROM (
  SELECT target_id, snapshot_id, coalesce(nullif(app_name, ''), '(none)') AS app_name, username, state, count(*) AS n FROM fx_activity GROUP BY ALL) QUALIFY rank <= 10"""
S["client_connections"] = "SELECT target_id, snapshot_id, count(*) FILTER (backend_type='client backend') AS connections_used FROM fx_activity GROUP BY 1, 2"
S["blocked_sessions"] = "SELECT target_id, snapshot_id, count(*) AS blocked, max(wait_s) AS max_wait_s FROM fx_lock_waits GROUP BY 1, 2"
_T = "(SELECT target_id, window_id, count(*) AS total FROM fx_ash GROUP BY 1, 2)"
S["wait_by_type"] = f"SELECT *, CAST(samples AS DOUBLE)/total AS share FROM (SELECT target_id, window_id, coalesce(wait_event_type, 'CPU') AS wait_type, count(*) AS samples FROM fx_ash GROUP BY 1, 2, 3) JOIN {_T} USING (target_id, window_id)"
S["wait_by_event"] = f"""SELECT *, CAST(samples AS DOUBLE)/total AS share FROM (SELECT target_id, window_id, wait_event_type AS wait_type, wait_event, count(*) AS samples FROM fx_ash
  WHERE wait_event_type IS NOT NULL AND wait_event <> '' GROUP BY 1, 2, 3, 4) JOIN {_T} USING (target_id, window_id)"""
S["wait_by_query"] = """
WITH c AS (SELECT target_id, window_id, query_id, coalesce(wait_event_type, 'CPU') AS t, coalesce(wait_event, '') AS e, count(*) AS n FROM fx_ash GROUP BY ALL),
     ty AS (SELECT * FROM (SELECT target_id, window_id, query_id, t, sum(n) AS n FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY target_id, window_id, query_id ORDER BY n DESC, t) = 1),
     ev AS (SELECT target_id, window_id, query_id, CASE WHEN e = '' THEN t ELSE t || ':' || e END AS l FROM c QUALIFY row_number() OVER (PARTITION BY target_id, window_id, query_id ORDER BY n DESC, CASE WHEN e = '' THEN t ELSE t || ':' || e END) = 1)
SELECT q.target_id, q.window_id, q.query_id, samples, total, CAST(samples AS DOUBLE)/total AS share, CAST(lock AS DOUBLE)/samples AS lock_share, CAST(io AS DOUBLE)/samples AS io_share, lock, ty.t AS top_type, ev.l AS top_event
FROM v_wait_query q JOIN ty USING (target_id, window_id, query_id) JOIN ev USING (target_id, window_id, query_id)"""
S["wait_query_text"] = """
SELECT q.target_id, q.window_id, q.query_id, samples, s.txt AS sample_text FROM v_wait_query q LEFT JOIN (
  SELECT target_id, queryid, regexp_replace(max_by(query, snapshot_id), '(^|[^$A-Za-z0-9_])\\d+(?:\\.\\d+)?\\b', '\\1?', 'g') AS txt FROM fx_statements GROUP BY 1, 2) s ON s.target_id = q.target_id AND s.queryid = q.query_id"""
S["profile_availability"] = """
SELECT target_id, window_id, attempts, failures, coalesce(n, 0) AS samples, CASE WHEN failures = attempts THEN 'unavailable' WHEN coalesce(n, 0) = 0 THEN 'idle' WHEN n < 20 THEN 'thin' ELSE 'available' END AS state
FROM (SELECT target_id, collected_at // 86400 AS window_id, count(*) AS attempts, count(*) FILTER (doc_bytes % 4 <> 0) AS failures FROM fx_snapshots GROUP BY 1, 2)
LEFT JOIN (SELECT target_id, sample_at // 86400 AS window_id, count(*) AS n FROM fx_ash GROUP BY 1, 2) USING (target_id, window_id)"""
S["wait_rollup_minute"] = "SELECT * FROM v_minute"
S["wait_rollup_merge"] = "SELECT * FROM v_minute"
S["wait_rollup_fold"] = f"""
SELECT target_id, b AS bucket_at, g AS granularity, wait_type, wait_event, CAST(sum(samples) AS BIGINT) AS samples FROM (
  SELECT *, CASE WHEN bucket_at < {AS_OF} - 7*86400 THEN 'hour' ELSE 'minute' END AS g, CASE WHEN bucket_at < {AS_OF} - 7*86400 THEN (bucket_at // 3600)*3600 ELSE bucket_at END AS b FROM v_minute)
WHERE NOT (g = 'hour' AND b < {AS_OF} - 90*86400) GROUP BY 1, 2, 3, 4, 5"""
S["partition_rollup"] = "SELECT * FROM v_partitions"
S["checksum_totals"] = "SELECT target_id, coalesce(database, '(shared objects)') AS database, CAST(sum(failures) AS BIGINT) AS failures FROM fx_checksum_failures WHERE failures > 0 GROUP BY 1, 2"
S["cluster_limits"] = """SELECT r.cluster_id, run, max(max_xid_age) AS max_xid_age, max(max_mxid_age) AS max_mxid_age, CAST(sum(connections_used) AS BIGINT) AS connections_used, count(*) AS databases
FROM v_cluster_runs r JOIN fx_instances i USING (target_id) GROUP BY 1, 2"""
S["wal_dir_size"] = "SELECT o_custkey % 25 AS target_id, CAST(year(o_orderdate) AS BIGINT) AS snapshot_id, count(*) AS wal_dir_files, CAST(sum(o_orderkey % 7 * 16) AS BIGINT) AS wal_dir_bytes FROM orders GROUP BY 1, 2"
S["unused_index_totals"] = "SELECT target_id, snapshot_id, count(*) AS indexes, CAST(sum(bytes) AS BIGINT) AS reclaimable_bytes FROM v_unused GROUP BY 1, 2"

# --- E ---
S["redundant_indexes"] = """SELECT target_id, snapshot_id, "table", index, indexrelid, bytes, count(*) FILTER (wider) AS wider_covers, min_by(covered_by, covering_id) AS covered_by FROM v_redundant_all GROUP BY ALL"""
S["redundant_pairs"] = 'SELECT target_id, snapshot_id, "table", index, covered_by, bytes, rank FROM v_redundant'
S["unindexed_fks"] = 'SELECT target_id, "table", "constraint", child_bytes FROM v_fks'
S["unused_indexes"] = 'SELECT target_id, "table", index, bytes, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY bytes DESC, indexrelid) AS rank FROM v_unused QUALIFY rank <= 50'
S["index_enrichment"] = """SELECT target_id, snapshot_id, "table", index, indexrelid, CAST(scans AS BIGINT) AS scans, bytes, method, is_unique, is_partial, backs_constraint,
  array_to_string(list_transform(indkey, lambda n: ['customerId','status_code','createdAt','HTTPStatus'][n]), ',') AS columns FROM fx_indexes"""
S["sequence_usage"] = "SELECT target_id, name, last_value, ceiling, pct_used, rank FROM v_sequences WHERE rank <= 50"
S["narrow_identity"] = "SELECT target_id, \"table\", \"column\", type FROM fx_narrow_columns WHERE type IN ('int2','int4') AND (is_identity OR owns_sequence)"
_ASOF = "FROM fx_hourly n ASOF LEFT JOIN fx_hourly b ON b.target_id = n.target_id AND b.collected_at <= n.collected_at - {0}"
S["previous_snapshot"] = "SELECT n.target_id, n.collected_at, n.k, b.collected_at AS base_collected_at, b.k AS base_k " + _ASOF.format(14400)
S["previous_run"] = f"SELECT *, lag(collected_at) OVER w AS base_collected_at, lag(k) OVER w AS base_k FROM fx_hourly {LAG}"
S["baseline_choice"] = f"""
SELECT p.target_id, p.collected_at, p.k, coalesce(a.base_collected_at, lc) AS base_collected_at, CASE WHEN a.base_collected_at IS NOT NULL THEN a.base_k ELSE lk END AS base_k
FROM (SELECT *, lag(collected_at) OVER w AS lc, lag(k) OVER w AS lk FROM fx_hourly {LAG}) p
JOIN (SELECT n.target_id, n.collected_at, b.collected_at AS base_collected_at, b.k AS base_k {_ASOF.format(5400)}) a ON a.target_id = p.target_id AND a.collected_at = p.collected_at"""
S["same_hour_yesterday"] = """
SELECT n.target_id, n.collected_at, n.k, b.collected_at AS base_collected_at, b.k AS base_k FROM fx_hourly n LEFT JOIN fx_hourly b
  ON b.target_id = n.target_id AND b.collected_at BETWEEN n.collected_at - 86400 - 1800 AND n.collected_at - 86400 + 1800
QUALIFY row_number() OVER (PARTITION BY n.target_id, n.collected_at ORDER BY abs(b.collected_at - (n.collected_at - 86400)), b.collected_at) = 1"""
S["diff_since"] = """
SELECT n.target_id, n.snapshot_id, b.snapshot_id AS base_snapshot_id, CAST(608400 AS BIGINT) AS requested_seconds, n.collected_at - b.collected_at AS actual_seconds,
  n.collected_at - b.collected_at > 1.25*608400 AS stretched,
  CASE WHEN n.stats_reset_at > b.stats_reset_at THEN 'stats_reset' WHEN n.postmaster_start_at > b.postmaster_start_at THEN 'server_restart' END AS reset_reason,
  n.blks_read // 5000 > b.blks_read // 5000 AS statements_evicted
FROM (SELECT * FROM fx_db_counters QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY collected_at DESC) = 1) n
ASOF JOIN fx_db_counters b ON b.target_id = n.target_id AND b.collected_at <= n.collected_at - 608400"""
S["relation_schema"] = "SELECT target_id, snapshot_id, kind, count(*) AS objects FROM fx_schema_objects WHERE identity = 'public.Brand#7' OR identity LIKE 'public.Brand#7.%' GROUP BY 1, 2, 3"

# --- F ---
S["schema_fingerprint"] = """
SELECT *, left(sha256(kind || chr(0) || identity || chr(0) || definition), 16) AS definition_hash FROM (
  SELECT target_id, 'index' AS kind, schema || '.' || "table" || '.' || index AS identity, method || ' ' || array_to_string(indkey, ',') AS definition FROM fx_indexes
  UNION ALL SELECT target_id, 'constraint', schema || '.' || "table" || '.' || "constraint", array_to_string(conkey, ',') FROM fx_foreign_keys
  UNION ALL SELECT target_id, 'sequence', schema || '.' || name, type FROM fx_sequences
  UNION ALL SELECT target_id, 'column', schema || '.' || "table" || '.' || "column", type FROM fx_narrow_columns
  UNION ALL SELECT DISTINCT target_id, 'table', schema || '.' || "table", 'r' FROM fx_indexes
  UNION ALL SELECT target_id, 'extension', provider, '1.0' FROM fx_targets)"""
S["horizon_holders"] = """SELECT target_id, snapshot_id, source, holder, xmin_age, age_s, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY xmin_age DESC, holder) AS rank
FROM fx_horizon WHERE xmin_age > 0 QUALIFY rank <= 10"""
S["settings_kinds"] = """
SELECT target_id, 'override' AS kind, name, CASE WHEN regexp_matches(name, '(?i)(password|_key$|^ssl_.*_file$)') THEN '«redacted»' ELSE value END AS value FROM fx_params
WHERE value <> CASE WHEN name = 'work_mem' THEN '4MB' WHEN value IN ('on','off') THEN 'on' ELSE '' END
UNION ALL SELECT target_id, 'tuning', name, value FROM fx_params WHERE name IN ('work_mem','max_connections','fsync','autovacuum')"""

# --- G ---
_VQ = r"""
SELECT target_id, snapshot_id, queryid, {rank} AS rank, calls, total_us, round(CAST(total_us AS DOUBLE)/all_us*10000)/10000 AS share,
  round(CAST(total_us AS DOUBLE)/1000.0/calls*10000)/10000 AS mean_ms, round(CAST(blks_hit AS DOUBLE)/(blks_hit + blks_read)*10000)/10000 AS cache_hit,
  regexp_replace(query, '(^|[^$A-Za-z0-9_])\d+(?:\.\d+)?\b', '\1?', 'g') AS query
FROM (SELECT *, CAST(sum(total_us) OVER (PARTITION BY target_id, snapshot_id) AS DOUBLE) AS all_us, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY total_us DESC, queryid) AS r
      FROM v_workload QUALIFY r <= 20)"""
S["top_queries"] = _VQ.format(rank="r")
S["queries_by_calls"] = _VQ.format(rank="row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY calls DESC, queryid)")
S["top_selects"] = r"""
SELECT target_id, snapshot_id, queryid, calls, round(CAST(total_us AS DOUBLE)*100/all_us*1000000)/1000000 AS share_pct, rank FROM (
  SELECT *, CAST(sum(total_us) OVER (PARTITION BY target_id, snapshot_id) AS DOUBLE) AS all_us, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY total_us DESC, queryid) AS rank
  FROM fx_statements WHERE regexp_matches(query, '(?i)^\s*select\b') AND calls > 0 QUALIFY rank <= 15)"""
S["retention_thin"] = f"""
SELECT * FROM fx_snapshots WHERE collected_at >= {AS_OF} - 7*86400 UNION ALL
SELECT * FROM fx_snapshots WHERE collected_at < {AS_OF} - 7*86400 AND collected_at >= {AS_OF} - 90*86400
QUALIFY row_number() OVER (PARTITION BY target_id, collected_at // 3600 ORDER BY snapshot_id DESC) = 1"""
S["history_budget"] = """
WITH x AS (SELECT *, row_number() OVER (ORDER BY collected_at, snapshot_id) AS rn, count(*) OVER () AS n, CAST(sum(doc_bytes) OVER () AS BIGINT) AS size FROM fx_snapshots)
SELECT snapshot_id, target_id, collected_at, doc_bytes FROM x
WHERE rn > CASE WHEN size > size*3 // 5 THEN least(greatest(CAST(ceil(CAST(n*(size - (size*3 // 5)*9 // 10) AS DOUBLE)/size) AS BIGINT), 1), n - 1) ELSE 0 END"""
S["latest_two_schemas"] = """
SELECT target_id, snapshot_id, kind, identity, CAST(dense_rank() OVER (PARTITION BY target_id ORDER BY snapshot_id DESC) AS BIGINT) AS age_rank FROM fx_schema_objects QUALIFY age_rank <= 2"""
S["trend"] = """
SELECT target_id, count(*) AS points, min_by(cache_hit_ratio, collected_at) AS oldest_value, max_by(cache_hit_ratio, collected_at) AS newest_value, sum(round(cache_hit_ratio*10000)) AS series_sum
FROM (SELECT * FROM v_rates WHERE cache_hit_ratio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY collected_at DESC) <= 24) GROUP BY 1"""
S["recent_events"] = """SELECT target_id, snapshot_id, object, before, after, row_number() OVER (PARTITION BY target_id ORDER BY occurred_before DESC, kind, object) AS rank FROM v_config QUALIFY rank <= 5"""
EXTRA["v_dead_rules"] = """
SELECT target_id, rule, run, count(*) OVER (PARTITION BY target_id, rule, g ORDER BY run) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS misses
FROM (SELECT *, sum(CASE WHEN matched THEN 1 ELSE 0 END) OVER (PARTITION BY target_id, rule ORDER BY run) AS g FROM fx_rule_runs) QUALIFY misses >= 5"""
S["dead_rules"] = "SELECT * FROM v_dead_rules"
S["unused_rule_findings"] = "SELECT target_id, run AS snapshot_id, 'suppression_unused' AS id, 'info' AS severity, CAST(5 AS DOUBLE) AS score, CAST(0.7 AS DOUBLE) AS confidence, count(*) AS n_rules FROM v_dead_rules GROUP BY 1, 2"
EXTRA["v_mean_deltas"] = """
SELECT *, round(b_mean*10000)/10000 AS before, round(mean*10000)/10000 AS after FROM v_query_deltas WHERE b_mean > 0 AND abs(mean - b_mean) >= 5 AND abs((mean - b_mean)/b_mean) >= 0.5"""
S["worst_slowdown"] = """
SELECT target_id, snapshot_id, 'queryid ' || queryid AS subject, round(after/before*10000)/10000 AS factor FROM v_mean_deltas WHERE before > 0 AND after >= 10 AND after/before >= 2
QUALIFY row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY after/before DESC, 'queryid ' || queryid DESC) = 1"""

# --- H, I ---
_D = "CAST(NULL AS DOUBLE) AS pct_change"
S["delta_query_new"] = f"""SELECT target_id, snapshot_id, 'queryid ' || queryid AS subject, 'info' AS severity, CAST(0 AS DOUBLE) AS before, round(CAST(total_us AS DOUBLE)/1000.0*10)/10 AS after, {_D}, collected_at AS first_observed
FROM v_query_deltas WHERE b_calls IS NULL"""
S["delta_query_mean"] = """SELECT target_id, snapshot_id, 'queryid ' || queryid AS subject, CASE WHEN mean > b_mean THEN 'warn' ELSE 'info' END AS severity, before, after,
  round((mean - b_mean)/b_mean*10000)/10000 AS pct_change, base_at AS first_observed FROM v_mean_deltas"""
S["delta_table_seq"] = """SELECT target_id, snapshot_id, subject, 'warn' AS severity, CAST(b_seq AS DOUBLE) AS before, CAST(seq_scans AS DOUBLE) AS after,
  CASE WHEN b_seq <> 0 THEN round((CAST(seq_scans AS DOUBLE) - b_seq)/b_seq*10000)/10000 END AS pct_change, base_at AS first_observed FROM v_table_pairs WHERE seq_scans > b_seq*2 AND seq_scans - b_seq >= 1000"""
S["delta_dead_ratio"] = f"SELECT target_id, snapshot_id, subject, 'warn' AS severity, round(b_dead*10000)/10000 AS before, round(dead_ratio*10000)/10000 AS after, {_D}, base_at AS first_observed FROM v_table_pairs WHERE dead_ratio - b_dead >= CAST(0.1 AS DOUBLE)"


def _step(src: str, value: str, where: str, severity: str, pct: bool, subject: str = "'db' || target_id", rnd: str = "{0}") -> str:
    p = "CASE WHEN b <> 0 THEN round((CAST(v AS DOUBLE) - b)/b*10000)/10000 END AS pct_change" if pct else _D
    return f"""SELECT target_id, snapshot_id, {subject} AS subject, {severity} AS severity, CAST({rnd.format('b')} AS DOUBLE) AS before, CAST({rnd.format('v')} AS DOUBLE) AS after, {p}, bt AS first_observed
FROM (SELECT *, lag(v) OVER w AS b, lag(collected_at) OVER w AS bt FROM (SELECT *, {value} AS v FROM {src}) {LAG}) WHERE {where}"""


S["delta_database_size"] = _step("(SELECT target_id, snapshot_id, max(collected_at) AS collected_at, CAST(sum(total_bytes) AS BIGINT) AS s FROM fx_table_stats GROUP BY 1, 2)", "s",
                                 "b > 0 AND v - b >= 104857600 AND CAST(v - b AS DOUBLE)/b >= 0.1", "'info'", True)
_CONN = "b > 0 AND abs(v - b) >= 20 AND CAST(abs(v - b) AS DOUBLE)/b >= 0.5"
S["delta_connections"] = _step("fx_db_counters", "numbackends*6", _CONN, "CASE WHEN v > b THEN 'warn' ELSE 'info' END", True)
S["delta_receiver_lag"] = _step("(SELECT target_id, snapshot_id, max(collected_at) AS collected_at, max(replay_lag_sec) AS l FROM fx_replicas GROUP BY 1, 2)", "l", "v - b >= 30", "'warn'", False, rnd="round({0}*100)/100")
S["delta_archiver_failures"] = _step("fx_wal_io", "checkpoints_req", "v - b > 0", "'warn'", False, "'archiver'")
S["standby_gone"] = f"SELECT target_id, snapshot_id, standby AS subject, 'warn' AS severity, CAST(1 AS DOUBLE) AS before, CAST(0 AS DOUBLE) AS after, {_D}, base_at AS first_observed FROM v_gone"
S["comparable_deltas"] = f"""SELECT target_id, snapshot_id, CAST(b AS DOUBLE) AS before, CAST(v AS DOUBLE) AS after
FROM (SELECT *, lag(v) OVER w AS b, lag(stats_reset_at) OVER w AS pr, lag(postmaster_start_at) OVER w AS pp FROM (SELECT *, numbackends*6 AS v FROM fx_db_counters) {LAG})
WHERE {_CONN} AND NOT (stats_reset_at > pr) AND NOT (postmaster_start_at > pp)"""
EXTRA["v_epochs"] = f"""
SELECT target_id, snapshot_id, collected_at, CAST(sum(CASE WHEN why IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY target_id ORDER BY collected_at) AS BIGINT) AS epoch,
       last_value(why IGNORE NULLS) OVER (PARTITION BY target_id ORDER BY collected_at ROWS UNBOUNDED PRECEDING) AS reason
FROM (SELECT *, CASE WHEN stats_reset_at > lag(stats_reset_at) OVER w THEN 'stats_reset' WHEN postmaster_start_at > lag(postmaster_start_at) OVER w THEN 'server_restart' END AS why
      FROM fx_close_counters {LAG})"""
EXTRA["v_close_heads"] = """
SELECT e.*, coalesce(aged.snapshot_id, prev.snapshot_id) AS base_snapshot_id, coalesce(aged.collected_at, prev.collected_at) AS base_at, coalesce(aged.epoch, prev.epoch) AS base_epoch
FROM v_epochs e ASOF LEFT JOIN v_epochs aged ON aged.target_id = e.target_id AND e.collected_at - 900 >= aged.collected_at
                ASOF LEFT JOIN v_epochs prev ON prev.target_id = e.target_id AND e.collected_at > prev.collected_at"""
EXTRA["v_close_deltas"] = """
SELECT h.target_id, h.snapshot_id, 'queryid ' || n.queryid AS subject, h.base_at, CAST(b.total_us AS DOUBLE)/1000/b.calls AS b_mean, CAST(n.total_us AS DOUBLE)/1000/n.calls AS mean
FROM v_close_heads h JOIN fx_close_statements n ON n.target_id = h.target_id AND n.snapshot_id = h.snapshot_id
JOIN fx_close_statements b ON b.target_id = h.target_id AND b.snapshot_id = h.base_snapshot_id AND b.queryid = n.queryid
WHERE h.epoch = h.base_epoch AND abs(CAST(n.total_us AS DOUBLE)/1000/n.calls - CAST(b.total_us AS DOUBLE)/1000/b.calls) >= 5
  AND abs((CAST(n.total_us AS DOUBLE)/1000/n.calls - CAST(b.total_us AS DOUBLE)/1000/b.calls)/(CAST(b.total_us AS DOUBLE)/1000/b.calls)) >= 0.5"""
S["reset_epochs"] = "SELECT target_id, snapshot_id, epoch, reason FROM v_epochs"
S["suppressed_deltas"] = "SELECT target_id, snapshot_id, base_snapshot_id, base_at, reason, epoch - base_epoch AS resets FROM v_close_heads WHERE epoch > base_epoch"
S["deltas_within_epochs"] = """SELECT target_id, snapshot_id, subject, CASE WHEN mean > b_mean THEN 'warn' ELSE 'info' END AS severity, round(b_mean, 4) AS before, round(mean, 4) AS after, base_at AS first_observed FROM v_close_deltas"""
S["slowdowns_within_epochs"] = grouped("(SELECT *, mean/b_mean AS factor FROM v_close_deltas)", "query_slowdown", "mean >= 10 AND mean/b_mean >= 2", "latency", "least(90.0, 30 + max(factor)*10)", "0.8", named=False)
S["schema_diff"] = """
WITH h AS (SELECT target_id, snapshot_id, lag(snapshot_id) OVER w AS base FROM (SELECT DISTINCT target_id, snapshot_id FROM fx_schema_objects) WINDOW w AS (PARTITION BY target_id ORDER BY snapshot_id)),
     cur AS (SELECT o.*, base FROM fx_schema_objects o JOIN h USING (target_id, snapshot_id) WHERE base IS NOT NULL),
     old AS (SELECT h.target_id, h.snapshot_id, h.base, o.kind, o.identity, o.definition FROM h JOIN fx_schema_objects o ON o.target_id = h.target_id AND o.snapshot_id = h.base)
SELECT target_id, snapshot_id, 'schema.' || CASE WHEN old.definition IS NULL THEN kind || '_created' WHEN cur.definition IS NULL THEN kind || '_dropped' WHEN kind = 'column' THEN 'column_type_changed' ELSE kind || '_changed' END AS kind,
  identity AS object, old.definition AS before, cur.definition AS after, coalesce(cur.base, old.base)*86400 AS occurred_after, snapshot_id*86400 AS occurred_before, CAST(0.5 AS DOUBLE) AS confidence
FROM cur FULL OUTER JOIN old USING (target_id, snapshot_id, kind, identity) WHERE cur.definition IS DISTINCT FROM old.definition"""
S["config_diff"] = "SELECT * FROM v_config"
S["lifecycle_events"] = f"""
WITH p AS (SELECT *, lag(collected_at) OVER w AS prev FROM fx_db_counters {LAG})
SELECT target_id, snapshot_id, 'stats.reset' AS kind, 'db' || target_id AS object, stats_reset_at AS occurred_after, stats_reset_at AS occurred_before, CAST(1 AS DOUBLE) AS confidence FROM p WHERE stats_reset_at > prev
UNION ALL SELECT target_id, snapshot_id, 'server.restarted', 'db' || target_id, postmaster_start_at, postmaster_start_at, CAST(1 AS DOUBLE) FROM p WHERE postmaster_start_at > prev"""

# --- J ---
for _id, _fam in FAMILY_OF.items():
    S["finding_" + _id] = f"SELECT * FROM v_family_{_fam} WHERE id = '{_id}'"


def _all(fams=FAMILIES) -> str:
    return " UNION ALL ".join(f"SELECT * FROM v_family_{f}" for f in fams)


def _ids(ids: list[str]) -> str:
    return "(" + ", ".join(f"'{i}'" for i in ids) + ")"


from vitalgrid.plans.records import MEANING  # noqa: E402
from vitalgrid.plans.rule_catalog import ADVICE, BUILD_RUNNING_GUARD, CLUSTER_WIDE_IDS, GUARDS, RULES, SCHEMA_IDS, TUNING_IDS  # noqa: E402

S["fleet_findings"] = _all()
S["tuning_view"] = f"SELECT * FROM ({_all()}) WHERE id IN {_ids(TUNING_IDS)}"
S["schema_profile"] = f"SELECT * FROM ({_all()}) WHERE id IN {_ids(SCHEMA_IDS)}"
S["tuned_thresholds"] = """
SELECT target_id, snapshot_id, 'table_bloat' AS id, count(*) AS n FROM v_tables WHERE dead_ratio >= CASE WHEN target_id % 2 = 0 THEN 0.3 ELSE 0.2 END AND live_tuples + dead_tuples >= 10000 GROUP BY 1, 2
UNION ALL SELECT target_id, snapshot_id, 'unused_indexes', count(*) FROM v_unused WHERE bytes >= CASE WHEN target_id % 2 = 0 THEN 100000 ELSE 1048576 END GROUP BY 1, 2"""
S["finding_evidence"] = """
SELECT target_id, snapshot_id, id, object, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (
  SELECT * FROM v_evidence WHERE id IN ('table_bloat','seq_scan_heavy')
  UNION ALL SELECT target_id, snapshot_id, 'fk_unindexed', 'public.' || "table", child_bytes FROM v_fks
  UNION ALL SELECT target_id, snapshot_id, 'sequence_exhaustion', 'public.' || name, 0 FROM v_sequences WHERE pct_used >= 0.8
  UNION ALL SELECT target_id, snapshot_id, 'index_invalid', identity, bytes FROM fx_schema_objects WHERE kind = 'index' AND invalid) GROUP BY ALL"""
_guards = " UNION ALL ".join(f"SELECT '{i}' AS id, '{g[0]}' AS guard_id, '{g[1]}' AS kind, '{g[2]}' AS action" for i, gs in GUARDS.items() for g in gs)
_BUILDING = "(id = 'index_invalid' AND EXISTS (SELECT 1 FROM fx_progress p WHERE p.operation = 'create_index' AND p.target_id = f.target_id AND p.snapshot_id = f.snapshot_id))"
S["guard_rows"] = f"""
SELECT target_id, snapshot_id, id, object, guard_id, kind, action, kind = 'precondition' AS clearable FROM ({_all()}) f JOIN ({_guards}) USING (id) WHERE NOT {_BUILDING}
UNION ALL SELECT target_id, snapshot_id, id, object, '{BUILD_RUNNING_GUARD[0]}', '{BUILD_RUNNING_GUARD[1]}', '{BUILD_RUNNING_GUARD[2]}', false FROM ({_all()}) f WHERE {_BUILDING}"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_meanings = " UNION ALL ".join(
    f"SELECT '{r[0]}' AS id, {str(r[5]).lower()} AS cluster_scoped, '{r[7]}' AS related, {_quoted(ADVICE[r[0]])} AS remediation, {_quoted(MEANING[r[0]][0])} AS detail, {_quoted(MEANING[r[0]][1])} AS basis, "
    f"CAST({len(GUARDS.get(r[0], []))} AS BIGINT) AS guards" for r in RULES)
S["finding_records"] = f"SELECT target_id, snapshot_id, id, object, cluster_scoped, related, remediation, detail, basis, dimension, score, guards FROM ({_all()}) JOIN ({_meanings}) USING (id)"
S["assembled_documents"] = _all(["slots", "subscriptions", "horizon", "checksums"])
_rank = "CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END"
S["findings_order"] = f"""SELECT target_id, snapshot_id, id, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY dimension = 'risk' DESC, score DESC, {_rank} DESC, id, object) AS ordinal
FROM ({_all()})"""

# --- K ---
# The active rules: two exact or class rules and a blanket one; the wide glob has expired.
EXTRA["v_row_match"] = """
SELECT *, CASE WHEN id = 'table_bloat' AND object = 'public.t1' THEN 3 WHEN id = 'table_bloat' AND object IN ('public.t2','public.t3') THEN 2
   WHEN id = 'seq_scan_heavy' THEN 2 WHEN id = 'never_analyzed' THEN 2 END AS spec,
   CASE WHEN id = 'table_bloat' AND object = 'public.t1' THEN 0 WHEN id = 'table_bloat' AND object IN ('public.t2','public.t3') THEN 1
   WHEN id = 'seq_scan_heavy' THEN 4 WHEN id = 'never_analyzed' THEN 6 END AS ordinal FROM v_evidence"""
_rule_texts = "['table_bloat:public.t1','table_bloat:public.t[23]','','seq_scan_heavy','seq_scan_heavy:public.t?','replication_slot_inactive:slot:slot1*','never_analyzed:public.*'][ordinal + 1]"
S["suppression_match"] = "SELECT target_id, snapshot_id, id, object, CAST(spec AS BIGINT) AS spec, CAST(ordinal AS BIGINT) AS ordinal FROM v_row_match"
S["suppress_rows"] = f"SELECT target_id, snapshot_id, id, object, {_rule_texts} AS muted_by FROM v_row_match"
EXTRA["v_muted"] = f"""
WITH per AS (SELECT target_id, snapshot_id, id, count(*) AS cut, max_by(ordinal, [-total_bytes, 0]) AS ordinal FROM (
       SELECT m.*, t.total_bytes FROM v_row_match m JOIN v_tables t ON t.target_id = m.target_id AND t.snapshot_id = m.snapshot_id AND 'public.' || t."table" = m.object) WHERE spec IS NOT NULL GROUP BY 1, 2, 3),
     f AS (SELECT f.*, coalesce(cut, 0) AS cut, per.ordinal FROM ({_all(['tables', 'slots'])}) f LEFT JOIN per USING (target_id, snapshot_id, id)),
     g AS (SELECT *, CASE WHEN id = 'seq_scan_heavy' THEN 3 WHEN id = 'replication_slot_inactive' AND object LIKE 'slot:slot1%' THEN 5 WHEN n_objects > 0 AND cut = n_objects THEN ordinal END AS ord FROM f)
SELECT target_id, snapshot_id, id, object, severity, CASE WHEN ord IS NULL AND n_objects > 0 THEN n_objects - cut ELSE n_objects END AS n_objects, ord IS NOT NULL AS suppressed, ord FROM g"""
S["suppress_findings"] = f"""SELECT target_id, snapshot_id, id, object, n_objects, suppressed, {_rule_texts.replace('ordinal', 'ord')} AS suppression_rule,
  ['known','batch tables','','analytics fleet','small tables','managed elsewhere',''][ord + 1] AS suppression_reason FROM v_muted"""
S["severity_remap"] = f"""SELECT target_id, snapshot_id, id, CASE id WHEN 'table_bloat' THEN 'critical' WHEN 'never_analyzed' THEN 'info' WHEN 'seq_scan_heavy' THEN 'warn' ELSE severity END AS severity,
  CASE WHEN severity <> CASE id WHEN 'table_bloat' THEN 'critical' WHEN 'never_analyzed' THEN 'info' WHEN 'seq_scan_heavy' THEN 'warn' ELSE severity END THEN severity END AS severity_remapped FROM ({_all()})"""
S["explain_rules"] = f"""SELECT DISTINCT id, object, CASE WHEN spec IS NOT NULL THEN 'suppressed' WHEN id = 'table_bloat' THEN 'glob does not match' WHEN id = 'low_hot_update_ratio' THEN 'glob does not match' ELSE 'no rule' END AS outcome,
  CASE WHEN spec IS NOT NULL THEN {_rule_texts} WHEN id = 'table_bloat' THEN 'table_bloat:public.t1' WHEN id = 'low_hot_update_ratio' THEN 'low_hot_update_ratio:t*' END AS rule FROM v_row_match"""
S["expired_rules"] = """SELECT target_id, snapshot_id, 'suppression_expired' AS id, 'info' AS severity, CAST(5 AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS confidence,
  'table_bloat:public.*' AS rule FROM fx_instances"""
EXTRA["v_config_rules"] = """SELECT p_partkey AS ordinal, ['table_bloat','tabel_bloat','fsync_off',''][p_partkey % 4 + 1] AS finding,
  CASE p_partkey % 5 WHEN 0 THEN '[x' || p_partkey WHEN 1 THEN 'public.*' END AS object, ['soon','2030-02-30','2030-01-31'][p_partkey % 3 + 1] AS expires FROM part"""
S["config_warnings"] = """
SELECT kind, subject, message, count(*) AS n FROM (
  SELECT 'ignore' AS kind, CAST(ordinal AS VARCHAR) AS subject, 'rule names no finding' AS message FROM v_config_rules WHERE finding = ''
  UNION ALL SELECT 'ignore', finding, 'unknown finding id; the rule will never match' FROM v_config_rules WHERE finding = 'tabel_bloat'
  UNION ALL SELECT 'ignore', object, 'invalid glob; rule ignored' FROM v_config_rules WHERE object LIKE '[x%'
  UNION ALL SELECT 'ignore', expires, 'not a YYYY-MM-DD date; treated as no expiry' FROM v_config_rules WHERE try_cast(expires AS DATE) IS NULL
  UNION ALL SELECT 'severity', 'bogus', 'unknown finding id; ignored' FROM supplier WHERE s_suppkey % 2 <> 0
  UNION ALL SELECT 'severity', 'table_bloat', 'unknown severity; ignored' FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0
  UNION ALL SELECT 'threshold', 'other', 'unknown threshold key' FROM supplier WHERE s_suppkey % 3 = 2
  UNION ALL SELECT 'threshold', 'dead_ratio_warn', 'value out of range' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 <> 2
  UNION ALL SELECT 'threshold', 'replica_lag_warn_seconds', 'value out of range' FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 4 = 0) GROUP BY 1, 2, 3"""
S["hygiene_warnings"] = "SELECT CASE WHEN coalesce(object, '') = '' THEN finding ELSE finding || ':' || object END AS rule, count(*) AS n FROM v_config_rules WHERE expires = 'soon' GROUP BY 1"
S["evidence_preview"] = """
SELECT target_id, snapshot_id, string_agg('public.' || index, ',' ORDER BY bytes DESC, 'public.' || index) FILTER (r <= 10) || CASE WHEN max(r) > 10 THEN ',…' ELSE '' END AS objects
FROM (SELECT *, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY bytes DESC, 'public.' || index) AS r FROM v_unused WHERE bytes >= 1048576) GROUP BY 1, 2"""
S["inline_rules"] = """SELECT target_id + 1000000 AS ordinal, CASE target_id % 3 WHEN 0 THEN 'table_bloat' ELSE 'io_timing_off' END AS finding, CASE WHEN target_id % 3 = 0 THEN 'public.t' || target_id END AS object
FROM fx_targets WHERE target_id % 3 <> 2"""
S["seed_rules"] = f"SELECT DISTINCT id, object, '2026-04-15' AS expires FROM ({_all(['tables', 'slots'])})"
EXTRA["v_preexisting"] = f"""
WITH h AS (SELECT target_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY target_id ORDER BY snapshot_id) AS base FROM (SELECT DISTINCT target_id, snapshot_id FROM fx_table_stats)),
     r AS (SELECT e.*, {_rank} AS rk FROM v_evidence e JOIN v_family_tables USING (target_id, snapshot_id, id)),
     j AS (SELECT r.target_id, r.snapshot_id, r.id, coalesce(b.rk >= r.rk, false) AS old FROM r JOIN h USING (target_id, snapshot_id)
           LEFT JOIN r b ON b.target_id = r.target_id AND b.snapshot_id = h.base AND b.id = r.id AND b.object = r.object)
SELECT f.target_id, f.snapshot_id, f.id, f.severity, o.preexisting FROM v_family_tables f JOIN (SELECT target_id, snapshot_id, id, bool_and(old) AS preexisting FROM j GROUP BY 1, 2, 3) o USING (target_id, snapshot_id, id)"""
S["mark_preexisting"] = "SELECT target_id, snapshot_id, id, preexisting FROM v_preexisting"
S["gate_new_only"] = f"SELECT target_id, snapshot_id, CAST(max(CASE WHEN NOT preexisting AND {_rank} >= 2 THEN CASE WHEN {_rank} = 3 THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS verdict FROM v_preexisting GROUP BY 1, 2"
S["base_problems"] = """SELECT target_id, CASE WHEN target_id % 5 = 0 THEN 'base has no schema version' WHEN target_id % 5 = 1 THEN 'schema versions are incompatible' ELSE 'profiles differ' END AS problem
FROM fx_targets WHERE target_id % 5 IN (0, 1) OR target_id % 7 = 0"""
EXTRA["v_cluster_runs"] = """
WITH s AS (SELECT *, sum(fresh) OVER (PARTITION BY cluster_id ORDER BY collected_at) AS session FROM (
       SELECT *, CASE WHEN collected_at - max(collected_at) OVER (PARTITION BY cluster_id ORDER BY collected_at RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 300 THEN 0 ELSE 1 END AS fresh
       FROM (SELECT DISTINCT cluster_id, collected_at FROM fx_cluster_snapshots))),
     n AS (SELECT c.*, session, row_number() OVER (PARTITION BY c.cluster_id, session, database ORDER BY c.collected_at) AS nth FROM fx_cluster_snapshots c JOIN s ON s.cluster_id = c.cluster_id AND s.collected_at = c.collected_at),
     p AS (SELECT *, max(nth) OVER (PARTITION BY cluster_id, session ORDER BY collected_at) AS part FROM n)
SELECT target_id, cluster_id, database, collected_at, min(collected_at) OVER (PARTITION BY cluster_id, session, part) AS run FROM p"""
EXTRA["v_clustered"] = f"SELECT f.*, t.cluster_id, t.database, t.run FROM ({_all()}) f JOIN v_cluster_runs t USING (target_id)"
S["cluster_runs"] = "SELECT target_id, cluster_id, collected_at, run FROM v_cluster_runs"
S["cluster_dedupe"] = f"""
SELECT c.cluster_id, c.run, target_id, snapshot_id, id, CASE WHEN id IN {_ids(CLUSTER_WIDE_IDS)} THEN object WHEN object = '' THEN 'db:' || database ELSE 'db:' || database || '/' || object END AS object, id IN {_ids(CLUSTER_WIDE_IDS)} AS cluster_scoped
FROM v_clustered c WHERE NOT id IN {_ids(CLUSTER_WIDE_IDS)} OR database = (SELECT min(database) FROM v_clustered x WHERE x.cluster_id = c.cluster_id AND x.run = c.run AND x.id = c.id)"""
S["fleet_rollup"] = f"SELECT id, severity, count(*) AS findings, count(DISTINCT target_id) AS targets FROM ({_all()}) GROUP BY 1, 2"
_score = "greatest(0, 100 - CAST(sum({0}CASE severity WHEN 'critical' THEN 10 WHEN 'warn' THEN 3 ELSE 1 END{1}) AS BIGINT))"
S["health_score"] = f"SELECT target_id, snapshot_id, count(*) AS findings, CAST({_score.format('', '')} AS BIGINT) AS health_score FROM ({_all()}) GROUP BY 1, 2"
S["scored_findings"] = S["health_score"]
S["redundant_totals"] = """SELECT target_id, snapshot_id, count(*) AS indexes, CAST(sum(bytes) AS BIGINT) AS reclaimable_bytes
FROM (SELECT DISTINCT target_id, snapshot_id, index, bytes FROM v_redundant_all) GROUP BY 1, 2"""
S["health_score_muted"] = f"SELECT target_id, snapshot_id, count(*) AS findings, CAST({_score.format('CASE WHEN suppressed THEN 0 ELSE ', ' END')} AS BIGINT) AS health_score FROM v_muted GROUP BY 1, 2"
S["gate_verdict"] = f"SELECT target_id, snapshot_id, CAST(max(CASE severity WHEN 'critical' THEN 2 ELSE 0 END) AS BIGINT) AS verdict FROM ({_all()}) GROUP BY 1, 2"
S["cluster_gate"] = "SELECT cluster_id, run, CAST(max(CASE severity WHEN 'critical' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS BIGINT) AS verdict FROM v_clustered GROUP BY 1, 2"
S["findings_total"] = f"SELECT target_id, snapshot_id, count(*) FILTER (severity='critical') AS critical, count(*) FILTER (severity='warn') AS warn, count(*) FILTER (severity='info') AS info FROM ({_all()}) GROUP BY 1, 2"
def _tenths(x: str, unit: int, mark: str) -> str:
    """A whole number in tenths of a unit, ties to even."""
    u = unit // 10
    t = f"({x}//{u} + CASE WHEN 2*({x}%{u}) > {u} OR (2*({x}%{u}) = {u} AND {x}//{u}%2 = 1) THEN 1 ELSE 0 END)"
    return f"({t}//10) || '.' || ({t}%10) || '{mark}'"


S["status_board"] = f"""
WITH g AS (SELECT i.*, coalesce(max({_rank}) FILTER (id = 'connection_saturation'), 0) AS sc, coalesce(max({_rank}) FILTER (id IN ('txid_wraparound')), 0) AS sw
           FROM (SELECT target_id, snapshot_id, connections_used, connections_max, max_xid_age, checkpoints_req, replica_count, is_replica, wal_bytes_per_sec FROM v_instances) i LEFT JOIN ({_all()}) f USING (target_id, snapshot_id) GROUP BY ALL)
SELECT target_id, snapshot_id, 'connections' AS subsystem, CASE sc WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'ok' END AS status, connections_used || '/' || connections_max AS value, '' AS note FROM g
UNION ALL SELECT target_id, snapshot_id, 'wraparound', CASE sw WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'ok' END,
  CASE WHEN max_xid_age >= 1000000000 THEN {_tenths('max_xid_age', 1000000000, 'G')} WHEN max_xid_age >= 1000000 THEN {_tenths('max_xid_age', 1000000, 'M')}
       WHEN max_xid_age >= 1000 THEN {_tenths('max_xid_age', 1000, 'k')} ELSE CAST(max_xid_age AS VARCHAR) END, '' FROM g
UNION ALL SELECT target_id, snapshot_id, 'WAL', 'ok', CAST(floor(wal_bytes_per_sec) AS BIGINT) || ' B/s', '' FROM g WHERE wal_bytes_per_sec IS NOT NULL
UNION ALL SELECT target_id, snapshot_id, 'checkpoints', 'ok', 'timed', CASE WHEN checkpoints_req > 0 THEN checkpoints_req || ' forced' ELSE 'none forced' END FROM g
UNION ALL SELECT target_id, snapshot_id, 'replication', 'ok', CASE WHEN is_replica THEN 'replica' WHEN replica_count > 0 THEN replica_count || ' up' ELSE 'none' END, '' FROM g"""
S["healthy_checks"] = f"""
WITH f AS (SELECT target_id, list(id) AS fired FROM ({_all()}) WHERE snapshot_id = 0 GROUP BY 1),
     c AS (SELECT i.target_id, i.snapshot_id, unnest([
       {{'o': 1, 'c': CASE WHEN is_replica OR replica_count > 0 THEN 'standbys attached' END}},
       {{'o': 2, 'c': CASE WHEN max_xid_age > 0 AND NOT list_contains(coalesce(fired, []), 'txid_wraparound') THEN 'transaction ids far from wrapping' END}},
       {{'o': 3, 'c': CASE WHEN NOT list_contains(coalesce(fired, []), 'connection_saturation') THEN 'room for more connections' END}},
       {{'o': 4, 'c': CASE WHEN statements_enabled AND NOT list_contains(coalesce(fired, []), 'pg_stat_statements_missing') THEN 'statement statistics collected' END}}]) AS u FROM fx_instances i LEFT JOIN f USING (target_id))
SELECT target_id, snapshot_id, row_number() OVER (PARTITION BY target_id ORDER BY u.o) AS pos, u.c AS "check" FROM c WHERE u.c IS NOT NULL"""

# --- L ---
EXTRA["v_reports"] = """
SELECT x.*, i."table", i.indkey, i.bytes AS size_bytes, x.target_id % 6 = 0 AS cold, CASE WHEN x.target_id % 2 = 0 THEN 30.0 END AS days,
  CASE WHEN is_invalid OR covered THEN 'catalog_proven' WHEN x.target_id % 6 = 0 OR method <> 'btree' OR is_expression OR is_partial THEN 'inconclusive' ELSE 'needs_code_check' END AS grade,
  CASE WHEN is_invalid THEN 'invalid' WHEN covered THEN 'redundant' WHEN x.target_id % 6 = 0 THEN 'cold_window' WHEN method <> 'btree' THEN 'other_method' WHEN is_expression THEN 'expression' WHEN is_partial THEN 'partial' ELSE 'zero_scans' END AS reason
FROM (SELECT target_id, index, bool_or(covered) AS covered FROM (SELECT target_id, index, false AS covered FROM v_unused UNION ALL SELECT target_id, index, true FROM v_redundant_all
      UNION ALL SELECT target_id, index, false FROM fx_indexes WHERE is_invalid) GROUP BY 1, 2) x JOIN fx_indexes i USING (target_id, index)"""
S["index_reports"] = """SELECT target_id, "table", index, grade, reason, size_bytes, grade = 'inconclusive' AS do_not_drop,
  CASE WHEN reason = 'invalid' THEN 'correlate.invalid_no_build' WHEN reason = 'redundant' THEN 'correlate.redundant_covering' WHEN grade = 'inconclusive' THEN 'correlate.inconclusive' ELSE 'correlate.needs_code_check' END AS guard FROM v_reports"""
S["report_order"] = """SELECT target_id, "table", index, grade, row_number() OVER (PARTITION BY target_id ORDER BY CASE grade WHEN 'catalog_proven' THEN 0 WHEN 'needs_code_check' THEN 1 ELSE 2 END, size_bytes DESC, index) AS place FROM v_reports"""
S["text_previews"] = r"""SELECT doc_id, CASE WHEN length(p) > 80 THEN substr(p, 1, 79) || '…' ELSE p END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') AS p FROM documents)"""
S["recounted_titles"] = "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'Worst of ' || k ELSE (k - 1) || ' table(s) with many dead rows' END AS title FROM fx_events"
S["change_log"] = f"""
SELECT target_id, kind, strftime(to_timestamp(occurred_before) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT object) AS objects
FROM (SELECT target_id, kind, object, occurred_before FROM ({S["schema_diff"]}) UNION ALL SELECT target_id, kind, object, occurred_before FROM ({S["config_diff"]})) GROUP BY ALL"""
S["target_archive"] = "SELECT target_id, count(DISTINCT snapshot_id) AS documents, target_id = 3 AS exported FROM fx_table_stats GROUP BY 1"
S["index_verdicts"] = f"""
SELECT target_id, index, verdict, CAST(floor(age + 0.5) AS BIGINT) AS verdict_age_days, stale AS verdict_stale,
  CASE WHEN grade = 'needs_code_check' AND verdict = 'not_found_in_code' THEN CASE WHEN stale THEN 'stale' WHEN days > 20 THEN 'corroborated_longer' ELSE 'corroborated' END END AS verdict_note
FROM (SELECT r.*, v.verdict, greatest(CAST({AS_OF} - checked_at // 1000000 AS DOUBLE)/86400, 0) AS age,
        greatest(CAST({AS_OF} - checked_at // 1000000 AS DOUBLE)/86400, 0) > coalesce(days, CAST(CASE WHEN cold THEN 600 ELSE 2592000 END AS DOUBLE)/86400) AS stale
      FROM v_reports r JOIN (SELECT * FROM v_verdict_log QUALIFY row_number() OVER (PARTITION BY target_id, index ORDER BY checked_at DESC) = 1) v USING (target_id, index))"""
S["code_search_terms"] = f"""
SELECT target_id, index, pos, string_split(terms, ',')[pos] AS term FROM (SELECT r.target_id, r.index, t.terms, unnest(range(1, len(string_split(t.terms, ',')) + 1)) AS pos
FROM v_reports r JOIN ({S['search_terms']}) t ON t.target_id = r.target_id AND t.index = r.index WHERE grade = 'needs_code_check')"""

# --- L4-L7 ---
EXTRA["v_plans"] = """
SELECT CAST(p_size % 25 AS BIGINT) AS target_id, p_partkey AS queryid,
  '[{"Plan":{"Node Type":"Hash Join","Total Cost":' || (p_partkey % 900 + 100) || '.25,"Plans":[{"Node Type":"Seq Scan","Relation Name":"t' || (p_partkey % 40)
  || '","Schema":"public","Filter":"((a' || (p_partkey % 5) || ' = $1) AND (b <= $3) AND NOT = $4)"},{"Node Type":"Seq Scan","Relation Name":"pg_class","Schema":"pg_catalog","Filter":"(oid = $1)"},'
  || repeat('{"Node Type":"Subquery Scan","Plans":[', p_partkey % 17) || '{"Node Type":"Seq Scan","Schema":"app","Relation Name":"d' || (p_partkey % 9)
  || '","Filter":"((created_at > $2) AND (owner_id = $1))","Total Cost":5.5}' || repeat(']}', p_partkey % 17) || ']}}]' AS plan FROM part"""
EXTRA["v_plan_nodes"] = """
SELECT target_id, queryid, t.parent, max(CASE WHEN t.key = 'Node Type' THEN t.atom->>'$' END) AS node_type, max(CASE WHEN t.key = 'Relation Name' THEN t.atom->>'$' END) AS relation,
  max(CASE WHEN t.key = 'Schema' THEN t.atom->>'$' END) AS schema, max(CASE WHEN t.key = 'Filter' THEN t.atom->>'$' END) AS filter, min(t.path) AS path
FROM v_plans, json_tree(plan) t WHERE t.key IN ('Node Type','Relation Name','Schema','Filter') GROUP BY 1, 2, 3"""
EXTRA["v_candidates"] = r"""
SELECT DISTINCT target_id, queryid, coalesce(schema, 'public') AS schema, relation AS "table", array_to_string(list_filter(cols, lambda x, i: list_position(cols, x) = i)[1:4], ',') AS columns
FROM (SELECT *, list_filter(list_concat(regexp_extract_all(filter, '([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\$\d+', 1), regexp_extract_all(filter, '([A-Za-z_][A-Za-z0-9_]*)\s*(?:<|>|<=|>=)\s*\$\d+', 1)),
        lambda x: lower(x) NOT IN ('and','or','not','null','true','false','is','in','any','all')) AS cols FROM v_plan_nodes WHERE node_type = 'Seq Scan' AND relation <> '' AND filter <> '')
WHERE len(cols) > 0 AND coalesce(schema, 'public') NOT IN ('pg_catalog','information_schema','pg_toast')""".replace("\\\\", "\\")
S["plan_candidates"] = """SELECT *, 'CREATE INDEX ON ' || schema || '.' || "table" || ' (' || replace(columns, ',', ', ') || ')' AS ddl FROM v_candidates"""
S["plan_nodes"] = "SELECT target_id, node_type, count(*) AS nodes, count(*) FILTER (path = '$[0].Plan') AS roots FROM v_plan_nodes GROUP BY 1, 2"
EXTRA["v_validated"] = """
SELECT * FROM (SELECT target_id, queryid, 't' || (queryid % 40) AS "table", CAST((queryid % 900 + 100) || '0.25' AS DOUBLE) AS cost_before,
  CAST(((queryid % 900 + 100)*CASE WHEN queryid % 2 = 0 THEN 1 ELSE 9 END) || '.5' AS DOUBLE) AS cost_after, CAST(queryid % 100 AS DOUBLE) AS share_pct,
  'a' || (queryid % 5) AS a FROM v_plans WHERE queryid % 3 = 0) WHERE cost_after < cost_before*0.5"""
S["candidate_validation"] = 'SELECT target_id, queryid, "table", cost_before, cost_after, round((cost_before - cost_after)/cost_before*100*1000000)/1000000 AS improvement_pct FROM v_validated'
S["recommendations"] = """SELECT target_id, "table", queryid, share_pct, cost_before, cost_after, 'CREATE INDEX ON public.' || "table" || ' (' || a || ', b)' AS ddl, CAST(0.6 AS DOUBLE) AS confidence
FROM v_validated QUALIFY row_number() OVER (PARTITION BY target_id, "table", a ORDER BY share_pct DESC, queryid) = 1"""
EXTRA["v_advice_tables"] = """SELECT target_id, "table", (mk % 6 = 0) OR mods > 0.2*live + 50 AS stale, writes > 100000 AS heavy FROM (
  SELECT CAST(p_size % 25 AS BIGINT) AS target_id, 't' || (p_partkey % 40) AS "table", count(*)*100 AS live, max(p_partkey) AS mk, max(p_partkey) % 500 AS mods, max(p_partkey)*200 AS writes FROM part GROUP BY 1, 2)"""
EXTRA["v_guarded"] = """SELECT c.*, coalesce(a.heavy, false) AS write_heavy FROM v_candidates c LEFT JOIN v_advice_tables a ON c.schema = 'public' AND a.target_id = c.target_id AND a."table" = c."table" WHERE NOT coalesce(a.stale, false)"""
S["advice_guards"] = 'SELECT target_id, schema, "table", count(*) AS candidates, bool_or(write_heavy) AS write_heavy FROM v_guarded GROUP BY 1, 2, 3'
S["advice_stats"] = r"""
SELECT s.target_id, considered, plannable, coalesce(planned, 0) AS planned, coalesce(tested, 0) AS tested, coalesce(candidates, 0) - coalesce(tested, 0) AS skipped_stale
FROM (SELECT target_id, count(*) AS considered, count(*) FILTER (regexp_matches(query, '(?i)^\s*select\b') AND NOT contains(query, ';')) AS plannable FROM fx_statements GROUP BY 1) s
LEFT JOIN (SELECT target_id, count(*) AS planned FROM v_plans GROUP BY 1) p USING (target_id) LEFT JOIN (SELECT target_id, count(*) AS candidates FROM v_candidates GROUP BY 1) c USING (target_id)
LEFT JOIN (SELECT target_id, count(*) AS tested FROM v_guarded GROUP BY 1) g USING (target_id)"""

# --- M ---
S["view_tables"] = """SELECT target_id, snapshot_id, schema, "table", row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY total_bytes DESC, schema, "table") AS rank,
  total_bytes, live_tuples, dead_ratio, seq_scans, index_scans FROM v_tables QUALIFY rank <= 4"""
S["vacuum_due"] = """SELECT target_id, snapshot_id, schema, "table", row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY dead_tuples DESC, total_bytes DESC) AS rank, live_tuples, dead_tuples, dead_ratio,
  coalesce(rel_autovacuum_enabled, '') <> 'off' AND dead_tuples > vac_trigger AS due FROM v_tables"""
S["vacuum_behind"] = """SELECT target_id, snapshot_id, count(*) FILTER (coalesce(rel_autovacuum_enabled, '') <> 'off'
  AND dead_tuples > coalesce(rel_vacuum_threshold, target_id*100.0) + coalesce(rel_vacuum_scale, CAST(0.3 AS DOUBLE))*live_tuples) AS behind, count(*) AS tables FROM fx_table_stats GROUP BY 1, 2"""
S["view_unused_indexes"] = """SELECT target_id, snapshot_id, "table", index, bytes, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY bytes DESC, indexrelid) AS rank,
  CAST(sum(bytes) OVER (PARTITION BY target_id, snapshot_id) AS BIGINT) AS reclaimable_bytes, count(*) OVER (PARTITION BY target_id, snapshot_id) AS unused FROM v_unused QUALIFY rank <= 50"""
S["view_diff"] = """
WITH n AS (SELECT * FROM fx_db_counters QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY collected_at DESC) = 1),
     j AS (SELECT n.target_id, n.snapshot_id, b.snapshot_id AS base_snapshot_id, n.collected_at - b.collected_at AS actual_seconds, n.numbackends*12 AS a, b.numbackends*12 AS b,
       CASE WHEN n.stats_reset_at > b.stats_reset_at THEN 'stats_reset' WHEN n.postmaster_start_at > b.postmaster_start_at THEN 'server_restart' END AS reset_reason,
       n.blks_read // 5000 > b.blks_read // 5000 AS statements_evicted
     FROM n ASOF JOIN fx_db_counters b ON b.target_id = n.target_id AND b.collected_at <= n.collected_at - 604800)
SELECT target_id, snapshot_id, base_snapshot_id, CAST(604800 AS BIGINT) AS requested_seconds, actual_seconds, actual_seconds > 1.25*604800 AS stretched, reset_reason, statements_evicted,
  CAST(CASE WHEN reset_reason IS NULL AND b > 0 AND abs(a - b) >= 20 AND abs(a - b) >= 0.5*b THEN 1 ELSE 0 END AS BIGINT) AS changes,
  CAST(CASE WHEN reset_reason IS NULL AND b > 0 AND a - b >= 20 AND a - b >= 0.5*b THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM j"""
S["view_changes"] = """
WITH n AS (SELECT * FROM fx_db_counters QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY collected_at DESC) = 1),
     j AS (SELECT n.target_id, n.snapshot_id, b.snapshot_id AS base_snapshot_id, n.collected_at - b.collected_at AS actual_seconds, n.numbackends*40 AS a, b.numbackends*40 AS b,
       CASE WHEN n.stats_reset_at > b.stats_reset_at THEN 'stats_reset' WHEN n.postmaster_start_at > b.postmaster_start_at THEN 'server_restart' END AS reset_reason,
       n.blks_read // 5000 > b.blks_read // 5000 AS statements_evicted
     FROM n ASOF JOIN fx_db_counters b ON b.target_id = n.target_id AND b.collected_at <= n.collected_at - 86400)
SELECT target_id, snapshot_id, base_snapshot_id, actual_seconds, actual_seconds > 1.25*86400 AS stretched, statements_evicted, 'health.connections' AS id, 'db' AS subject,
  CASE WHEN a > b THEN 'warn' ELSE 'info' END AS severity, CAST(b AS DOUBLE) AS before, CAST(a AS DOUBLE) AS after FROM j WHERE reset_reason IS NULL AND b > 0 AND abs(a - b) >= 20 AND abs(a - b) >= 0.5*b"""
EXTRA["v_metrics"] = f"""
SELECT target_id, 'fleet_finding' AS family, CAST(1 AS DOUBLE) AS value FROM v_muted
UNION ALL SELECT target_id, 'fleet_findings_total', CAST(unnest([count(*) FILTER (NOT suppressed AND severity='critical'), count(*) FILTER (NOT suppressed AND severity='warn'), count(*) FILTER (NOT suppressed AND severity='info')]) AS DOUBLE)
  FROM v_muted GROUP BY target_id, snapshot_id
UNION ALL SELECT target_id, 'fleet_xid_age', CAST(max_xid_age AS DOUBLE) FROM fx_instances UNION ALL SELECT target_id, 'fleet_mxid_age', CAST(max_mxid_age AS DOUBLE) FROM fx_instances
UNION ALL SELECT target_id, 'fleet_connections_used', CAST(connections_used AS DOUBLE) FROM fx_instances UNION ALL SELECT target_id, 'fleet_connections_max', CAST(connections_max AS DOUBLE) FROM fx_instances
UNION ALL SELECT target_id, 'fleet_wal_dir_bytes', CAST(wal_dir_bytes AS DOUBLE) FROM fx_instances WHERE wal_dir_bytes IS NOT NULL
UNION ALL SELECT target_id, 'fleet_replica_lag_seconds', replay_lag_sec FROM fx_replicas WHERE replay_lag_sec IS NOT NULL"""
S["export_metrics"] = "SELECT target_id, family, count(*) AS series, sum(round(value*100)) AS total FROM v_metrics GROUP BY 1, 2"
S["export_metric_text"] = "SELECT family, false AS header, count(*) AS lines FROM v_metrics GROUP BY 1 UNION ALL SELECT DISTINCT family, true, CAST(2 AS BIGINT) FROM v_metrics"
_lv = "CASE severity WHEN 'critical' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END"
_sc = "CAST(CASE severity WHEN 'critical' THEN 9.0 WHEN 'warn' THEN 5.5 ELSE 2.0 END AS DOUBLE)"
S["export_scan_results"] = f"""SELECT target_id, snapshot_id, id AS rule_id, {_lv} AS level, {_sc} AS score, CASE WHEN object = '' THEN 'cluster' ELSE object END AS location,
  CASE WHEN suppressed THEN coalesce(nullif(['known','batch tables','','analytics fleet','small tables','managed elsewhere',''][ord + 1], ''), 'suppressed by configuration') END AS suppression FROM v_muted"""
S["export_scan_rules"] = f"SELECT id AS rule_id, min(dimension) AS dimension, max({_sc}) AS score FROM ({_all()}) GROUP BY 1"
S["export_test_cases"] = f"""SELECT target_id, snapshot_id, CASE WHEN object = '' THEN id ELSE id || ' ' || object END AS name, dimension AS class,
  CASE WHEN suppressed THEN 'skipped' WHEN severity IN ('critical','warn') THEN 'failed' ELSE 'passed' END AS status
FROM v_muted JOIN (SELECT DISTINCT id, dimension FROM ({_all(['tables', 'slots'])})) USING (id)"""
S["export_test_suites"] = """SELECT target_id, snapshot_id, count(*) AS tests, count(*) FILTER (NOT suppressed AND severity = 'critical') AS failures, count(*) FILTER (suppressed) AS skipped FROM v_muted GROUP BY 1, 2"""
S["finding_documents"] = f"""
SELECT f.target_id, f.snapshot_id, count(*) AS findings, CAST(sum(least(n_objects, 10)) AS BIGINT) AS evidence, min_by(id, [CASE WHEN dimension = 'risk' THEN 0 ELSE 1 END, -score, -{_rank}]) AS first_id
FROM v_family_tables f GROUP BY 1, 2"""
S["finding_documents"] = f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY dimension = 'risk' DESC, score DESC, {_rank} DESC, id) AS r FROM v_family_tables)
SELECT target_id, snapshot_id, count(*) AS findings, CAST(sum(least(n_objects, 10)) AS BIGINT) AS evidence, max(CASE WHEN r = 1 THEN id END) AS first_id FROM o GROUP BY 1, 2"""
S["context_findings"] = "SELECT * FROM v_family_tables"
S["context_tables"] = 'SELECT target_id, "table", count(*) AS readings, CAST(sum(live_tuples) AS BIGINT) AS live_tuples, count(last_vacuum) AS vacuumed FROM v_tables GROUP BY 1, 2'

# --- N: a finite stream gives all windows and sessions ---
S["stream_wait_rollup"] = "SELECT * FROM v_minute"
S["stream_wait_profile"] = """
SELECT target_id, window_start, wait_type, samples, CAST(sum(samples) OVER (PARTITION BY target_id, window_start) AS BIGINT) AS total, CAST(samples AS DOUBLE)/sum(samples) OVER (PARTITION BY target_id, window_start) AS share
FROM (SELECT target_id, (sample_at // 60)*60 - 60*o AS window_start, coalesce(wait_event_type, 'CPU') AS wait_type, count(*) AS samples
      FROM fx_ash, (SELECT unnest(range(0, 5)) AS o) GROUP BY 1, 2, 3)"""
S["stream_incident_sessions"] = """
WITH l AS (SELECT target_id, query_id, sample_at, CASE WHEN sample_at - lag(sample_at) OVER w < 21600 THEN 0 ELSE 1 END AS brk FROM fx_ash WHERE wait_event_type = 'Lock' WINDOW w AS (PARTITION BY target_id, query_id ORDER BY sample_at)),
     s AS (SELECT *, sum(brk) OVER (PARTITION BY target_id, query_id ORDER BY sample_at ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT target_id, query_id, min(sample_at) AS started_at, max(sample_at) + 21600 AS ended_at, count(*) AS samples FROM s GROUP BY target_id, query_id, g"""
S["stream_counter_rates"] = S["health_rates"]
S["finding_transitions"] = f"""
WITH f AS (SELECT target_id, snapshot_id AS run, id, object, max({_rank}) AS rk FROM v_family_tables GROUP BY ALL),
     h AS (SELECT target_id, run, lag(run) OVER (PARTITION BY target_id ORDER BY run) AS prev FROM (SELECT DISTINCT target_id, run FROM f)),
     b AS (SELECT h.target_id, h.run, f.id, f.object, f.rk AS prk FROM h JOIN f ON f.target_id = h.target_id AND f.run = h.prev)
SELECT target_id, run, id, object, CASE WHEN prk IS NULL THEN 'opened' WHEN rk IS NULL THEN 'closed' ELSE 'escalated' END AS change
FROM f FULL OUTER JOIN b USING (target_id, run, id, object) WHERE prk IS NULL OR rk IS NULL OR rk > prk"""
S["stream_finding_transitions"] = S["finding_transitions"]


def statements() -> dict[str, str]:
    return {name: with_views(sql, EXTRA) for name, sql in S.items()}
