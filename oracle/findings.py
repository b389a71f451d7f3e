"""SQL statements of the finding rules, one per telemetry family."""

from __future__ import annotations


def size_score(b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN least(100.0, greatest(0.0, (log10(CAST({b} AS DOUBLE)) - 6)/5.0*100)) ELSE 0.0 END)"


def r4(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE)*10000)/10000"


def finding(src: str, id_: str, when: str, severity: str, dim: str, score: str, conf: str, obj: str = "''", n: str = "0",
            snap: str = "snapshot_id") -> str:
    return (f"SELECT target_id, CAST({snap} AS BIGINT) AS snapshot_id, '{id_}' AS id, {obj} AS object, {severity} AS severity, '{dim}' AS dimension, "
            f"{r4(score)} AS score, {r4(conf)} AS confidence, CAST({n} AS BIGINT) AS n_objects FROM {src} WHERE {when}")


MANAGED = "provider IN ('rds','aurora','cloudsql','azure','supabase','neon')"
PARAMS = ["fsync", "full_page_writes", "autovacuum", "track_io_timing", "data_checksums", "ignore_checksum_failure", "archive_mode",
          "archive_timeout", "wal_level", "work_mem", "effective_cache_size", "max_connections", "random_page_cost", "statement_timeout",
          "synchronous_commit", "synchronous_standby_names"]
_pivot = ", ".join(f"max(CASE WHEN name='{p}' THEN value END) AS p_{p}" for p in PARAMS)

VIEWS = {
    "v_instances": f"""
SELECT i.*, p.* EXCLUDE (target_id),
       collected_at - coalesce(stats_reset_at, postmaster_start_at) AS window_age_seconds,
       round(CAST(collected_at - stats_reset_at AS DOUBLE)/3600/24*100)/100 AS stats_window_days,
       conflict_snapshot + conflict_lock + conflict_bufferpin AS conflicts,
       CAST(connections_used AS DOUBLE)/connections_max AS used_frac,
       coalesce(last_failed_at IS NOT NULL AND (last_archived_at IS NULL OR last_failed_at > last_archived_at), false) AS failing,
       CASE WHEN p_archive_timeout LIKE '%min' THEN CAST(replace(p_archive_timeout,'min','') AS BIGINT)*60 ELSE 0 END AS timeout_s,
       CAST(replace(p_work_mem,'MB','') AS BIGINT)*1048576*CAST(p_max_connections AS BIGINT) AS worst_mem,
       CAST(replace(p_effective_cache_size,'GB','') AS BIGINT)*1073741824 AS cache_size,
       CASE WHEN p_synchronous_standby_names = '' THEN 0 WHEN p_synchronous_standby_names LIKE 'ANY 2%' THEN 2 ELSE 1 END AS required
FROM fx_instances i LEFT JOIN (SELECT target_id, {_pivot} FROM fx_params GROUP BY 1) p USING (target_id)""",
    "v_tables": """
SELECT *, coalesce(rel_vacuum_threshold, 50) + coalesce(rel_vacuum_scale, CAST(0.2 AS DOUBLE))*CAST(live_tuples AS DOUBLE) AS vac_trigger,
       coalesce(rel_analyze_threshold, 50) + coalesce(rel_analyze_scale, CAST(0.1 AS DOUBLE))*CAST(live_tuples AS DOUBLE) AS ana_trigger
FROM fx_table_stats""",
    "v_rates": """
SELECT target_id, snapshot_id, collected_at, numbackends AS connections, stats_reset_at, postmaster_start_at, dt AS sample_seconds, pc IS NULL AS first,
  CASE WHEN xact_commit + xact_rollback >= pc + pr THEN CAST(xact_commit + xact_rollback - pc - pr AS DOUBLE)/dt END AS tps,
  CASE WHEN xact_commit >= pc THEN CAST(xact_commit - pc AS DOUBLE)/dt END AS commits_per_sec,
  CASE WHEN xact_rollback >= pr THEN CAST(xact_rollback - pr AS DOUBLE)/dt END AS rollbacks_per_sec,
  CASE WHEN xact_commit >= pc AND xact_rollback >= pr AND xact_commit - pc + xact_rollback - pr > 0
       THEN round(CAST(xact_rollback - pr AS DOUBLE)/(xact_commit - pc + xact_rollback - pr)*10000)/10000 END AS rollback_ratio,
  CASE WHEN blks_hit >= ph AND blks_read >= pd AND blks_hit - ph + blks_read - pd > 0
       THEN round(CAST(blks_hit - ph AS DOUBLE)/(blks_hit - ph + blks_read - pd)*10000)/10000 END AS cache_hit_ratio,
  CASE WHEN blks_hit >= ph AND blks_read >= pd AND blks_hit - ph + blks_read - pd > 0 THEN blks_hit + blks_read - ph - pd END AS cache_blocks,
  CASE WHEN deadlocks >= pl THEN round(CAST(deadlocks - pl AS DOUBLE)/dt*60*100)/100 END AS deadlocks_per_min,
  CASE WHEN temp_bytes >= pt THEN round(CAST(temp_bytes - pt AS DOUBLE)/dt*100)/100 END AS temp_bytes_per_sec,
  CASE WHEN tup_returned >= ptr THEN round(CAST(tup_returned - ptr AS DOUBLE)/dt*100)/100 END AS tup_returned_per_sec,
  CASE WHEN tup_written >= ptw THEN round(CAST(tup_written - ptw AS DOUBLE)/dt*100)/100 END AS tup_written_per_sec
FROM (SELECT *, collected_at - lag(collected_at) OVER w AS dt, lag(xact_commit) OVER w AS pc, lag(xact_rollback) OVER w AS pr, lag(blks_hit) OVER w AS ph,
             lag(blks_read) OVER w AS pd, lag(deadlocks) OVER w AS pl, lag(temp_bytes) OVER w AS pt, lag(tup_returned) OVER w AS ptr, lag(tup_written) OVER w AS ptw
      FROM fx_db_counters WINDOW w AS (PARTITION BY target_id ORDER BY collected_at))""",
    "v_health": """
SELECT *, CAST(collected_at - stats_reset_at AS BIGINT) AS window_age_seconds FROM v_rates""",
    "v_activity": """
SELECT a.*, av_age AS autovacuum_max_age_s, l.blocked, l.max_wait_s, a.target_id % 3 + 1 AS max_workers FROM (
  SELECT target_id, snapshot_id, count(*) AS total, count(*) FILTER (state='active') AS active, count(*) FILTER (state='idle') AS idle,
         count(*) FILTER (state LIKE 'idle in transaction%') AS idle_in_transaction,
         count(*) FILTER (wait_event_type NOT IN ('', 'Client')) AS waiting, CAST(max(xact_age_s) AS DOUBLE) AS longest_xact_s,
         CAST(coalesce(max(query_age_s) FILTER (state='active'), 0) AS DOUBLE) AS longest_active_s,
         count(*) FILTER (backend_type='autovacuum worker') AS autovacuum_workers,
         CAST(coalesce(max(xact_age_s) FILTER (backend_type='autovacuum worker'), 0) AS DOUBLE) AS av_age
  FROM fx_activity GROUP BY 1, 2) a
LEFT JOIN (SELECT target_id, snapshot_id, count(*) AS blocked, max(wait_s) AS max_wait_s FROM fx_lock_waits GROUP BY 1, 2) l USING (target_id, snapshot_id)""",
    "v_waits": """
SELECT target_id, window_id, n, io/n AS io_share, coalesce(top, lw)/n AS lwlock_share FROM (
  SELECT target_id, window_id, CAST(sum(x) AS DOUBLE) AS n, CAST(coalesce(sum(x) FILTER (t='IO'), 0) AS DOUBLE) AS io,
         CAST(coalesce(sum(x) FILTER (t='LWLock'), 0) AS DOUBLE) AS lw, CAST(max(x) FILTER (t='LWLock' AND e<>'') AS DOUBLE) AS top
  FROM (SELECT target_id, window_id, coalesce(wait_event_type, 'CPU') AS t, coalesce(wait_event, '') AS e, count(*) AS x FROM fx_ash GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)""",
    "v_wait_query": """
SELECT target_id, window_id, query_id, count(*) AS samples, CAST(total AS BIGINT) AS total, count(*) FILTER (wait_event_type='Lock') AS lock,
       count(*) FILTER (wait_event_type='IO') AS io
FROM (SELECT *, count(*) OVER (PARTITION BY target_id, window_id) AS total FROM fx_ash) WHERE query_id <> 0 GROUP BY ALL""",
    "v_unused": """
SELECT * FROM fx_indexes
WHERE scans = 0 AND bytes > 16384 AND NOT backs_constraint AND NOT is_primary AND NOT is_unique AND NOT is_exclusion AND NOT is_replident""",
    "v_redundant_all": """
SELECT a.target_id, a.snapshot_id, a.schema, a."table", a.index, a.indexrelid, a.bytes, b.index AS covered_by, b.indexrelid AS covering_id,
       len(b.indkey) > len(a.indkey) AS wider
FROM fx_indexes a JOIN fx_indexes b ON a.target_id = b.target_id AND a.snapshot_id = b.snapshot_id AND a."table" = b."table" AND a.method = b.method AND a.indexrelid <> b.indexrelid
WHERE ((len(b.indkey) > len(a.indkey) AND b.indkey[1:len(a.indkey)] = a.indkey) OR (b.indkey = a.indkey AND a.indexrelid > b.indexrelid))
  AND NOT a.is_primary AND NOT a.is_unique AND NOT a.is_exclusion AND NOT a.is_partial AND NOT a.is_expression AND NOT a.backs_constraint
  AND NOT b.is_partial AND NOT b.is_expression""",
    "v_redundant": """
SELECT *, row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY bytes DESC, indexrelid, covering_id) AS rank FROM v_redundant_all
QUALIFY rank <= 50""",
    "v_fks": """
SELECT * FROM fx_foreign_keys f WHERE NOT EXISTS (SELECT 1 FROM fx_indexes i WHERE i.target_id = f.target_id AND i.snapshot_id = f.snapshot_id AND i."table" = f."table"
  AND NOT i.is_partial AND len(i.indkey) >= len(f.conkey) AND i.indkey[1:len(f.conkey)] = f.conkey)""",
    "v_sequences": """
SELECT *, coalesce(round(CAST(last_value AS DOUBLE)/ceiling*10000)/10000, 0) AS pct_used,
       row_number() OVER (PARTITION BY target_id, snapshot_id ORDER BY CAST(last_value AS DOUBLE)/ceiling DESC NULLS LAST, name) AS rank
FROM fx_sequences WHERE last_value IS NOT NULL""",
    "v_roots": """
SELECT e.target_id, e.snapshot_id, e.child, coalesce(e2.parent, e.parent) AS root FROM fx_partition_edges e
LEFT JOIN fx_partition_edges e2 ON e2.child = e.parent AND e2.target_id = e.target_id""",
    "v_partitions": """
SELECT r.target_id, r.snapshot_id, r.root, count(*) AS partitions, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(live_tuples) AS BIGINT) AS live_tuples,
       CAST(sum(seq_scans) AS BIGINT) AS seq_scans, CAST(sum(index_scans) AS BIGINT) AS index_scans
FROM v_roots r JOIN fx_partition_leaves l USING (target_id, child) GROUP BY 1, 2, 3""",
    "v_baselines": """
SELECT target_id, snapshot_id, lag(snapshot_id) OVER w AS base_snapshot_id, lag(seen) OVER w AS base_at
FROM (SELECT target_id, snapshot_id, max(collected_at) AS seen FROM fx_statements GROUP BY 1, 2) WINDOW w AS (PARTITION BY target_id ORDER BY seen)""",
    "v_query_deltas": """
SELECT n.target_id, n.snapshot_id, n.queryid, n.total_us, n.collected_at, b.calls AS b_calls, base_at,
       CAST(n.total_us AS DOUBLE)/1000.0/n.calls AS mean, CAST(b.total_us AS DOUBLE)/1000.0/b.calls AS b_mean
FROM fx_statements n JOIN v_baselines s ON s.target_id = n.target_id AND s.snapshot_id = n.snapshot_id AND s.base_snapshot_id IS NOT NULL
LEFT JOIN fx_statements b ON b.target_id = n.target_id AND b.snapshot_id = s.base_snapshot_id AND b.queryid = n.queryid""",
    "v_resets": """
SELECT target_id, snapshot_id FROM (SELECT *, lag(stats_reset_at) OVER w AS pr, lag(postmaster_start_at) OVER w AS pp FROM fx_db_counters WINDOW w AS (PARTITION BY target_id ORDER BY collected_at))
WHERE stats_reset_at > pr OR postmaster_start_at > pp""",
    "v_gone": """
WITH r AS (SELECT *, CASE WHEN app_name <> '' THEN app_name ELSE client_addr END AS standby FROM fx_replicas),
     h AS (SELECT target_id, snapshot_id, seen, lag(snapshot_id) OVER w AS base, lag(seen) OVER w AS base_at
           FROM (SELECT target_id, snapshot_id, max(collected_at) AS seen FROM fx_replicas GROUP BY 1, 2) WINDOW w AS (PARTITION BY target_id ORDER BY seen))
SELECT h.target_id, h.snapshot_id, r.standby, h.base_at FROM h JOIN r ON r.target_id = h.target_id AND r.snapshot_id = h.base
WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.target_id = h.target_id AND x.snapshot_id = h.snapshot_id AND x.standby = r.standby)""",
}

_off = lambda i, p, v, score, conf, sev, dim="risk": finding(
    "v_instances", i, f"p_{p} = '{v}'", f"'{sev}'", dim, score, conf, f"'setting:{p}'")

FAMILY_SQL: dict[str, str] = {}

FAMILY_SQL["instances"] = "\nUNION ALL ".join([
    finding("v_instances", "connection_saturation", "used_frac >= 0.85", "CASE WHEN used_frac >= 0.95 THEN 'critical' ELSE 'warn' END", "risk", "used_frac*100", "1.0"),
    *[finding("v_instances", i, f"{a} >= 1000000000", f"CASE WHEN {a} >= 1800000000 THEN 'critical' ELSE 'warn' END", "risk",
              f"least(100.0, CAST({a} AS DOUBLE)/2147483647*100)", "1.0") for i, a in (("txid_wraparound", "max_xid_age"), ("mxid_wraparound", "max_mxid_age"))],
    finding("v_instances", "sync_rep_degraded", "p_synchronous_commit IN ('on','remote_write','remote_apply') AND required > sync_count", "'critical'", "risk", "88", "0.9"),
    finding("v_instances", "recovery_conflicts", "conflicts > 0", "'warn'", "risk", "40", "0.7"),
    _off("ignore_checksum_failure_on", "ignore_checksum_failure", "on", "90", "1.0", "critical"),
    _off("checksums_disabled", "data_checksums", "off", "15", "1.0", "info"),
    finding("v_instances", "archiving_failing", "failing OR failed_increase > 0", f"CASE WHEN {MANAGED} THEN 'info' ELSE 'critical' END", "risk", "95", "0.95"),
    finding("v_instances", "archiving_stalled", "p_archive_mode IN ('on','always') AND NOT failing AND wal_bytes_per_sec > 0 AND collected_at - last_archived_at > greatest(3600, 3*timeout_s)",
            f"CASE WHEN {MANAGED} THEN 'info' ELSE 'critical' END", "risk", "90", "0.85"),
    finding("v_instances", "archiving_disabled", "p_archive_mode = 'off' AND p_wal_level <> 'minimal' AND NOT (replica_count > 0 OR is_replica)",
            f"CASE WHEN {MANAGED} THEN 'info' ELSE 'warn' END", "risk", "50", "0.8"),
    finding("v_instances", "pgss_entries_evicted", "statements_enabled AND (statements_dealloc > 0 OR statements_count >= statements_max)", "'warn'", "throughput", "25", "0.85"),
    finding("v_instances", "checkpoints_forced", "checkpoints_req + checkpoints_timed >= 10 AND CAST(checkpoints_req AS DOUBLE)/(checkpoints_req + checkpoints_timed) >= 0.3",
            "'warn'", "throughput", "least(75.0, CAST(checkpoints_req AS DOUBLE)/(checkpoints_req + checkpoints_timed)*100)", "0.7", "'setting:max_wal_size'"),
    finding("v_instances", "connections_overprovisioned", "connections_max >= 200 AND connections_used < connections_max*0.15", "'info'", "cost", "20", "0.6"),
    _off("fsync_off", "fsync", "off", "95", "1.0", "critical"), _off("full_page_writes_off", "full_page_writes", "off", "90", "1.0", "critical"),
    _off("autovacuum_off", "autovacuum", "off", "88", "1.0", "critical"),
    finding("v_instances", "random_page_cost_high", f"CAST(p_random_page_cost AS DOUBLE) >= 4 AND {MANAGED}", "'warn'", "latency", "40", "0.7", "'setting:random_page_cost'"),
    finding("v_instances", "work_mem_overcommit", "worst_mem > cache_size", "'warn'", "risk", "45", "0.55", "'setting:work_mem'"),
    _off("statement_timeout_unset", "statement_timeout", "0", "20", "0.8", "info"),
    _off("io_timing_off", "track_io_timing", "off", "15", "1.0", "info", "throughput"),
    finding("v_instances", "pg_stat_statements_missing", "NOT statements_enabled", "'info'", "cost", "15", "1.0"),
    finding("v_instances", "stale_stats_window", "stats_window_days >= 30", "'info'", "cost", "12", "1.0")])

FAMILY_SQL["health"] = "\nUNION ALL ".join([
    finding("v_health", "low_cache_hit", "NOT window_age_seconds < 900 AND cache_blocks >= 10000 AND cache_hit_ratio < 0.9", "'warn'", "throughput", "least(85.0, (1 - cache_hit_ratio)*300)", "0.6"),
    finding("v_health", "work_mem_low", "temp_bytes_per_sec >= 1048576", "'warn'", "throughput", "least(80.0, log10(floor(temp_bytes_per_sec))*10)", "0.7", "'setting:work_mem'"),
    finding("v_health", "high_rollback_ratio", "rollback_ratio >= 0.1 AND tps*sample_seconds >= 20", "'warn'", "throughput", "least(35.0, rollback_ratio*100)", "0.5")])

FAMILY_SQL["activity"] = "\nUNION ALL ".join([
    finding("v_activity", "blocking_chains", "blocked > 0", "'critical'", "risk", "least(100.0, 80 + blocked*3 + CAST(max_wait_s AS DOUBLE)/10)", "1.0"),
    finding("v_activity", "idle_in_transaction", "idle_in_transaction > 0", "CASE WHEN longest_xact_s >= 60 THEN 'warn' ELSE 'info' END", "risk",
            "CASE WHEN longest_xact_s >= 60 THEN least(80.0, 50 + longest_xact_s/30) ELSE 30 END", "0.7"),
    finding("v_activity", "long_running_transaction", "longest_xact_s >= 300", "'warn'", "risk", "least(85.0, 55 + longest_xact_s/60)", "0.8"),
    finding("v_activity", "autovacuum_saturated", "autovacuum_workers > 0 AND autovacuum_workers >= max_workers", "'warn'", "throughput", "35", "0.5"),
    finding("v_activity", "autovacuum_long_running", "autovacuum_max_age_s >= 3600", "'info'", "throughput", "15", "0.7")])

FAMILY_SQL["waits"] = "\nUNION ALL ".join([
    finding("v_waits", "wait_io_bound", "n >= 20 AND io_share > 0.5", "'warn'", "throughput", "least(90.0, io_share*100)", "least(0.9, 0.4 + n/400)", snap="window_id"),
    finding("v_waits", "wait_lwlock_pressure", "n >= 20 AND lwlock_share > 0.3", "'warn'", "throughput", "least(88.0, lwlock_share*100)", "least(0.9, 0.4 + n/400)", snap="window_id"),
    finding("v_wait_query", "wait_lock_contention", "total >= 20 AND samples >= 5 AND CAST(lock AS DOUBLE)/samples > 0.3", "'warn'", "latency",
            "least(95.0, CAST(lock AS DOUBLE)/samples*100*(CAST(samples AS DOUBLE)/total) + 40)", "least(0.9, 0.4 + CAST(total AS DOUBLE)/400)", snap="window_id")])


def grouped(src: str, id_: str, where: str, dim: str, score: str, conf: str, severity: str = "'warn'", named: bool = True) -> str:
    return (f"SELECT target_id, snapshot_id, '{id_}' AS id, '' AS object, {severity} AS severity, '{dim}' AS dimension, {r4(score)} AS score, "
            f"{r4(conf)} AS confidence, CAST({'count(*)' if named else '0'} AS BIGINT) AS n_objects FROM {src} WHERE {where} GROUP BY target_id, snapshot_id")


_unvac, _unana = "(last_vacuum IS NULL AND last_autovacuum IS NULL)", "(last_analyze IS NULL AND last_autoanalyze IS NULL)"
_worst = "CAST(floor(max(dead_ratio*CAST(total_bytes AS DOUBLE))) AS BIGINT)"
FAMILY_SQL["tables"] = "\nUNION ALL ".join([
    grouped("v_tables", "table_bloat", "dead_ratio >= 0.2 AND live_tuples + dead_tuples >= 10000", "storage",
            f"{size_score(_worst)}*CASE WHEN bool_or(last_autovacuum IS NULL) THEN 1.0 ELSE 0.6 END", "0.7"),
    grouped("v_tables", "seq_scan_heavy", "live_tuples >= 50000 AND seq_scans + index_scans >= 100 AND seq_scans > 2*index_scans", "throughput",
            "least(90.0, 40 + log10(max(CAST(seq_scans AS DOUBLE)*CAST(live_tuples AS DOUBLE)) + 1)*8)", "0.6"),
    grouped("v_tables", "autovacuum_disabled_on_table", "rel_autovacuum_enabled = 'off'", "risk", "80", "1.0", "'critical'"),
    grouped("v_tables", "table_never_vacuumed", f"live_tuples >= 10000 AND {_unvac}", "risk", "40", "0.75"),
    grouped("v_tables", "autovacuum_starved", f"live_tuples >= 10000 AND NOT {_unvac} AND vac_trigger > 0 AND dead_tuples >= 1.5*vac_trigger AND last_autovacuum IS NULL", "storage", "45", "0.6"),
    grouped("v_tables", "stale_statistics", f"live_tuples >= 10000 AND NOT {_unana} AND ana_trigger > 0 AND mods_since_analyze >= 2*ana_trigger", "latency", "45", "0.7"),
    grouped("v_tables", "never_analyzed", f"live_tuples >= 10000 AND {_unana}", "latency", "50", "0.8"),
    grouped("v_tables", "low_hot_update_ratio", "updates >= 10000 AND CAST(hot_updates AS DOUBLE)/updates < 0.5", "throughput", "40", "0.7")])

FAMILY_SQL["partitions"] = grouped(
    "v_partitions", "partition_seq_scan_heavy",
    "live_tuples >= 50000 AND seq_scans >= 1000 AND NOT (index_scans > 0 AND seq_scans < index_scans)", "latency", "55", "0.7")

FAMILY_SQL["unused"] = grouped(
    f"""(SELECT u.*, CASE WHEN h.target_id IS NOT NULL THEN least(100.0, {size_score('u.bytes')}*1.3) ELSE {size_score('u.bytes')} END AS sc FROM v_unused u LEFT JOIN (
       SELECT target_id, "table" FROM fx_table_stats GROUP BY 1, 2 HAVING max_by(mods_since_analyze, snapshot_id) > 1000) h ON h.target_id = u.target_id AND h."table" = u."table")""",
    "unused_indexes", "bytes >= 1048576", "storage", "max(sc)", "0.8")

FAMILY_SQL["redundant"] = grouped("(SELECT DISTINCT target_id, snapshot_id, schema, \"table\", index, bytes FROM v_redundant_all)", "redundant_indexes", "true", "storage", size_score("sum(bytes)"), "0.75", "'info'")
FAMILY_SQL["fks"] = grouped("v_fks",
                            "fk_unindexed", "true", "latency", size_score("max(child_bytes)"), "0.85")
FAMILY_SQL["invalid"] = grouped(
    "(SELECT o.*, b.target_id IS NOT NULL AS building FROM fx_schema_objects o LEFT JOIN (SELECT DISTINCT target_id, snapshot_id FROM fx_progress WHERE operation = 'create_index') b USING (target_id, snapshot_id))",
    "index_invalid", "kind = 'index' AND invalid", "risk", "CASE WHEN bool_or(live AND ready) THEN 85 ELSE 45 END", "CASE WHEN bool_or(building) THEN 0.5 ELSE 1.0 END",
    "CASE WHEN bool_or(live AND ready) AND NOT bool_or(building) THEN 'critical' ELSE 'warn' END")
FAMILY_SQL["sequences"] = grouped("v_sequences", "sequence_exhaustion", "pct_used >= 0.8", "risk", "max(pct_used)*100", "0.9", "CASE WHEN max(pct_used) >= 0.9 THEN 'critical' ELSE 'warn' END")
FAMILY_SQL["narrow"] = grouped(
    "(SELECT * FROM fx_narrow_columns WHERE type IN ('int2','int4') AND (is_identity OR owns_sequence))",
    "int4_identity_column", "true", "risk", "55", "0.95", "CASE WHEN bool_or(type='int2') THEN 'critical' ELSE 'warn' END")
FAMILY_SQL["checksums"] = grouped("fx_checksum_failures", "checksum_failures", "failures > 0", "risk", "96", "1.0", "'critical'")
FAMILY_SQL["replicas"] = "\nUNION ALL ".join([
    grouped("fx_replicas", "replica_lag_time", "target_id % 4 <> 0 AND replay_lag_sec >= 60", "risk", "least(90.0, 40 + max(replay_lag_sec)/10)", "0.85",
            "CASE WHEN max(replay_lag_sec) >= 300 THEN 'critical' ELSE 'warn' END", named=False),
    grouped("(SELECT * FROM v_gone ANTI JOIN v_resets USING (target_id, snapshot_id))", "replica_disconnected", "true", "risk", "55", "0.8", named=False)])
FAMILY_SQL["slots"] = finding("fx_slots", "replication_slot_inactive", "wal_status = 'lost' OR (NOT active AND retained_bytes >= 536870912)",
                              "CASE WHEN wal_status = 'lost' OR retained_bytes >= 8589934592 THEN 'critical' ELSE 'warn' END", "risk",
                              "CASE WHEN wal_status = 'lost' THEN 92 WHEN retained_bytes >= 8589934592 THEN 85 ELSE 55 END", "0.9", "'slot:' || name")
FAMILY_SQL["subscriptions"] = finding("fx_subscriptions", "subscription_worker_down", "NOT worker_running", "'warn'", "risk", "60", "0.75", "'sub:' || name")
FAMILY_SQL["horizon"] = f"""
SELECT target_id, snapshot_id, 'vacuum_horizon_blocked' AS id, '' AS object, CASE WHEN x >= 1000000000 THEN 'critical' ELSE 'warn' END AS severity,
       CASE WHEN x >= 1000000000 THEN 'risk' ELSE 'storage' END AS dimension,
       {r4('CASE WHEN x >= 1000000000 THEN least(100.0, CAST(x AS DOUBLE)/2147483647*100) ELSE 45 END')} AS score, {r4('0.9')} AS confidence, CAST(0 AS BIGINT) AS n_objects
FROM (SELECT target_id, snapshot_id, max(xmin_age) AS x FROM fx_horizon GROUP BY 1, 2) WHERE x >= 1000000
UNION ALL """ + finding("fx_horizon", "prepared_xact_abandoned", "source = 'prepared_xact' AND age_s >= 300", "CASE WHEN age_s >= 3600 THEN 'critical' ELSE 'warn' END", "risk",
                        "CASE WHEN age_s >= 3600 THEN 78 ELSE 55 END", "0.9")
FAMILY_SQL["slowdowns"] = grouped(
    "(SELECT *, (round(mean*10000)/10000)/(round(b_mean*10000)/10000) AS factor FROM v_query_deltas ANTI JOIN v_resets USING (target_id, snapshot_id) WHERE b_mean > 0 AND abs(mean - b_mean) >= 5 AND abs((mean - b_mean)/b_mean) >= 0.5)",
    "query_slowdown", "round(mean*10000)/10000 >= 10 AND factor >= 2", "latency", "least(90.0, 30 + max(factor)*10)", "0.8", named=False)
