"""Each rule at its boundary, and the combined paths."""

import json

import pytest
from pyspark.sql import functions as F

from vitalgrid import Fleet
from vitalgrid.operators import policy
from vitalgrid.plans import rules as R
from vitalgrid.plans.context_findings import context_findings
from vitalgrid.plans.exports import finding_documents, metric_text, metric_rows, scan_results, test_cases as case_rows
from vitalgrid.plans.rule_catalog import ADVICE, CLUSTER_WIDE_IDS, KNOWN_IDS, RULES, SCHEMA_IDS, TUNING_IDS, by_dimension, rule_catalog
from vitalgrid.plans.families import FAMILY_OF
from vitalgrid.sources import contexts as X


@pytest.fixture()
def grade(spark):
    """Findings of one context document, by id."""
    def run(doc, **extra):
        base = {"schema_version": "1.2.0", "fingerprint": "f", "collected_at": "2026-01-10T00:00:00Z", "queries": {"enabled": True}}
        base.update(doc)
        df = spark.createDataFrame([(json.dumps(base),)], "document string")
        found, _ = context_findings(X.parse_contexts(df), **extra)
        out = {}
        for r in found.collect():
            out.setdefault(r["id"], []).append(r)
        return out
    return run


def table(**kw):
    base = {"schema": "public", "table": "t", "total_bytes": 10_000_000, "live_tuples": 100_000, "dead_tuples": 0, "dead_ratio": 0.0, "seq_scans": 0, "index_scans": 1000,
            "mods_since_analyze": 0, "updates": 0, "hot_updates": 0, "last_vacuum": "2026-01-01T00:00:00Z", "last_autovacuum": "2026-01-01T00:00:00Z",
            "last_analyze": "2026-01-01T00:00:00Z", "last_autoanalyze": "2026-01-01T00:00:00Z"}
    return {**base, **kw}


def one_table(**kw):
    return {"tables": {"db_size_bytes": 1, "top": [table(**kw)]}}


def index_(**kw):
    return {"schema": "public", "table": "t", "index": "i", "scans": 0, "bytes": 5_000_000, "method": "btree", "partial": False, "expression": False, **kw}


CASES = [
    ("blocking_chains", {"locks": {"blocked_count": 1, "chains": [{"blocked_pid": 1, "wait_seconds": 50.0}]}}, "critical", 88.0, {"locks": {"blocked_count": 0}}),
    ("unused_indexes", {"indexes": {"unused": [index_(bytes=1 << 20)]}}, "warn", None, {"indexes": {"unused": [index_(bytes=(1 << 20) - 1)]}}),
    ("redundant_indexes", {"indexes": {"redundant": [{"schema": "p", "table": "t", "index": "a", "covered_by": "b", "bytes": 10**8}]}}, "info", 40.0, {"indexes": {"redundant": []}}),
    ("fk_unindexed", {"indexes": {"unindexed_fks": [{"schema": "p", "table": "t", "constraint": "c", "child_bytes": 10**8}]}}, "warn", 40.0, {"indexes": {}}),
    ("table_bloat", one_table(dead_ratio=0.20, dead_tuples=20_000, total_bytes=10**9), "warn", None, one_table(dead_ratio=0.19, dead_tuples=20_000)),
    ("seq_scan_heavy", one_table(live_tuples=50_000, seq_scans=201, index_scans=100), "warn", None, one_table(live_tuples=50_000, seq_scans=200, index_scans=100)),
    ("partition_seq_scan_heavy", {"tables": {"partitioned": [{"schema": "p", "table": "t", "partitions": 3, "total_bytes": 1, "live_tuples": 50_000, "seq_scans": 1000, "index_scans": 1000}]}}, "warn", 55.0,
     {"tables": {"partitioned": [{"schema": "p", "table": "t", "partitions": 3, "total_bytes": 1, "live_tuples": 50_000, "seq_scans": 1000, "index_scans": 1001}]}}),
    ("autovacuum_disabled_on_table", one_table(autovacuum_disabled=True, live_tuples=1), "critical", 80.0, one_table(autovacuum_disabled=False)),
    ("table_never_vacuumed", one_table(last_vacuum=None, last_autovacuum=None, live_tuples=10_000), "warn", 40.0, one_table(last_vacuum=None, last_autovacuum=None, live_tuples=9_999)),
    ("autovacuum_starved", one_table(last_autovacuum=None, dead_tuples=30_075), "warn", 45.0, one_table(last_autovacuum=None, dead_tuples=30_074)),
    ("stale_statistics", one_table(mods_since_analyze=20_100), "warn", 45.0, one_table(mods_since_analyze=20_099)),
    ("never_analyzed", one_table(last_analyze=None, last_autoanalyze=None), "warn", 50.0, one_table(last_analyze=None)),
    ("low_hot_update_ratio", one_table(updates=10_000, hot_updates=4_999), "warn", 40.0, one_table(updates=10_000, hot_updates=5_000)),
    ("autovacuum_saturated", {"activity": {"autovacuum_workers": 3}, "settings": {"params": {"autovacuum_max_workers": "3"}}}, "warn", 35.0,
     {"activity": {"autovacuum_workers": 2}, "settings": {"params": {"autovacuum_max_workers": "3"}}}),
    ("autovacuum_long_running", {"activity": {"autovacuum_max_age_sec": 3600}}, "info", 15.0, {"activity": {"autovacuum_max_age_sec": 3599}}),
    ("low_cache_hit", {"health": {"cache_hit_ratio": 0.8, "cache_blocks_sampled": 10_000}}, "warn", 60.0, {"health": {"cache_hit_ratio": 0.8, "cache_blocks_sampled": 9_999}}),
    ("idle_in_transaction", {"activity": {"idle_in_transaction": 1, "longest_xact_sec": 60}}, "warn", 52.0, {"activity": {"idle_in_transaction": 0, "longest_xact_sec": 60}}),
    ("long_running_transaction", {"activity": {"longest_xact_sec": 300}}, "warn", 60.0, {"activity": {"longest_xact_sec": 299}}),
    ("connection_saturation", {"limits": {"connections_used": 95, "connections_max": 100}}, "critical", 95.0, {"limits": {"connections_used": 84, "connections_max": 100}}),
    ("txid_wraparound", {"limits": {"max_xid_age": 1_800_000_000}}, "critical", None, {"limits": {"max_xid_age": 999_999_999}}),
    ("mxid_wraparound", {"limits": {"max_mxid_age": 1_000_000_000}}, "warn", None, {"limits": {"max_mxid_age": 999_999_999}}),
    ("sequence_exhaustion", {"sequences": {"items": [{"schema": "p", "sequence": "s", "last_value": 1, "ceiling": 1, "pct_used": 0.9}]}}, "critical", 90.0,
     {"sequences": {"items": [{"schema": "p", "sequence": "s", "last_value": 1, "ceiling": 1, "pct_used": 0.79}]}}),
    ("int4_identity_column", {"sequences": {"narrow_identity": [{"schema": "p", "table": "t", "column": "c", "type": "int2"}]}}, "critical", 55.0, {"sequences": {}}),
    ("vacuum_horizon_blocked", {"horizon": {"holders": [{"source": "backend", "holder": "1", "xmin_age": 1_000_000}]}}, "warn", 45.0,
     {"horizon": {"holders": [{"source": "backend", "holder": "1", "xmin_age": 999_999}]}}),
    ("prepared_xact_abandoned", {"horizon": {"holders": [{"source": "prepared_xact", "holder": "g", "xmin_age": 5, "age_s": 3600}]}}, "critical", 78.0,
     {"horizon": {"holders": [{"source": "prepared_xact", "holder": "g", "xmin_age": 5, "age_s": 299}]}}),
    ("sync_rep_degraded", {"settings": {"params": {"synchronous_commit": "on", "synchronous_standby_names": "ANY 2 (a,b)"}}, "replication": {"replicas": [{"sync_state": "quorum"}]}}, "critical", 88.0,
     {"settings": {"params": {"synchronous_commit": "local", "synchronous_standby_names": "s1"}}}),
    ("replica_lag_time", {"wal": {"bytes_per_sec": 1.0}, "replication": {"replicas": [{"application_name": "r", "replay_lag_sec": 300.0}]}}, "critical", 70.0,
     {"wal": {"bytes_per_sec": 0.0}, "replication": {"replicas": [{"application_name": "r", "replay_lag_sec": 300.0}]}}),
    ("recovery_conflicts", {"standby": {"confl_lock": 1}}, "warn", 40.0, {"standby": {"confl_lock": 0}}),
    ("replica_disconnected", {"deltas": {"changes": [{"id": "replication.standby_gone", "subject": "r1"}]}}, "warn", 55.0, {"deltas": {"changes": []}}),
    ("checksum_failures", {"checksums": {"failures": [{"database": "d", "count": 2}]}}, "critical", 96.0, {"checksums": {"failures": []}}),
    ("ignore_checksum_failure_on", {"settings": {"params": {"ignore_checksum_failure": "on"}}}, "critical", 90.0, {"settings": {"params": {"ignore_checksum_failure": "off"}}}),
    ("checksums_disabled", {"settings": {"params": {"data_checksums": "off"}}}, "info", 15.0, {"settings": {"params": {"data_checksums": "on"}}}),
    ("archiving_failing", {"archiver": {"last_failed_time": "2026-01-09T00:00:00Z", "last_archived_time": "2026-01-08T00:00:00Z"}}, "critical", 95.0,
     {"archiver": {"last_failed_time": "2026-01-07T00:00:00Z", "last_archived_time": "2026-01-08T00:00:00Z"}}),
    ("archiving_stalled", {"archiver": {"last_archived_time": "2026-01-09T22:59:59Z"}, "wal": {"bytes_per_sec": 5.0}, "settings": {"params": {"archive_mode": "on"}}}, "critical", 90.0,
     {"archiver": {"last_archived_time": "2026-01-09T22:00:00Z"}, "wal": {"bytes_per_sec": 5.0}, "settings": {"params": {"archive_mode": "on", "archive_timeout": "1h"}}}),
    ("archiving_disabled", {"settings": {"params": {"archive_mode": "off", "wal_level": "replica"}}}, "warn", 50.0, {"settings": {"params": {"archive_mode": "off", "wal_level": "minimal"}}}),
    ("replication_slot_inactive", {"replication": {"slots": [{"name": "s", "active": False, "retained_bytes": 8 << 30}]}}, "critical", 85.0,
     {"replication": {"slots": [{"name": "s", "active": False, "retained_bytes": (512 << 20) - 1}, {"name": "t", "active": True, "retained_bytes": 9 << 30}]}}),
    ("query_slowdown", {"deltas": {"changes": [{"id": "query.mean_ms", "subject": "queryid 7", "before": 5.0, "after": 10.0}]}}, "warn", 50.0,
     {"deltas": {"changes": [{"id": "query.mean_ms", "subject": "queryid 7", "before": 4.0, "after": 9.9}]}}),
    ("subscription_worker_down", {"replication": {"subscriptions": [{"name": "s", "worker_running": False}]}}, "warn", 60.0, {"replication": {"subscriptions": [{"name": "s", "worker_running": True}]}}),
    ("pgss_entries_evicted", {"queries": {"enabled": True, "pgss_count": 5000, "pgss_max": 5000}}, "warn", 25.0, {"queries": {"enabled": True, "pgss_count": 4999, "pgss_max": 5000}}),
    ("work_mem_low", {"health": {"temp_bytes_per_sec": 1048576.0}}, "warn", None, {"health": {"temp_bytes_per_sec": 1048575.0}}),
    ("checkpoints_forced", {"io": {"checkpoints_requested": 3, "checkpoints_timed": 7}}, "warn", 30.0, {"io": {"checkpoints_requested": 9, "checkpoints_timed": 0}}),
    ("connections_overprovisioned", {"limits": {"connections_used": 29, "connections_max": 200}}, "info", 20.0, {"limits": {"connections_used": 30, "connections_max": 200}}),
    ("fsync_off", {"settings": {"params": {"fsync": "off"}}}, "critical", 95.0, {"settings": {"params": {"fsync": "on"}}}),
    ("full_page_writes_off", {"settings": {"params": {"full_page_writes": "off"}}}, "critical", 90.0, {}),
    ("autovacuum_off", {"settings": {"params": {"autovacuum": "off"}}}, "critical", 88.0, {}),
    ("random_page_cost_high", {"server": {"provider": "rds"}, "settings": {"params": {"random_page_cost": "4"}}}, "warn", 40.0, {"server": {"provider": "own"}, "settings": {"params": {"random_page_cost": "4"}}}),
    ("work_mem_overcommit", {"settings": {"params": {"work_mem": "64MB", "effective_cache_size": "1GB", "max_connections": "17"}}}, "warn", 45.0,
     {"settings": {"params": {"work_mem": "64MB", "effective_cache_size": "1GB", "max_connections": "16"}}}),
    ("statement_timeout_unset", {"settings": {"params": {"statement_timeout": "0"}}}, "info", 20.0, {"settings": {"params": {"statement_timeout": "30s"}}}),
    ("io_timing_off", {"settings": {"params": {"track_io_timing": "off"}}}, "info", 15.0, {}),
    ("high_rollback_ratio", {"health": {"rollback_ratio": 0.1, "tps": 20.0}, "window": {"sample_seconds": 1.0}}, "warn", 10.0, {"health": {"rollback_ratio": 0.5, "tps": 19.0}, "window": {"sample_seconds": 1.0}}),
    ("pg_stat_statements_missing", {"queries": {"enabled": False}}, "info", 15.0, {}),
    ("stale_stats_window", {"window": {"stats_window_days": 30.0}}, "info", 12.0, {"window": {"stats_window_days": 29.9}}),
    ("wait_io_bound", {"wait_profile": {"available": True, "samples": 20, "buckets": [{"type": "IO", "count": 11, "share": 0.55}]}}, "warn", 55.0,
     {"wait_profile": {"available": True, "samples": 19, "buckets": [{"type": "IO", "count": 11, "share": 0.55}]}}),
    ("wait_lwlock_pressure", {"wait_profile": {"available": True, "samples": 200, "buckets": [{"type": "LWLock", "count": 1, "share": 0.9, "events": [{"event": "WALWrite", "count": 1, "share": 0.31}]}]}}, "warn", 31.0,
     {"wait_profile": {"available": True, "samples": 200, "buckets": [{"type": "LWLock", "count": 1, "share": 0.9, "events": [{"event": "WALWrite", "count": 1, "share": 0.3}]}]}}),
    ("wait_lock_contention", {"wait_profile": {"available": True, "samples": 100, "by_query": [{"query_id": 7, "count": 50, "share": 0.5, "lock_share": 0.8}]}}, "warn", 80.0,
     {"wait_profile": {"available": True, "samples": 100, "by_query": [{"query_id": 7, "count": 4, "share": 0.5, "lock_share": 0.8}]}}),
]


@pytest.fixture(scope="module")
def graded(spark):
    """All boundary documents graded in one job."""
    docs = []
    for i, (_id, fires, _sev, _score, silent) in enumerate(CASES):
        for side, doc in (("fires", fires), ("silent", silent)):
            base = {"schema_version": "1.2.0", "fingerprint": f"{side}-{i}", "collected_at": "2026-01-10T00:00:00Z", "queries": {"enabled": True}}
            docs.append((json.dumps({**base, **doc}),))
    df = spark.createDataFrame(docs, "document string").repartition(8)
    found, _ = context_findings(X.parse_contexts(df))
    out = {}
    for r in found.collect():
        out.setdefault((r["target_id"], r["id"]), []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rule_boundary(graded, i):
    id_, _fires, severity, score, _silent = CASES[i]
    hit = graded.get((f"fires-{i}", id_), [])
    assert len(hit) == 1
    assert hit[0]["severity"] == severity
    if score is not None:
        assert hit[0]["score"] == pytest.approx(score)
    assert (f"silent-{i}", id_) not in graded


def test_every_rule_is_covered():
    covered = {c[0] for c in CASES} | {"index_invalid", "suppression_expired", "suppression_unused"}
    assert covered == set(KNOWN_IDS) and set(FAMILY_OF) | {"suppression_expired", "suppression_unused"} == set(KNOWN_IDS)


def test_catalogue_is_consistent(spark):
    assert len(RULES) == len(set(KNOWN_IDS)) == 58 and set(ADVICE) == set(KNOWN_IDS)
    assert sorted(SCHEMA_IDS) == sorted(["index_invalid", "redundant_indexes", "fk_unindexed", "int4_identity_column", "autovacuum_disabled_on_table"])
    assert set(TUNING_IDS) <= set(KNOWN_IDS) and "work_mem_low" not in CLUSTER_WIDE_IDS
    cat = rule_catalog(spark)
    related = cat.select(F.explode("related").alias("id")).distinct()
    assert related.join(cat, "id", "left_anti").count() == 0
    assert by_dimension(spark).first()["dimension"] == "cost"


def test_cold_window_mutes_only_counter_rules(grade):
    doc = {**one_table(live_tuples=60_000, seq_scans=5000, index_scans=1, dead_ratio=0.3, dead_tuples=30_000), "indexes": {"unused": [index_()]},
           "health": {"cache_hit_ratio": 0.5, "cache_blocks_sampled": 50_000}}
    warm = grade({**doc, "window": {"window_age_seconds": 900}})
    cold = grade({**doc, "window": {"window_age_seconds": 899}})
    assert {"seq_scan_heavy", "unused_indexes", "low_cache_hit", "table_bloat"} <= set(warm)
    assert not {"seq_scan_heavy", "unused_indexes", "low_cache_hit"} & set(cold) and "table_bloat" in cold


def test_unused_index_confidence_and_caveats(grade):
    doc = {"indexes": {"unused": [index_(partial=True), index_(index="j", expression=True)]}, "window": {"window_age_seconds": 86_400}, "replication": {"is_replica": True},
           **one_table(mods_since_analyze=1001)}
    f = grade(doc)["unused_indexes"][0]
    assert f["confidence"] == 0.4 and len(f["caveats"]) == 5 and f["n_objects"] == 2
    assert grade({"indexes": {"unused": [index_()]}, "window": {"window_age_seconds": 8 * 86_400}})["unused_indexes"][0]["confidence"] == 0.8


def test_invalid_index_states(spark):
    o = spark.createDataFrame([(1, 1, "index", "p.t.a", True, True, True, 100), (2, 1, "index", "p.t.b", True, False, True, 0), (3, 1, "index", "p.t.c", True, True, False, 0), (4, 1, "index", "p.t.d", True, True, True, 5),
                               (5, 1, "table", "p.t", True, True, True, 0)],
                              "target_id long, snapshot_id long, kind string, identity string, invalid boolean, ready boolean, live boolean, bytes long")
    ctx = spark.createDataFrame([(4, 1, True)], "target_id long, snapshot_id long, build_running boolean")
    got = {r["target_id"]: (r["severity"], r["score"], r["confidence"]) for r in R.row_findings(R.invalid_index_rows(o), ctx).collect()}
    assert got == {1: ("critical", 85.0, 1.0), 2: ("warn", 45.0, 1.0), 3: ("warn", 45.0, 1.0), 4: ("warn", 85.0, 0.5)}


def test_managed_providers_soften_archiving(grade):
    doc = {"server": {"provider": "neon"}, "archiver": {"last_failed_time": "2026-01-09T00:00:00Z"}, "settings": {"params": {"archive_mode": "off", "wal_level": "replica"}}}
    g = grade(doc)
    assert g["archiving_failing"][0]["severity"] == "info" and g["archiving_disabled"][0]["severity"] == "info" and len(g["archiving_failing"][0]["caveats"]) == 1


def test_thresholds_replace_the_defaults(spark, grade):
    thr = spark.createDataFrame([("f", 0.5, 10_000_000, 10.0)], "target_id string, dead_ratio_warn double, unused_index_min_bytes long, replica_lag_warn_sec double")
    doc = {**one_table(dead_ratio=0.4, dead_tuples=50_000), "indexes": {"unused": [index_()]}, "wal": {"bytes_per_sec": 1.0}, "replication": {"replicas": [{"application_name": "r", "replay_lag_sec": 12.0}]}}
    assert {"table_bloat", "unused_indexes"} <= set(grade(doc)) and "replica_lag_time" not in grade(doc)
    tuned = grade(doc, thresholds=thr)
    assert not {"table_bloat", "unused_indexes"} & set(tuned) and "replica_lag_time" in tuned


def test_one_finding_per_slot(grade):
    slots = [{"name": "a", "active": False, "retained_bytes": 600 << 20}, {"name": "b", "active": True, "retained_bytes": 0, "wal_status": "lost"}]
    got = sorted((r["object"], r["severity"], r["score"]) for r in grade({"replication": {"slots": slots}})["replication_slot_inactive"])
    assert got == [("slot:a", "warn", 55.0), ("slot:b", "critical", 92.0)]


# --- documents, exports, front door ----------------------------------------------


def test_contexts_round_trip(spark, tmp_path):
    arr = [{"schema_version": "1.2.0", "fingerprint": f, "collected_at": f"2026-01-0{d}T00:00:00Z", "novel": {"x": [1]}, "queries": {"enabled": True},
            "settings": {"params": {"fsync": "off"}, "overrides": {"work_mem": "8MB"}}, **one_table()} for f in ("a", "b") for d in (2, 1)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(arr))
    docs = X.read_contexts(spark, str(tmp_path / "in"))
    assert docs.count() == 4
    assert [r["collected_at"].day for r in X.export_target(docs, "a").collect()] == [1, 2]
    assert X.drop_target(docs, "a").select("fingerprint").distinct().collect()[0][0] == "b"
    X.write_contexts(docs, str(tmp_path / "lines"))
    again = X.read_contexts(spark, str(tmp_path / "lines"), lines=True)
    assert sorted(map(str, again.select("fingerprint", "collected_at").collect())) == sorted(map(str, docs.select("fingerprint", "collected_at").collect()))
    assert {(r["kind"], r["name"], r["value"]) for r in X.setting_rows(docs).collect()} == {("tuning", "fsync", "off"), ("override", "work_mem", "8MB")}
    fl = Fleet(spark).from_contexts(str(tmp_path / "in"), str(tmp_path / "landed"))
    f = fl.findings()
    assert {r["id"] for r in f.collect()} == {"fsync_off"} and f.count() == 4
    rules = spark.createDataFrame([(0, "fsync_off", None, "lab", None)], "ordinal long, finding string, object string, reason string, expires string")
    assert {r["suppressed"] for r in fl.findings(rules=rules, now="2026-01-01").collect()} == {True}
    assert {r["health_score"] for r in fl.scores().collect()} == {90}


def test_event_log_appends(spark, tmp_path):
    ev = spark.createDataFrame([(1, 2, "config.changed", "x", "1", "2", 10, 20, 0.5)],
                               "target_id long, snapshot_id long, kind string, object string, before string, after string, occurred_after long, occurred_before long, confidence double")
    for _ in range(2):
        X.append_events(ev, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_fleet_from_tables(spark):
    t = spark.createDataFrame([(1, 1, 10, "public", "a", 10**9, 100_000, 50_000, 0, 5, 0, 0, 0, 1, None, 1, None, "off", None, None, None, None)],
                              "target_id long, snapshot_id long, collected_at long, schema string, table string, total_bytes long, live_tuples long, dead_tuples long, seq_scans long, index_scans long, "
                              "mods_since_analyze long, updates long, hot_updates long, last_vacuum long, last_autovacuum long, last_analyze long, last_autoanalyze long, rel_autovacuum_enabled string, "
                              "rel_vacuum_scale double, rel_vacuum_threshold double, rel_analyze_scale double, rel_analyze_threshold double")
    fl = Fleet(spark).from_tables({"table_stats": t})
    assert fl.families() == ["tables"]
    assert [r["id"] for r in fl.findings().orderBy("ordinal").collect()] == ["autovacuum_disabled_on_table", "table_bloat", "autovacuum_starved"]


TABLES = ("target_id long, snapshot_id long, collected_at long, schema string, table string, total_bytes long, live_tuples long, dead_tuples long, seq_scans long, index_scans long, "
          "mods_since_analyze long, updates long, hot_updates long, last_vacuum long, last_autovacuum long, last_analyze long, last_autoanalyze long, rel_autovacuum_enabled string, "
          "rel_vacuum_scale double, rel_vacuum_threshold double, rel_analyze_scale double, rel_analyze_threshold double")


def test_optional_tables_refine_the_rules(spark):
    def one(target, **kw):
        v = dict(live=100_000, dead=30_000, seq=5_000, idx=10, mods=30_000, **kw)
        return (target, 1, 10, "public", "a", 10**9, v["live"], v["dead"], v["seq"], v["idx"], v["mods"], 0, 0, 1, 1, 1, 1, None, None, None, None, None)
    t = spark.createDataFrame([one(1), one(2)], TABLES)
    params = spark.createDataFrame([(2, "autovacuum_analyze_scale_factor", "0.9"), (2, "autovacuum_analyze_threshold", "odd")], "target_id long, name string, value string")
    windows = spark.createDataFrame([(1, 1, 900), (2, 1, 10)], "target_id long, snapshot_id long, window_age_seconds long")
    thr = policy.threshold_columns(spark.createDataFrame([(1, "dead_ratio_warn", 0.5), (2, "dead_ratio_warn", 7.0)], "target_id long, key string, value double"))
    plain = Fleet(spark).from_tables({"table_stats": t}).findings()
    assert {(r["target_id"], r["id"]) for r in plain.collect()} == {(x, i) for x in (1, 2) for i in ("table_bloat", "seq_scan_heavy", "stale_statistics")}
    refined = Fleet(spark).from_tables({"table_stats": t, "params": params, "windows": windows}).findings(thresholds=thr)
    assert {(r["target_id"], r["id"]) for r in refined.collect()} == {(1, "seq_scan_heavy"), (1, "stale_statistics"), (2, "table_bloat")}


def test_unusable_documents_are_split_off(spark):
    df = spark.createDataFrame([('{"fingerprint": "a", "collected_at": "2026-01-01T00:00:00Z", "schema_version": "1.0.0"}',), ("not json",), ('{"fingerprint": "b"}',)], "document string")
    good, bad = X.split_contexts(X.parse_contexts(df))
    assert (good.count(), bad.count()) == (1, 2)


def _sample_findings(spark):
    return spark.createDataFrame([(1, 1, "fsync_off", "setting:fsync", "critical", "risk", 95.0, 1.0, "fsync is off", 0, [], False, "", False),
                                  (1, 1, "table_bloat", "", "warn", "storage", 40.0, 0.7, "1 table(s)", 1, [], True, "", False),
                                  (1, 1, "io_timing_off", "", "info", "throughput", 15.0, 1.0, "t", 0, [], False, "", True)],
                                 "target_id long, snapshot_id long, id string, object string, severity string, dimension string, score double, confidence double, title string, n_objects long, "
                                 "caveats array<string>, suppressed boolean, suppression_reason string, preexisting boolean")


def test_metric_text_has_one_header_per_family(spark):
    facts = spark.createDataFrame([(1, 1, 0.5, None)], "target_id long, snapshot_id long, cache_hit_ratio double, tps double")
    lines = [r[0] for r in metric_text(metric_rows(_sample_findings(spark), facts)).collect()]
    assert lines[0] == "# HELP fleet_finding One series per finding." and lines[1] == "# TYPE fleet_finding gauge"
    assert len([x for x in lines if x.startswith("# HELP")]) == 3  # no header for the absent gauge
    assert 'fleet_findings_total{target="1",severity="critical"} 1.0' in lines and 'fleet_findings_total{target="1",severity="warn"} 0.0' in lines
    assert 'fleet_finding{target="1",id="fsync_off",severity="critical",dimension="risk",object="setting:fsync",suppressed="false",preexisting="false",destructive="false"} 1.0' in lines
    assert lines[-1] == 'fleet_cache_hit_ratio{target="1"} 0.5'


def test_scan_results_and_cases(spark):
    r = {x["rule_id"]: x for x in scan_results(_sample_findings(spark)).collect()}
    assert set(r) == {"fsync_off", "table_bloat"} and r["fsync_off"]["level"] == "error" and r["table_bloat"]["suppression"] == "suppressed by configuration"
    assert r["table_bloat"]["location"] == "cluster" and r["fsync_off"]["message"].startswith("fsync is off - ")
    c = {x["name"]: x["status"] for x in case_rows(_sample_findings(spark), "info").collect()}
    assert c == {"fsync_off setting:fsync": "failed", "table_bloat": "skipped", "io_timing_off": "passed"}


def test_documents_preview_bounded_evidence(spark):
    rows = spark.range(25).select(F.lit(1).cast("long").alias("target_id"), F.lit(1).cast("long").alias("snapshot_id"), F.lit("table_bloat").alias("id"), F.concat(F.lit("o"), "id").alias("object"),
                                  F.col("id").cast("string").alias("evidence"), F.col("id").cast("double").alias("position"))
    f = _sample_findings(spark).where("id = 'table_bloat'").withColumn("ordinal", F.lit(1))
    d = finding_documents(f, rows).first()["findings"][0]
    assert d["evidence"] == [str(24 - i) for i in range(10)]


def test_settings_of_a_snapshot_count_for_it_only(spark):
    from vitalgrid.plans import rules as R

    rows = [(1, 1, "fsync", "on"), (1, 2, "fsync", "off")]
    by_run = R.pivot_settings(spark.createDataFrame(rows, "target_id long, snapshot_id long, name string, value string"), ["fsync"])
    assert sorted((r["snapshot_id"], r["p_fsync"]) for r in by_run.collect()) == [(1, "on"), (2, "off")]
    plain = R.pivot_settings(spark.createDataFrame([(1, "fsync", "on")], "target_id long, name string, value string"), ["fsync"])
    assert plain.columns == ["target_id", "p_fsync"]


def test_deltas_of_counters_and_none_across_a_reset(spark):
    day = 86_400
    rows = [(1, 1, 1 * day, 20, 0, 0), (1, 2, 2 * day, 200, 0, 0), (1, 3, 3 * day, 20, int(2.5 * day), 0), (2, 1, 1 * day, 20, 0, 0), (2, 2, 2 * day, 21, 0, int(1.5 * day))]
    counters = spark.createDataFrame(rows, "target_id long, snapshot_id long, collected_at long, numbackends long, stats_reset_at long, postmaster_start_at long")
    fl = Fleet(spark).from_tables({"db_counters": counters})
    assert [(r["target_id"], r["snapshot_id"], r["before"], r["after"]) for r in fl.deltas().collect()] == [(1, 2, 20.0, 200.0)]
    assert sorted((r["target_id"], r["kind"]) for r in fl.events().collect()) == [(1, "stats.reset"), (2, "server.restarted")]


def test_cycles_of_partitions_end(spark):
    from vitalgrid.operators import catalog

    edges = spark.createDataFrame([(1, 1, "a", "b"), (1, 1, "b", "a"), (1, 1, "leaf", "a"), (1, 1, "x", "top"), (1, 1, "y", "x")], "target_id long, snapshot_id long, child string, parent string")
    got = {r["child"]: r["root"] for r in catalog.partition_roots(edges).collect()}
    assert got["y"] == "top" and got["x"] == "top" and got["leaf"] == "a"


def test_settings_hold_until_they_are_set_anew(spark):
    from vitalgrid.plans import families

    snaps = spark.createDataFrame([(1, i, i * 10) for i in range(1, 7)] + [(2, 1, 10)], "target_id long, snapshot_id long, collected_at long")
    params = spark.createDataFrame([(1, 2, "fsync", "off"), (1, 2, "autovacuum", "on"), (1, 4, "fsync", "on"), (1, 5, "autovacuum", "off")], "target_id long, snapshot_id long, name string, value string")
    got = {(r["target_id"], r["snapshot_id"]): (r["p_fsync"], r["p_autovacuum"]) for r in families.with_settings(snaps, params, ["fsync", "autovacuum"]).collect()}
    assert got == {(1, 1): (None, None), (1, 2): ("off", "on"), (1, 3): ("off", "on"), (1, 4): ("on", "on"), (1, 5): ("on", "off"), (1, 6): ("on", "off"), (2, 1): (None, None)}


def test_blocked_sessions_without_a_wait_time_are_no_emergency(spark):
    from vitalgrid.plans import rules as R

    facts = spark.createDataFrame([(1, 1, 2, None), (1, 2, 2, 50.0)], "target_id long, snapshot_id long, blocked long, max_wait_s double")
    got = {r["snapshot_id"]: (r["score"], r["title"]) for r in R.fact_findings(facts, ["blocking_chains"]).collect()}
    assert got[1][0] == 86.0 and "longest" not in got[1][1] and got[2][0] == 91.0


def test_front_door_without_and_with_few_tables(spark):
    empty = Fleet(spark).from_tables({})
    assert empty.deltas().count() == empty.events().count() == empty.findings().count() == empty.evidence().count() == empty.suppressed_deltas().count() == 0
    slots = spark.createDataFrame([(1, 1, "s1", False, "lost", 0)], "target_id long, snapshot_id long, name string, active boolean, wal_status string, retained_bytes long")
    few = Fleet(spark).from_tables({"slots": slots})
    assert few.deltas().count() == 0 and few.evidence().count() == 0
    assert {r["id"] for r in few.findings().collect()} == {"replication_slot_inactive"}


def test_one_baseline_for_all_measures(spark):
    """Three runs close together: every measure is compared with the first, not some with the run before."""
    heads = [(1, 1, 0), (1, 2, 1000), (1, 3, 1060)]
    counters = spark.createDataFrame([(*h, n, 0, 0, z) for h, n, z in zip(heads, (20, 200, 205), (10 ** 9, 5 * 10 ** 9, 5 * 10 ** 9))],
                                     "target_id long, snapshot_id long, collected_at long, numbackends long, stats_reset_at long, postmaster_start_at long, db_size_bytes long")
    statements = spark.createDataFrame([(*h, 7, 100, u) for h, u in zip(heads, (100_000, 5_000_000, 5_000_000))], "target_id long, snapshot_id long, collected_at long, queryid long, calls long, total_us long")
    instances = spark.createDataFrame([(*h, f) for h, f in zip(heads, (0, 3, 3))], "target_id long, snapshot_id long, collected_at long, failed_count long")
    got = Fleet(spark).from_tables({"db_counters": counters, "statements": statements, "instances": instances}).deltas()
    ids = {"query.mean_ms", "health.connections", "database.size_bytes", "archiver.failed_count"}
    assert {(r["snapshot_id"], r["id"]) for r in got.collect()} == {(s, i) for s in (2, 3) for i in ids}
    assert {r["first_observed"] for r in got.collect()} == {0}


def test_settings_are_dealt_out_before_they_are_sorted(spark):
    """One file of settings is one task: a sort ahead of the exchange would hold all of it."""
    df = R.pivot_settings(spark.createDataFrame([(1, "fsync", "off"), (1, "wal_level", "replica"), (2, "fsync", "on"), (2, "other", "x")],
                                                "target_id long, name string, value string"), ["fsync", "wal_level"])
    assert sorted(map(tuple, df.collect())) == [(1, "off", "replica"), (2, "on", None)]
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Exchange" in plan and "Aggregate" not in plan.split("Exchange", 1)[1] and "Sort" not in plan.split("Exchange", 1)[1]


def test_settings_of_one_file_are_spread_in_many_tasks(spark):
    """Every instance gives a row per setting; a task that spreads a whole file's instances holds all those rows for the next exchange."""
    from vitalgrid.sources.testbed import Testbed

    settings = Testbed(spark, "/root/testdata/sf0.001").params()
    sizes = [r["count"] for r in settings.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 19 * spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert max(sizes) < sum(sizes) / 3
