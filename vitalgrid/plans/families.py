"""Findings by telemetry family, built from a set of telemetry tables.

Each family reads its own tables once and evaluates all of its rules in that pass.
``fleet_findings`` unites them; a caller that wants a few ids only pays for the families
that can produce them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import ratio
from vitalgrid.operators import catalog, deltas, rates, sessions, waits
from vitalgrid.operators.series import asof, carried
from vitalgrid.plans import rules as R

SNAP = ["target_id", "snapshot_id"]

FAMILIES: dict[str, list[str]] = {
    "instances": ["connection_saturation", "txid_wraparound", "mxid_wraparound", "sync_rep_degraded", "recovery_conflicts",
                  "ignore_checksum_failure_on", "checksums_disabled", "archiving_failing", "archiving_stalled", "archiving_disabled",
                  "pgss_entries_evicted", "checkpoints_forced", "connections_overprovisioned", "fsync_off", "full_page_writes_off",
                  "autovacuum_off", "random_page_cost_high", "work_mem_overcommit", "statement_timeout_unset", "io_timing_off",
                  "pg_stat_statements_missing", "stale_stats_window"],
    "health": ["low_cache_hit", "work_mem_low", "high_rollback_ratio"],
    "activity": ["blocking_chains", "idle_in_transaction", "long_running_transaction", "autovacuum_saturated", "autovacuum_long_running"],
    "waits": ["wait_io_bound", "wait_lwlock_pressure", "wait_lock_contention"],
    "tables": ["table_bloat", "seq_scan_heavy", "autovacuum_disabled_on_table", "table_never_vacuumed", "autovacuum_starved",
               "stale_statistics", "never_analyzed", "low_hot_update_ratio"],
    "partitions": ["partition_seq_scan_heavy"],
    "unused": ["unused_indexes"], "redundant": ["redundant_indexes"], "fks": ["fk_unindexed"], "invalid": ["index_invalid"],
    "sequences": ["sequence_exhaustion"], "narrow": ["int4_identity_column"], "checksums": ["checksum_failures"],
    "replicas": ["replica_lag_time", "replica_disconnected"],
    "slots": ["replication_slot_inactive"], "subscriptions": ["subscription_worker_down"],
    "horizon": ["vacuum_horizon_blocked", "prepared_xact_abandoned"], "slowdowns": ["query_slowdown"],
}

# Rules that grade rows of a table; the other rules grade facts or single objects.
ROW_RULE_IDS = [i for f in ("tables", "partitions", "unused", "redundant", "fks", "invalid", "sequences", "narrow", "checksums") for i in FAMILIES[f]] + ["replica_lag_time"]

FAMILY_OF = {i: f for f, ids in FAMILIES.items() for i in ids}


def _attached(src, df: DataFrame, name: str, keys: list[str], *columns: str) -> DataFrame:
    """Join an optional table of the source: per-target thresholds, counter windows, cluster settings."""
    get = getattr(src, name, None)
    if get is None:
        return df
    extra = get()
    wanted = [x for x in columns if x in extra.columns and x not in df.columns]
    keys = [*keys, *[k for k in ("snapshot_id",) if k in extra.columns and k not in keys]]
    return df.join(extra.select(*keys, *wanted), keys, "left") if wanted else df


def _graded_by(src, df: DataFrame, threshold: str) -> DataFrame:
    df = _attached(src, df, "thresholds", ["target_id"], threshold)
    return _attached(src, df, "windows", SNAP, "window_age_seconds")


def vacuum_settings(params: DataFrame) -> DataFrame:
    """The cluster-wide autovacuum settings per target, as numbers."""
    names = {"vacuum_threshold": "autovacuum_vacuum_threshold", "vacuum_scale": "autovacuum_vacuum_scale_factor",
             "analyze_threshold": "autovacuum_analyze_threshold", "analyze_scale": "autovacuum_analyze_scale_factor"}
    p = R.pivot_settings(params, names.values())
    return p.select(*R.setting_keys(p), *[F.col("p_" + n).try_cast("double").alias(a) for a, n in names.items()])


def _held(rows: DataFrame, settings: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the settings that hold at their snapshot.

    Settings of a target hold for all of its snapshots. Settings that carry a snapshot hold from then on, each until it is set
    anew: a snapshot without settings of its own has those of the newest one before it.
    """
    if "snapshot_id" not in settings.columns:
        return rows.join(settings.select("target_id", *columns), "target_id", "left")
    wide = settings.groupBy("target_id", F.col("snapshot_id").alias("_set_at")).agg(*[F.max(n).alias(n) for n in columns])
    known = carried(wide, ["target_id"], "_set_at", lasts={"k_" + n: F.col(n) for n in columns})
    held = known.select("target_id", "_set_at", *[F.col("k_" + n).alias(n) for n in columns])
    at = asof(rows.select(*SNAP).distinct(), held, ["target_id"], F.col("snapshot_id"), "_set_at", columns, prefix="")
    return rows.join(at, SNAP, "left")


def with_settings(rows: DataFrame, params: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rows with their settings as ``p_<name>``."""
    settings = R.pivot_settings(params, names)
    return _held(rows, settings, [n for n in settings.columns if n.startswith("p_")])


def instance_facts(src) -> DataFrame:
    conflicts = sum((F.col("conflict_" + n) for n in ("lock", "bufferpin", "deadlock", "tablespace")), F.col("conflict_snapshot"))
    facts = with_settings(src.instances(), src.params(), R.setting_names())
    return facts.withColumn("conflicts", conflicts).withColumns(rates.window_columns())


def health_facts(src) -> DataFrame:
    return rates.health_rates(src.db_counters()).withColumns(rates.window_columns())


def activity_facts(src) -> DataFrame:
    facts = sessions.activity_rollup(src.activity()).join(sessions.blocked_sessions(src.lock_waits()), SNAP, "left")
    return with_settings(facts, src.session_params(), ["autovacuum_max_workers"])


def wait_facts(src) -> DataFrame:
    w = waits.wait_summary(src.ash())
    return w.select("target_id", F.col("window_id").alias("snapshot_id"), F.col("samples").alias("wait_samples"),
                    ratio("io", "samples").alias("io_share"),
                    F.when(F.col("top_lwlock").isNotNull(), ratio(-F.col("top_lwlock.n"), "samples")).otherwise(ratio("lwlock", "samples")).alias("lwlock_share"),
                    F.coalesce("top_lwlock.event", F.lit("LWLock")).alias("lwlock_event"))


def baselines(src, snapshots: DataFrame) -> DataFrame:
    """The snapshots' baselines, without those across a counter reset or restart where the source knows counters."""
    shared = getattr(src, "baselines", None)
    if shared is not None:
        return shared()
    has = getattr(src, "has", None)
    if has is not None and not has("db_counters"):
        return deltas.delta_baselines(snapshots)
    return deltas.split_baselines(snapshots, src.db_counters())[0]


def statement_deltas(src) -> DataFrame:
    st = src.statements()
    return deltas.query_deltas(st, baselines(src, st))


def table_evidence(src, only: Iterable[str] | None = None) -> DataFrame:
    t = _graded_by(src, R.dead_ratio(src.table_stats()), "dead_ratio_warn")
    get, wanted = getattr(src, "vacuum_settings", None), ("vacuum_threshold", "vacuum_scale", "analyze_threshold", "analyze_scale")
    if get is not None:
        known = get()
        t = _held(t, known, [n for n in wanted if n in known.columns and n not in t.columns])
    return R.table_rows(t, only)


def unused_evidence(src) -> DataFrame:
    u = _graded_by(src, catalog.unused_indexes(src.indexes()), "unused_index_min_bytes")
    return R.unused_index_rows(u, R.write_heavy(src.index_table_stats()))


def invalid_evidence(src) -> DataFrame:
    return R.invalid_index_rows(src.schema_objects().where((F.col("kind") == "index") & F.col("invalid")))


def fk_evidence(src) -> DataFrame:
    return R.fk_rows(catalog.unindexed_fks(src.foreign_keys(), src.indexes()))


def narrow_evidence(src) -> DataFrame:
    return R.narrow_rows(catalog.narrow_identity(src.narrow_columns()))


def partition_evidence(src) -> DataFrame:
    p = catalog.partition_rollup(src.partition_edges(), src.partition_leaves())
    p = _attached(src, p, "windows", SNAP, "window_age_seconds")
    return R.partition_rows(p)


def _replica_rows(src) -> DataFrame:
    """Replicas with their target's WAL rate at the same snapshot."""
    r = _attached(src, src.replicas(), "thresholds", ["target_id"], "replica_lag_warn_sec")
    if "wal_bytes_per_sec" in r.columns:
        return r
    return r.join(rates.wal_rates(src.wal_io()).select(*SNAP, "wal_bytes_per_sec"), SNAP, "left")


def _gone_facts(src) -> DataFrame:
    r = src.replicas()
    gone = deltas.standby_gone(r, baselines(src, r))
    return gone.groupBy(*SNAP).agg(F.min("subject").alias("standby_gone"))


def _evictions(src) -> DataFrame | None:
    """Per snapshot what is known of evicted statements."""
    has = getattr(src, "has", None)
    if has is None or not has("instances"):
        return None
    known = src.instances()
    names = [n for n in ("statements_dealloc", "statements_count", "statements_max") if n in known.columns]
    return known.select(*SNAP, *names) if names else None


def _slowdown_facts(src) -> DataFrame:
    w = deltas.worst_slowdown(statement_deltas(src))
    facts = w.select(*SNAP, F.col("factor").alias("slowdown_factor"), F.col("before").alias("slowdown_before"), F.col("after").alias("slowdown_after"),
                     F.regexp_extract("subject", r"(-?\d+)$", 1).try_cast("long").alias("slowdown_query"))
    known = _evictions(src)
    if known is not None:
        facts = facts.join(known, SNAP, "left")
    counts = ("statements_dealloc", "statements_count", "statements_max")
    return facts.select(*facts.columns[:6], *[(F.coalesce(n, F.lit(0)) if n in facts.columns else F.lit(0)).cast("long").alias(n) for n in counts])


def _build_context(src) -> DataFrame:
    """Snapshots during which an index build was running."""
    return (src.progress().where(F.col("operation") == "create_index").select(*SNAP).distinct()
            .withColumn("build_running", F.lit(True)))


def _context(src, ids: Iterable[str]) -> DataFrame | None:
    """Snapshot facts the wanted row rules depend on, where the source knows them."""
    context = _build_context(src) if "index_invalid" in set(ids) else None
    windows = getattr(src, "windows", None)
    if windows is None:
        return context
    known = windows()
    known = known.select(*SNAP, *[n for n in R.CONTEXT if n in known.columns])
    return known if context is None else known.join(context, SNAP, "full_outer")


def evidence_rows(src, only: Iterable[str] | None = None) -> DataFrame:
    """Long-form evidence of all row rules (or the wanted ones)."""
    parts: dict[str, Callable[[], DataFrame]] = {
        "tables": lambda: table_evidence(src, only), "partitions": lambda: partition_evidence(src), "unused": lambda: unused_evidence(src),
        "redundant": lambda: R.redundant_rows(catalog.redundant_indexes(src.indexes())), "fks": lambda: fk_evidence(src),
        "invalid": lambda: invalid_evidence(src),
        "sequences": lambda: R.sequence_rows(catalog.sequence_usage(src.sequences())), "narrow": lambda: narrow_evidence(src),
        "checksums": lambda: R.checksum_rows(src.checksum_failures()), "replicas": lambda: R.replica_lag_rows(_replica_rows(src)),
    }
    wanted = set(parts) if only is None else {FAMILY_OF[i] for i in only} & set(parts)
    out = None
    for name, build in parts.items():
        if name in wanted:
            df = build().select(*R.ROW)
            out = df if out is None else out.unionByName(df)
    return src.spark.createDataFrame([], R.ROW_SCHEMA) if out is None else out


def family_findings(src, family: str, only: Iterable[str] | None = None) -> DataFrame:
    """Findings of one family; ``only`` narrows the rules evaluated."""
    ids = FAMILIES[family] if only is None else [i for i in FAMILIES[family] if i in set(only)]
    facts = {"instances": instance_facts, "health": health_facts, "activity": activity_facts}
    if family in facts:
        return R.fact_findings(facts[family](src), ids)
    if family == "waits":
        parts = []
        if {"wait_io_bound", "wait_lwlock_pressure"} & set(ids):
            parts.append(R.fact_findings(wait_facts(src), ids))
        if "wait_lock_contention" in ids:
            parts.append(R.lock_contention_findings(waits.wait_by_query(src.ash())))
        return R.union_findings(*parts)
    if family == "replicas":
        parts = []
        if "replica_lag_time" in ids:
            parts.append(R.row_findings(R.replica_lag_rows(_replica_rows(src)), only=ids))
        if "replica_disconnected" in ids:
            parts.append(R.fact_findings(_gone_facts(src), ids))
        return R.union_findings(*parts)
    if family == "horizon":
        parts = []
        if "vacuum_horizon_blocked" in ids:
            parts.append(R.horizon_findings(src.horizon()))
        if "prepared_xact_abandoned" in ids:
            parts.append(R.prepared_findings(src.horizon()))
        return R.union_findings(*parts)
    if family == "slots":
        return R.slot_findings(src.slots()).select(*R.HEADER)
    if family == "subscriptions":
        return R.subscription_findings(src.subscriptions()).select(*R.HEADER)
    if family == "slowdowns":
        return R.fact_findings(_slowdown_facts(src), ids)
    return R.row_findings(evidence_rows(src, ids), _context(src, ids), ids)


def fleet_findings(src, only: Iterable[str] | None = None, families: Iterable[str] | None = None) -> DataFrame:
    """Findings of all wanted families. Row rules of all families share one aggregation."""
    fams = list(FAMILIES if families is None else families)
    wanted = [i for f in fams for i in FAMILIES[f] if only is None or i in set(only)]
    listed = [i for i in wanted if i in ROW_RULE_IDS]
    parts = [family_findings(src, f, [i for i in FAMILIES[f] if i in set(wanted) - set(listed)])
             for f in fams if set(FAMILIES[f]) & (set(wanted) - set(listed))]
    if listed:
        parts.append(R.row_findings(evidence_rows(src, listed), _context(src, listed), listed))
    return R.union_findings(*parts) if parts else src.spark.createDataFrame([], R.HEADER_SCHEMA)
