"""Finding rules.

Rules come in two forms. *Fact rules* look at one row of facts per (target, snapshot);
all of them are evaluated in a single projection. *Row rules* look at telemetry rows
(tables, indexes, replicas, ...) and emit one evidence row per hit; all of them share
one row layout, so one aggregation turns any number of row rules into findings.
Evidence stays in long form, so a finding with millions of objects is never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions import guc
from vitalgrid.functions.numbers import clamp, managed, ratio, round_dp, size_score
from vitalgrid.functions.text import human_bytes, human_count, query_tag, short_duration
from vitalgrid.plans.rule_catalog import RULES

# Rule thresholds.
UNUSED_INDEX_MIN_BYTES = 1 << 20
DEAD_RATIO_WARN = 0.20
REPLICA_LAG_WARN, REPLICA_LAG_CRIT = 60.0, 300.0
SIZEABLE_ROWS = 10_000
SEQ_SCAN_ROWS = 50_000
PARTITION_SEQ_SCANS = 1000
HOT_RATIO, HOT_UPDATES = 0.50, 10_000
WRITE_HEAVY_MODS = 1000
CACHE_HIT_WARN, CACHE_MIN_BLOCKS = 0.90, 10_000
COLD_SECONDS = 900
SHORT_STATS_SECONDS = 7 * 86_400
XID_WARN, XID_CRIT, XID_WALL = 1_000_000_000, 1_800_000_000, 2_147_483_647
HORIZON_WARN = 1_000_000
SLOT_WARN, SLOT_CRIT = 512 << 20, 8 << 30
WAIT_MIN_SAMPLES = 20
SEQ_WARN, SEQ_CRIT = 0.80, 0.90
WAL_DIR_LARGE = 10 << 30

DIMENSION = {r[0]: r[2] for r in RULES}
SNAP = ["target_id", "snapshot_id"]
HEADER = [*SNAP, "id", "object", "severity", "dimension", "score", "confidence", "title", "n_objects", "caveats"]
ROW = [*SNAP, "id", "object", "evidence", "position", "measure", "size", "f1", "f2", "f3"]
ROW_SCHEMA = ("target_id long, snapshot_id long, id string, object string, evidence string, position double, measure double, size long, "
              "f1 boolean, f2 boolean, f3 boolean")
HEADER_SCHEMA = ("target_id long, snapshot_id long, id string, object string, severity string, dimension string, score double, confidence double, "
                 "title string, n_objects long, caveats array<string>")

c = F.col


def cold() -> Column:
    return F.coalesce(c("window_age_seconds") < COLD_SECONDS, F.lit(False))


def _dim(expr: str | Column) -> Column:
    return F.lit(expr) if isinstance(expr, str) else expr


# --- fact rules ---------------------------------------------------------------


@dataclass(frozen=True)
class FactRule:
    """One finding per snapshot at most. ``needs`` lists the fact columns it reads."""

    id: str
    needs: tuple[str, ...]
    when: Callable[[], Column]
    score: Callable[[], Column]
    confidence: Callable[[], Column] | float
    title: Callable[[], Column]
    severity: Callable[[], Column] | str | None = None
    object: str = ""
    dimension: Callable[[], Column] | None = None
    caveats: list[tuple[Callable[[], Column], str]] = field(default_factory=list)


def _f(fmt: str, *cols: Column) -> Column:
    return F.format_string(fmt, *cols)


def _setting_is(name: str, value: str) -> Callable[[], Column]:
    return lambda: c("p_" + name) == value


def _const(x: float) -> Callable[[], Column]:
    return lambda: F.lit(float(x))


def _managed_severity(base: str) -> Callable[[], Column]:
    return lambda: F.when(managed("provider"), "info").otherwise(base)


def _archive_failing() -> Column:
    return F.coalesce(c("last_failed_at").isNotNull() & (c("last_archived_at").isNull() | (c("last_failed_at") > c("last_archived_at"))), F.lit(False))


def _archive_age() -> Column:
    return c("collected_at") - c("last_archived_at")


def _stall_seconds() -> Column:
    timeout = F.coalesce(guc.duration_micros(c("p_archive_timeout"), "s"), F.lit(0)) / 1_000_000
    return F.greatest(F.lit(3600.0), timeout * 3)


def _replicating() -> Column:
    return F.coalesce((c("replica_count") > 0) | c("is_replica"), F.lit(False))


def _wait_confidence() -> Column:
    return F.least(F.lit(0.9), F.lit(0.4) + c("wait_samples").cast("double") / 400)


def _wait_ready() -> Column:
    return c("wait_samples") >= WAIT_MIN_SAMPLES


def _worst_memory() -> Column:
    return F.try_multiply(guc.memory_bytes(c("p_work_mem")), c("p_max_connections").try_cast("long"))


def _wraparound(id_: str, age: str, label: str) -> FactRule:
    pct = lambda: c(age).cast("double") / XID_WALL * 100
    return FactRule(
        id_, (age,), lambda: c(age) >= XID_WARN, pct, 1.0,
        lambda: F.concat(F.lit(f"{label} age "), human_count(age), _f(", %.0f%% of the way to wraparound", pct())),
        severity=lambda: F.when(c(age) >= XID_CRIT, "critical").otherwise("warn"))


def _setting_rule(id_: str, setting: str, value: str, score: float, confidence: float, title: str) -> FactRule:
    return FactRule(id_, ("p_" + setting,), _setting_is(setting, value), _const(score), confidence,
                    lambda: F.lit(title), object="setting:" + setting)


_used_fraction = lambda: ratio("connections_used", "connections_max")
_forced = lambda: ratio("checkpoints_req", c("checkpoints_req") + c("checkpoints_timed"))
_evicting = lambda: (c("statements_dealloc") > 0) | ((c("statements_max") > 0) & (c("statements_count") >= c("statements_max")))

FACT_RULES = [
    FactRule("blocking_chains", ("blocked", "max_wait_s"), lambda: c("blocked") > 0,
             lambda: F.least(F.lit(100.0), 80 + c("blocked").cast("double") * 3 + F.coalesce("max_wait_s", F.lit(0)).cast("double") / 10), 1.0,
             lambda: F.when(c("max_wait_s").isNull(), _f("%d session(s) waiting for locks", c("blocked"))).otherwise(
                 _f("%d session(s) waiting for locks, longest %.0fs", c("blocked"), c("max_wait_s").cast("double")))),
    FactRule("autovacuum_saturated", ("autovacuum_workers", "p_autovacuum_max_workers"),
             lambda: (c("autovacuum_workers") > 0) & (c("p_autovacuum_max_workers").try_cast("long") > 0)
             & (c("autovacuum_workers") >= c("p_autovacuum_max_workers").try_cast("long")), _const(35), 0.5,
             lambda: _f("All autovacuum workers busy (%d in use)", c("autovacuum_workers")),
             caveats=[(lambda: F.lit(True), "a single moment, not sustained saturation; confirm over several runs")]),
    FactRule("autovacuum_long_running", ("autovacuum_max_age_s",), lambda: c("autovacuum_max_age_s") >= 3600, _const(15), 0.7,
             lambda: _f("An autovacuum worker has run for %.0fs", c("autovacuum_max_age_s"))),
    FactRule("low_cache_hit", ("cache_hit_ratio", "cache_blocks", "window_age_seconds"),
             lambda: ~cold() & (c("cache_blocks") >= CACHE_MIN_BLOCKS) & (c("cache_hit_ratio") < CACHE_HIT_WARN),
             lambda: F.least(F.lit(85.0), (1 - c("cache_hit_ratio")) * 300), 0.6,
             lambda: _f("Cache hit ratio %.1f%% over the sample window", c("cache_hit_ratio") * 100)),
    FactRule("idle_in_transaction", ("idle_in_transaction", "longest_xact_s"), lambda: c("idle_in_transaction") > 0,
             lambda: F.when(c("longest_xact_s") >= 60, F.least(F.lit(80.0), 50 + c("longest_xact_s") / 30)).otherwise(F.lit(30.0)), 0.7,
             lambda: _f("%d session(s) idle in a transaction", c("idle_in_transaction")),
             severity=lambda: F.when(c("longest_xact_s") >= 60, "warn").otherwise("info")),
    FactRule("long_running_transaction", ("longest_xact_s",), lambda: c("longest_xact_s") >= 300,
             lambda: F.least(F.lit(85.0), 55 + c("longest_xact_s") / 60), 0.8,
             lambda: _f("Longest transaction open for %.0fs", c("longest_xact_s"))),
    FactRule("wait_io_bound", ("wait_samples", "io_share"), lambda: _wait_ready() & (c("io_share") > 0.50),
             lambda: F.least(F.lit(90.0), c("io_share") * 100), _wait_confidence,
             lambda: _f("%.0f%% of active time waiting on IO", c("io_share") * 100)),
    FactRule("wait_lwlock_pressure", ("wait_samples", "lwlock_share", "lwlock_event"), lambda: _wait_ready() & (c("lwlock_share") > 0.30),
             lambda: F.least(F.lit(88.0), c("lwlock_share") * 100), _wait_confidence,
             lambda: F.concat(_f("%.0f%% of active time on one lightweight lock: ", c("lwlock_share") * 100), c("lwlock_event"))),
    FactRule("connection_saturation", ("connections_used", "connections_max"),
             lambda: (c("connections_max") > 0) & (_used_fraction() >= 0.85), lambda: _used_fraction() * 100, 1.0,
             lambda: _f("Connections at %.0f%% (%d of %d)", _used_fraction() * 100, c("connections_used"), c("connections_max")),
             severity=lambda: F.when(_used_fraction() >= 0.95, "critical").otherwise("warn")),
    _wraparound("txid_wraparound", "max_xid_age", "Transaction id"),
    _wraparound("mxid_wraparound", "max_mxid_age", "Multixact id"),
    FactRule("sync_rep_degraded", ("p_synchronous_commit", "p_synchronous_standby_names", "sync_count"),
             lambda: c("p_synchronous_commit").isin("on", "remote_write", "remote_apply")
             & (guc.required_standbys("p_synchronous_standby_names") > F.coalesce("sync_count", F.lit(0))), _const(88), 0.9,
             lambda: _f("Only %d of %d required synchronous standbys present", F.coalesce("sync_count", F.lit(0)).cast("long"),
                        guc.required_standbys("p_synchronous_standby_names"))),
    FactRule("recovery_conflicts", ("conflicts",), lambda: c("conflicts") > 0, _const(40), 0.7,
             lambda: _f("%d recovery conflict(s) on this standby", c("conflicts"))),
    FactRule("replica_disconnected", ("standby_gone",), lambda: c("standby_gone").isNotNull(), _const(55), 0.8,
             lambda: F.concat(F.lit("Standby no longer connected: "), c("standby_gone"))),
    _setting_rule("ignore_checksum_failure_on", "ignore_checksum_failure", "on", 90, 1.0, "Checksum failures are being ignored"),
    _setting_rule("checksums_disabled", "data_checksums", "off", 15, 1.0, "Data checksums are off"),
    FactRule("archiving_failing", ("last_failed_at", "last_archived_at", "failed_increase", "provider"),
             lambda: _archive_failing() | F.coalesce(c("failed_increase") > 0, F.lit(False)), _const(95), 0.95,
             lambda: F.lit("Log archiving is failing"), severity=_managed_severity("critical"),
             caveats=[(lambda: managed("provider"), "a managed provider's own backups are not visible here")]),
    FactRule("archiving_stalled", ("last_failed_at", "last_archived_at", "p_archive_mode", "p_archive_timeout", "wal_bytes_per_sec", "provider"),
             lambda: c("p_archive_mode").isin("on", "always") & ~_archive_failing() & (c("wal_bytes_per_sec") > 0)
             & (_archive_age() > _stall_seconds()), _const(90), 0.85,
             lambda: F.concat(F.lit("Nothing archived for "), short_duration(_archive_age())), severity=_managed_severity("critical"),
             caveats=[(lambda: managed("provider"), "a managed provider's own backups are not visible here")]),
    FactRule("archiving_disabled", ("p_archive_mode", "p_wal_level", "replica_count", "is_replica", "provider", "last_archived_at"),
             lambda: (c("p_archive_mode") == "off") & (c("p_wal_level") != "minimal") & ~_replicating(), _const(50), 0.8,
             lambda: F.lit("Log archiving is off"), severity=_managed_severity("warn"),
             caveats=[(lambda: managed("provider"), "a managed provider's own backups are not visible here")]),
    FactRule("query_slowdown", ("slowdown_factor", "slowdown_before", "slowdown_after", "slowdown_query"),
             lambda: c("slowdown_factor").isNotNull(), lambda: F.least(F.lit(90.0), 30 + c("slowdown_factor") * 10),
             lambda: F.when(F.coalesce(_evicting(), F.lit(False)), 0.4).otherwise(0.8),
             lambda: F.concat(F.lit("Query "), query_tag("slowdown_query"), _f(" is %.1fx slower (%.0f to %.0f ms)", c("slowdown_factor"),
                                                                              c("slowdown_before"), c("slowdown_after"))),
             caveats=[(lambda: F.coalesce(_evicting(), F.lit(False)), "statement entries are being evicted; the change may be an artefact")]),
    FactRule("pgss_entries_evicted", ("statements_enabled", "statements_dealloc", "statements_count", "statements_max"),
             lambda: c("statements_enabled") & _evicting(), _const(25), 0.85,
             lambda: _f("Statement entries are being evicted (%d of %d in use)", c("statements_count"), c("statements_max"))),
    FactRule("work_mem_low", ("temp_bytes_per_sec",), lambda: c("temp_bytes_per_sec") >= 1 << 20,
             lambda: F.least(F.lit(80.0), F.log10(F.floor("temp_bytes_per_sec").cast("double")) * 10), 0.7,
             lambda: F.concat(F.lit("Queries spill "), human_bytes("temp_bytes_per_sec"), F.lit("/s of temporary files")),
             object="setting:work_mem"),
    FactRule("checkpoints_forced", ("checkpoints_req", "checkpoints_timed"),
             lambda: (c("checkpoints_req") + c("checkpoints_timed") >= 10) & (_forced() >= 0.30),
             lambda: F.least(F.lit(75.0), _forced() * 100), 0.7,
             lambda: _f("%.0f%% of checkpoints forced by log volume", _forced() * 100), object="setting:max_wal_size"),
    FactRule("connections_overprovisioned", ("connections_used", "connections_max"),
             lambda: (c("connections_max") >= 200) & (c("connections_used").cast("double") < c("connections_max").cast("double") * 0.15),
             _const(20), 0.6, lambda: _f("%d connections allowed, %d used", c("connections_max"), c("connections_used"))),
    _setting_rule("fsync_off", "fsync", "off", 95, 1.0, "fsync is off"),
    _setting_rule("full_page_writes_off", "full_page_writes", "off", 90, 1.0, "full_page_writes is off"),
    _setting_rule("autovacuum_off", "autovacuum", "off", 88, 1.0, "autovacuum is off"),
    FactRule("random_page_cost_high", ("p_random_page_cost", "provider"),
             lambda: (guc.number(c("p_random_page_cost")) >= 4) & managed("provider"), _const(40), 0.7,
             lambda: F.concat(F.lit("random_page_cost "), c("p_random_page_cost"), F.lit(" on solid-state storage")),
             object="setting:random_page_cost"),
    FactRule("work_mem_overcommit", ("p_work_mem", "p_effective_cache_size", "p_max_connections"),
             lambda: (c("p_max_connections").try_cast("long") > 0) & (guc.memory_bytes(c("p_effective_cache_size")) > 0)
             & (_worst_memory() > guc.memory_bytes(c("p_effective_cache_size"))), _const(45), 0.55,
             lambda: F.concat(F.lit("Worst-case sort memory "), human_bytes(_worst_memory()), F.lit(" exceeds the stated cache size")),
             object="setting:work_mem"),
    _setting_rule("statement_timeout_unset", "statement_timeout", "0", 20, 0.8, "No statement timeout is set"),
    _setting_rule("io_timing_off", "track_io_timing", "off", 15, 1.0, "IO timing is off"),
    FactRule("high_rollback_ratio", ("rollback_ratio", "tps", "sample_seconds"),
             lambda: (c("rollback_ratio") >= 0.10) & (c("tps") * c("sample_seconds").cast("double") >= 20),
             lambda: F.least(F.lit(35.0), c("rollback_ratio") * 100), 0.5,
             lambda: _f("Rollback ratio %.1f%% over the sample window", c("rollback_ratio") * 100)),
    FactRule("pg_stat_statements_missing", ("statements_enabled",), lambda: ~F.coalesce("statements_enabled", F.lit(False)), _const(15), 1.0,
             lambda: F.lit("Statement statistics are not enabled")),
    FactRule("stale_stats_window", ("stats_window_days",), lambda: c("stats_window_days") >= 30, _const(12), 1.0,
             lambda: _f("Cumulative statistics span %.0f days", c("stats_window_days"))),
]


def _col(x: Callable[[], Column] | float | str | None, default: str = "") -> Column:
    if callable(x):
        return x()
    return F.lit(default if x is None else x)


_BASE_SEVERITY = {r[0]: r[1] for r in RULES}


def fact_findings(facts: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """All fact rules whose columns are present, in one pass over the fact rows."""
    have, wanted = set(facts.columns), None if only is None else set(only)
    hits = []
    for r in FACT_RULES:
        if (wanted is not None and r.id not in wanted) or not set(r.needs) <= have:
            continue
        notes = F.array_compact(F.array(*[F.when(w(), F.lit(t)) for w, t in r.caveats])) if r.caveats else F.array()
        hits.append(F.when(F.coalesce(r.when(), F.lit(False)), F.struct(
            F.lit(r.id).alias("id"), F.lit(r.object).alias("object"),
            _col(r.severity, _BASE_SEVERITY[r.id]).alias("severity"),
            (r.dimension() if r.dimension else F.lit(DIMENSION[r.id])).alias("dimension"),
            clamp(r.score(), 0, 100).alias("score"), _col(r.confidence).cast("double").alias("confidence"),
            r.title().alias("title"), F.lit(0).cast("long").alias("n_objects"),
            notes.cast("array<string>").alias("caveats"))))
    if not hits:
        raise ValueError("the facts carry no columns for the wanted rules")
    return facts.select(*SNAP, F.inline(F.array_compact(F.array(*hits))))


# --- row rules ----------------------------------------------------------------

# Facts about a snapshot that the row rules' wording, confidence and severity depend on.
CONTEXT = {"window_age_seconds": "long", "build_running": "boolean", "replication_in_use": "boolean",
           "horizon_pinned": "boolean", "slowdown_present": "boolean", "hypopg": "boolean"}


def _row(id_: str, hit: Column, obj: Column, evidence: Column, *, measure: Column | None = None, size: Column | None = None,
         position: Column | None = None, f1: Column | None = None, f2: Column | None = None, f3: Column | None = None) -> Column:
    def flag(x: Column | None) -> Column:
        return F.coalesce(x, F.lit(False)) if x is not None else F.lit(False)

    return F.when(F.coalesce(hit, F.lit(False)), F.struct(
        F.lit(id_).alias("id"), obj.alias("object"), evidence.alias("evidence"),
        (position if position is not None else F.lit(0.0)).cast("double").alias("position"),
        (measure if measure is not None else F.lit(None)).cast("double").alias("measure"),
        (size if size is not None else F.lit(0)).cast("long").alias("size"),
        flag(f1).alias("f1"), flag(f2).alias("f2"), flag(f3).alias("f3")))


def _rows(df: DataFrame, hits: dict[str, Column], only: Iterable[str] | None) -> DataFrame:
    wanted = [h for i, h in hits.items() if only is None or i in set(only)]
    return df.select(*SNAP, *[n for n in CONTEXT if n in df.columns], F.inline(F.array_compact(F.array(*wanted))))


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """Per-target threshold columns win over the built-in defaults."""
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(value))) if name in df.columns else df.withColumn(name, F.lit(value))


def table_rows(tables: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """Evidence rows of every per-table rule, in one pass.

    Optional columns: ``window_age_seconds``, ``dead_ratio_warn`` and the four cluster-wide
    autovacuum settings.
    """
    t = tables
    for name, value in (("dead_ratio_warn", DEAD_RATIO_WARN), ("vacuum_threshold", 50.0), ("vacuum_scale", 0.2),
                        ("analyze_threshold", 50.0), ("analyze_scale", 0.1)):
        t = with_default(t, name, value)
    if "window_age_seconds" not in t.columns:
        t = t.withColumn("window_age_seconds", F.lit(None).cast("long"))
    obj = F.concat_ws(".", "schema", "table")
    live, dead, seq, idx = c("live_tuples"), c("dead_tuples"), c("seq_scans"), c("index_scans")
    sizeable = live >= SIZEABLE_ROWS
    vac = F.coalesce("rel_vacuum_threshold", "vacuum_threshold") + F.coalesce("rel_vacuum_scale", "vacuum_scale") * live.cast("double")
    ana = F.coalesce("rel_analyze_threshold", "analyze_threshold") + F.coalesce("rel_analyze_scale", "analyze_scale") * live.cast("double")
    unvacuumed = c("last_vacuum").isNull() & c("last_autovacuum").isNull()
    unanalyzed = c("last_analyze").isNull() & c("last_autoanalyze").isNull()
    hot = ratio("hot_updates", "updates")
    hits = {
        "table_bloat": _row("table_bloat", (c("dead_ratio") >= c("dead_ratio_warn")) & (live + dead >= SIZEABLE_ROWS), obj,
                            F.concat(obj, _f(" %.0f%% dead (%d rows)", c("dead_ratio") * 100, dead)),
                            measure=c("dead_ratio") * c("total_bytes").cast("double"), f1=c("last_autovacuum").isNull(), position=c("total_bytes")),
        "seq_scan_heavy": _row("seq_scan_heavy", ~cold() & (live >= SEQ_SCAN_ROWS) & (seq + idx >= 100) & (seq > idx * 2), obj,
                               F.concat(obj, F.lit(" "), human_count(seq), F.lit(" sequential against "), human_count(idx), F.lit(" index scans")),
                               measure=seq.cast("double") * live.cast("double"), position=c("total_bytes")),
        "autovacuum_disabled_on_table": _row("autovacuum_disabled_on_table", guc.switched_off("rel_autovacuum_enabled"), obj, obj, position=c("total_bytes")),
        "table_never_vacuumed": _row("table_never_vacuumed", sizeable & unvacuumed, obj, F.concat(obj, F.lit(" ("), human_count(live), F.lit(" rows)")), position=c("total_bytes")),
        "autovacuum_starved": _row("autovacuum_starved", sizeable & ~unvacuumed & (vac > 0) & (dead.cast("double") >= vac * 1.5) & c("last_autovacuum").isNull(), obj,
                                   F.concat(obj, F.lit(": "), human_count(dead), F.lit(" dead, trigger "), human_count(vac)), position=c("total_bytes")),
        "stale_statistics": _row("stale_statistics", sizeable & ~unanalyzed & (ana > 0) & (c("mods_since_analyze").cast("double") >= ana * 2), obj,
                                 F.concat(obj, F.lit(": "), human_count("mods_since_analyze"), F.lit(" rows changed, trigger "), human_count(ana)), position=c("total_bytes")),
        "never_analyzed": _row("never_analyzed", sizeable & unanalyzed, obj, F.concat(obj, F.lit(" ("), human_count(live), F.lit(" rows)")), position=c("total_bytes")),
        "low_hot_update_ratio": _row("low_hot_update_ratio", (c("updates") >= HOT_UPDATES) & (hot < HOT_RATIO), obj,
                                     F.concat(obj, _f(": %.0f%% in place (", hot * 100), human_count("updates"), F.lit(" updates)")), measure=hot, position=c("total_bytes")),
    }
    return _rows(t, hits, only)


def partition_rows(parents: DataFrame) -> DataFrame:
    p = parents if "window_age_seconds" in parents.columns else parents.withColumn("window_age_seconds", F.lit(None).cast("long"))
    seq, idx = c("seq_scans"), c("index_scans")
    hit = ~cold() & (c("live_tuples") >= SEQ_SCAN_ROWS) & (seq >= PARTITION_SEQ_SCANS) & ~((idx > 0) & (seq < idx))
    return _rows(p, {"p": _row("partition_seq_scan_heavy", hit, c("root"),
                               F.concat(c("root"), _f(" (%d partitions): ", c("partitions")), human_count(seq), F.lit(" sequential against "),
                                        human_count(idx), F.lit(" index scans")), position=c("total_bytes"))}, None)


def unused_index_rows(unused: DataFrame, write_heavy: DataFrame | None = None) -> DataFrame:
    """``write_heavy`` lists (target, snapshot, schema, table) with many changes since analyze.

    It may be left out when ``unused`` already carries a ``heavy`` flag.
    """
    u = with_default(unused, "unused_index_min_bytes", UNUSED_INDEX_MIN_BYTES)
    if "window_age_seconds" not in u.columns:
        u = u.withColumn("window_age_seconds", F.lit(None).cast("long"))
    if write_heavy is not None:
        keys = [*SNAP, "schema", "table"]
        u = u.join(write_heavy.select(*keys).distinct().withColumn("heavy", F.lit(True)), keys, "left")
    heavy = F.coalesce("heavy", F.lit(False))
    score = F.when(heavy, F.least(F.lit(100.0), size_score("bytes") * 1.3)).otherwise(size_score("bytes"))
    obj = F.concat_ws(".", "schema", "index")
    return _rows(u, {"u": _row("unused_indexes", ~cold() & (c("bytes") >= c("unused_index_min_bytes")), obj,
                               F.concat(c("table"), F.lit("."), c("index"), F.lit(" ("), human_bytes("bytes"), F.lit(")")),
                               measure=score, size=c("bytes"), position=score, f1=heavy, f2=c("is_partial"), f3=c("is_expression") & ~c("is_partial"))}, None)


def redundant_rows(pairs: DataFrame) -> DataFrame:
    return _rows(pairs, {"r": _row("redundant_indexes", F.lit(True), F.concat_ws(".", "schema", "index"),
                                   F.concat(c("table"), F.lit("."), c("index"), F.lit(" led by "), c("covered_by")), size=c("bytes"), position=c("bytes"))}, None)


def fk_rows(fks: DataFrame) -> DataFrame:
    return _rows(fks, {"f": _row("fk_unindexed", F.lit(True), F.concat_ws(".", "schema", "table"),
                                 F.concat(c("schema"), F.lit("."), c("table"), F.lit(" "), c("constraint"), F.lit(" ("), human_bytes("child_bytes"), F.lit(")")),
                                 size=c("child_bytes"), position=c("child_bytes"))}, None)


def invalid_index_rows(objects: DataFrame) -> DataFrame:
    state = F.when(~c("live"), "being dropped").when(c("ready"), "maintained on every write, never read").otherwise("left by a failed build")
    return _rows(objects, {"i": _row("index_invalid", (c("kind") == "index") & c("invalid"), c("identity"),
                                     F.concat(c("identity"), F.lit(": "), state, F.lit(" ("), human_bytes("bytes"), F.lit(")")),
                                     size=c("bytes"), f1=c("live") & c("ready"), f2=~c("live"), position=c("bytes"))}, None)


def sequence_rows(usage: DataFrame) -> DataFrame:
    obj = F.concat_ws(".", "schema", "name")
    return _rows(usage, {"s": _row("sequence_exhaustion", c("pct_used") >= SEQ_WARN, obj,
                                   F.concat(obj, _f(": %.0f%% used", c("pct_used") * 100)), measure=c("pct_used"), position=c("pct_used"))}, None)


def narrow_rows(columns: DataFrame) -> DataFrame:
    return _rows(columns, {"n": _row("int4_identity_column", F.lit(True), F.concat_ws(".", "schema", "table"),
                                     F.concat(F.concat_ws(".", "schema", "table", "column"), F.lit(" is "), c("type")), f1=c("type") == "int2")}, None)


def checksum_rows(failures: DataFrame) -> DataFrame:
    name = F.coalesce("database", F.lit("(shared objects)"))
    return _rows(failures, {"c": _row("checksum_failures", c("failures") > 0, F.concat(F.lit("db:"), name),
                                      F.concat(name, _f(": %d failure(s)", c("failures"))), size=c("failures"), position=c("failures"))}, None)


def replica_lag_rows(replicas: DataFrame) -> DataFrame:
    """Rows carry the target's WAL rate: lag on an idle primary says nothing."""
    r = with_default(replicas, "replica_lag_warn_sec", REPLICA_LAG_WARN)
    name = F.when(F.coalesce("app_name", F.lit("")) != "", c("app_name")).otherwise(c("client_addr"))
    return _rows(r, {"l": _row("replica_lag_time", (c("wal_bytes_per_sec") > 0) & (c("replay_lag_sec") >= c("replica_lag_warn_sec")), F.lit(""),
                               F.concat(name, _f(": %.0fs behind", c("replay_lag_sec"))), measure=c("replay_lag_sec"), position=c("replay_lag_sec"))}, None)


# Expressions over one aggregated group: n, n_named, max_measure, min_measure, sum_size, max_size, f1..f3
# (any row has the flag), all_f1, and the context columns joined by ``row_findings``.
_ROW_RULES: dict[str, dict[str, Callable[[], Column]]] = {
    "table_bloat": dict(score=lambda: size_score(F.floor("max_measure")) * F.when(c("f1"), 1.0).otherwise(0.6), conf=lambda: F.lit(0.7),
                        title=lambda: _f("%d table(s) with many dead rows", c("n"))),
    "seq_scan_heavy": dict(score=lambda: F.least(F.lit(90.0), 40 + F.log10(c("max_measure") + 1) * 8), conf=lambda: F.lit(0.6),
                           title=lambda: _f("%d table(s) read mostly by sequential scans", c("n"))),
    "partition_seq_scan_heavy": dict(score=lambda: F.lit(55.0), conf=lambda: F.lit(0.7), title=lambda: _f("%d partitioned table(s) read end to end", c("n"))),
    "autovacuum_disabled_on_table": dict(score=lambda: F.lit(80.0), conf=lambda: F.lit(1.0), title=lambda: _f("autovacuum is switched off on %d table(s)", c("n"))),
    "table_never_vacuumed": dict(score=lambda: F.lit(40.0), conf=lambda: F.lit(0.75), title=lambda: _f("%d table(s) never vacuumed", c("n"))),
    "autovacuum_starved": dict(score=lambda: F.lit(45.0), conf=lambda: F.lit(0.6), title=lambda: _f("%d table(s) past the vacuum trigger without autovacuum", c("n"))),
    "stale_statistics": dict(score=lambda: F.lit(45.0), conf=lambda: F.lit(0.7), title=lambda: _f("%d table(s) with outdated planner statistics", c("n"))),
    "never_analyzed": dict(score=lambda: F.lit(50.0), conf=lambda: F.lit(0.8), title=lambda: _f("%d table(s) never analyzed", c("n"))),
    "low_hot_update_ratio": dict(score=lambda: F.lit(40.0), conf=lambda: F.lit(0.7),
                                 title=lambda: _f("%d table(s) with few in-place updates (worst %.0f%%)", c("n"), c("min_measure") * 100)),
    "unused_indexes": dict(score=lambda: c("max_measure"),
                           conf=lambda: F.when((c("window_age_seconds") > 0) & (c("window_age_seconds") < SHORT_STATS_SECONDS), 0.4).otherwise(0.8),
                           title=lambda: F.concat(_f("%d unused index(es), ", c("n")), human_bytes("sum_size"))),
    "redundant_indexes": dict(score=lambda: size_score("sum_size"), conf=lambda: F.lit(0.75),
                              title=lambda: F.concat(_f("%d redundant index(es), ", c("n")), human_bytes("sum_size"))),
    "fk_unindexed": dict(score=lambda: size_score("max_size"), conf=lambda: F.lit(0.85), title=lambda: _f("%d foreign key(s) without an index", c("n"))),
    "index_invalid": dict(score=lambda: F.when(c("f1"), 85.0).otherwise(45.0), conf=lambda: F.when(F.coalesce("build_running", F.lit(False)), 0.5).otherwise(1.0),
                          severity=lambda: F.when(c("f1") & ~F.coalesce("build_running", F.lit(False)), "critical").otherwise("warn"),
                          title=lambda: _f("%d invalid index(es)", c("n"))),
    "sequence_exhaustion": dict(score=lambda: c("max_measure") * 100, conf=lambda: F.lit(0.9),
                                severity=lambda: F.when(c("max_measure") >= SEQ_CRIT, "critical").otherwise("warn"),
                                title=lambda: _f("%d sequence(s) near their ceiling (worst %.0f%%)", c("n"), c("max_measure") * 100)),
    "int4_identity_column": dict(score=lambda: F.lit(55.0), conf=lambda: F.lit(0.95), severity=lambda: F.when(c("f1"), "critical").otherwise("warn"),
                                 title=lambda: _f("%d sequence-fed column(s) with a narrow type", c("n"))),
    "checksum_failures": dict(score=lambda: F.lit(96.0), conf=lambda: F.lit(1.0), title=lambda: _f("%d checksum failure(s)", c("sum_size"))),
    "replica_lag_time": dict(score=lambda: F.least(F.lit(90.0), 40 + c("max_measure") / 10), conf=lambda: F.lit(0.85),
                             severity=lambda: F.when(c("max_measure") >= REPLICA_LAG_CRIT, "critical").otherwise("warn"),
                             title=lambda: _f("Replica %.0fs behind", c("max_measure"))),
}

def _case(key: Column, branches: dict[str, Column], default: Column) -> Column:
    out = None
    for k, v in branches.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def row_findings(rows: DataFrame, context: DataFrame | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """Aggregate evidence rows to findings. All aggregates are partial and fixed-width.

    Context facts come along in the rows (they are the same for a whole snapshot) or from
    ``context``, one row per snapshot.
    """
    carried = [n for n in CONTEXT if n in rows.columns]
    g = rows.groupBy(*SNAP, "id", *carried).agg(
        F.count("*").alias("n"), F.count_if(F.col("object") != "").alias("n_named"), F.max("measure").alias("max_measure"),
        F.min("measure").alias("min_measure"), F.sum("size").alias("sum_size"), F.max("size").alias("max_size"),
        *[F.max(f).alias(f) for f in ("f1", "f2", "f3")])
    extra = [n for n in CONTEXT if context is not None and n in context.columns and n not in carried]
    if extra:
        g = g.join(context.select(*SNAP, *extra), SNAP, "left")
    for name, kind in CONTEXT.items():
        if name not in extra and name not in carried:
            g = g.withColumn(name, F.lit(None).cast(kind))
    rules = {i: r for i, r in _ROW_RULES.items() if only is None or i in set(only)}
    key = F.col("id")
    severity = _case(key, {i: (r["severity"]() if "severity" in r else F.lit(_BASE_SEVERITY[i])) for i, r in rules.items()}, F.lit("info"))
    score = _case(key, {i: r["score"]().cast("double") for i, r in rules.items()}, F.lit(0.0))
    conf = _case(key, {i: r["conf"]().cast("double") for i, r in rules.items()}, F.lit(0.0))
    title = _case(key, {i: r["title"]() for i, r in rules.items()}, F.lit(""))
    dim = _case(key, {i: F.lit(DIMENSION[i]) for i in rules}, F.lit(""))

    def note(when: Column, text: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(text))

    is_unused = key == "unused_indexes"
    caveats = F.array_compact(F.array(
        note(is_unused & (c("window_age_seconds") > 0) & (c("window_age_seconds") < SHORT_STATS_SECONDS), "statistics cover less than a week"),
        note(key.isin("unused_indexes", "redundant_indexes") & c("replication_in_use"), "scan counts are per node; a replica may use the index"),
        note(is_unused & c("f2"), "partial indexes may serve a narrow but critical path"),
        note(is_unused & c("f3"), "expression indexes may serve one query shape"),
        note(is_unused & c("f1"), "some tables are written often; check scheduled jobs outside the window"),
        note((key == "index_invalid") & c("build_running"), "an index build is running; an index still building is invalid too"),
        note((key == "table_bloat") & c("horizon_pinned"), "the vacuum horizon is pinned; release its holder first"),
        note((key == "stale_statistics") & c("slowdown_present"), "a statement slowed down too; whether it reads these tables is unknown"),
        note((key == "seq_scan_heavy") & c("hypopg"), "hypothetical indexes are available to test candidates"),
        note(key == "checksum_failures", "do not rewrite or reindex the relation; keep the evidence"))).cast("array<string>")
    return g.select(*SNAP, "id", F.lit("").alias("object"), severity.alias("severity"), dim.alias("dimension"),
                    clamp(score, 0, 100).alias("score"), conf.alias("confidence"), title.alias("title"),
                    c("n_named").alias("n_objects"), caveats.alias("caveats"))


# --- findings with an object of their own -------------------------------------


def _own(df: DataFrame, id_: str, obj: Column, severity: Column, score: Column, confidence: Column | float, title: Column,
         dimension: str | None = None) -> DataFrame:
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return df.select(*SNAP, F.lit(id_).alias("id"), obj.alias("object"), severity.alias("severity"),
                     F.lit(dimension or DIMENSION[id_]).alias("dimension"), clamp(score, 0, 100).alias("score"),
                     conf.cast("double").alias("confidence"), title.alias("title"), F.lit(0).cast("long").alias("n_objects"),
                     F.array().cast("array<string>").alias("caveats"))


def slot_findings(slots: DataFrame) -> DataFrame:
    lost = F.coalesce(c("wal_status") == "lost", F.lit(False))
    big = c("retained_bytes") >= SLOT_CRIT
    hit = slots.where(lost | (~c("active") & (c("retained_bytes") >= SLOT_WARN)))
    return _own(hit, "replication_slot_inactive", F.concat(F.lit("slot:"), c("name")),
                F.when(lost | big, "critical").otherwise("warn"), F.when(lost, 92.0).when(big, 85.0).otherwise(55.0), 0.9,
                F.concat(F.lit("Inactive slot "), c("name"), F.lit(" holds "), human_bytes("retained_bytes")))


def subscription_findings(subs: DataFrame) -> DataFrame:
    return _own(subs.where(~c("worker_running")), "subscription_worker_down", F.concat(F.lit("sub:"), c("name")), F.lit("warn"),
                F.lit(60.0), 0.75, F.concat(F.lit("Subscription "), c("name"), F.lit(" has no apply worker")))


def prepared_findings(holders: DataFrame) -> DataFrame:
    old = c("age_s") >= 3600
    hit = holders.where((c("source") == "prepared_xact") & (c("age_s") >= 300))
    return _own(hit, "prepared_xact_abandoned", F.lit(""), F.when(old, "critical").otherwise("warn"),
                F.when(old, 78.0).otherwise(55.0), 0.9,
                F.concat(F.lit("Prepared transaction "), c("holder"), _f(" open for %.0fs", c("age_s").cast("double"))))


def horizon_findings(holders: DataFrame) -> DataFrame:
    """One finding per snapshot, about the oldest holder."""
    top = holders.groupBy(*SNAP).agg(F.max("xmin_age").alias("xmin_age"),
                                     F.max_by(F.concat_ws(" ", "source", "holder"), F.struct("xmin_age", "holder")).alias("who"))
    grave = c("xmin_age") >= XID_WARN
    hit = top.where(c("xmin_age") >= HORIZON_WARN)
    out = _own(hit, "vacuum_horizon_blocked", F.lit(""), F.when(grave, "critical").otherwise("warn"),
               F.when(grave, c("xmin_age").cast("double") / XID_WALL * 100).otherwise(F.lit(45.0)), 0.9,
               F.concat(F.lit("Vacuum horizon held by "), c("who"), F.lit(", "), human_count("xmin_age"), F.lit(" transactions back")))
    return out.withColumn("dimension", F.when(c("severity") == "critical", "risk").otherwise("storage"))


def lock_contention_findings(by_query: DataFrame) -> DataFrame:
    """Statements that mostly wait for locks; windows with few samples are left out."""
    hit = by_query.where((c("total") >= WAIT_MIN_SAMPLES) & (c("samples") >= 5) & (c("lock_share") > 0.30))
    return _own(hit.withColumn("snapshot_id", c("window_id")), "wait_lock_contention", F.lit(""), F.lit("warn"),
                F.least(F.lit(95.0), c("lock_share") * 100 * c("share") + 40),
                F.least(F.lit(0.9), F.lit(0.4) + c("total").cast("double") / 400),
                F.concat(F.lit("Query "), query_tag("query_id"), _f(" spends %.0f%% of its time waiting for locks", c("lock_share") * 100)))


# --- putting rules together ---------------------------------------------------


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*HEADER) for p in parts])


def dead_ratio(tables: DataFrame) -> DataFrame:
    return tables.withColumn("dead_ratio", F.coalesce(round_dp(ratio("dead_tuples", c("live_tuples") + c("dead_tuples")), 4), F.lit(0.0)))


def write_heavy(tables: DataFrame) -> DataFrame:
    return tables.where(c("mods_since_analyze") > WRITE_HEAVY_MODS).select(*SNAP, "schema", "table")


def pivot_settings(params: DataFrame, names: Iterable[str]) -> DataFrame:
    """Long settings to one row per target with ``p_<name>`` columns, by one conditional aggregate.

    Settings that carry a snapshot give one row per snapshot, so a switch that was turned off is seen off only then.
    """
    names, keys = list(names), setting_keys(params)
    # The largest of texts is found by sorting: rows are dealt out by key first, so that no task sorts a whole split of them.
    return (params.where(c("name").isin(*names)).repartition(*keys).groupBy(*keys)
            .agg(*[F.max(F.when(c("name") == n, c("value"))).alias("p_" + n) for n in names]))


def setting_keys(params: DataFrame) -> list[str]:
    return ["target_id", *[k for k in ("snapshot_id",) if k in params.columns]]


def setting_names() -> list[str]:
    return sorted({n[2:] for r in FACT_RULES for n in r.needs if n.startswith("p_")})
