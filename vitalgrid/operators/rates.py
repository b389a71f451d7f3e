"""Counter pairs to rates, with reset detection, for all targets and snapshots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import ratio, round_dp
from vitalgrid.functions.text import clock_duration
from vitalgrid.operators.series import DAY, carried, counter_delta, counter_ratio, per_second, previous_row

KEYS = ["target_id"]

HEALTH_COUNTERS = ["xact_commit", "xact_rollback", "blks_hit", "blks_read", "temp_bytes", "deadlocks",
                   "tup_returned", "tup_written"]


def _net_commits() -> Column:
    """Commits of sample B without the collector's own, unless that would look like a reset."""
    net = F.col("xact_commit") - F.col("own_txns")
    return F.when(net >= F.col("prev_xact_commit"), net).otherwise(F.col("xact_commit"))


def health_rates(counters: DataFrame, *, chunk_seconds: int = DAY) -> DataFrame:
    """Rates between each snapshot and the target's previous one.

    A counter that went backwards gives NULL rates, never zero; only the transaction
    counters decide the section label.
    """
    df = counters if "own_txns" in counters.columns else counters.withColumn("own_txns", F.lit(0).cast("long"))
    p = previous_row(df, KEYS, "collected_at", ["collected_at", *HEALTH_COUNTERS], chunk_seconds=chunk_seconds)
    dt = F.col("collected_at") - F.col("prev_collected_at")
    p = p.withColumn("sample_seconds", dt).withColumn("commits_b", _net_commits())
    tps = per_second(F.col("prev_xact_commit") + F.col("prev_xact_rollback"),
                     F.col("commits_b") + F.col("xact_rollback"), dt)
    commits = per_second("prev_xact_commit", "commits_b", dt)
    rollbacks = per_second("prev_xact_rollback", "xact_rollback", dt)
    rollback_ratio = counter_ratio(F.col("prev_xact_rollback"), F.col("xact_rollback"),
                                   F.col("prev_xact_commit"), F.col("commits_b"))
    hit = counter_ratio("prev_blks_hit", "blks_hit", "prev_blks_read", "blks_read")
    blocks = (F.col("blks_hit") + F.col("blks_read")) - (F.col("prev_blks_hit") + F.col("prev_blks_read"))
    first = F.col("prev_collected_at").isNull()
    reset = tps.isNull() | commits.isNull() | rollbacks.isNull()
    return p.select(
        "target_id", "snapshot_id", "collected_at", F.col("numbackends").alias("connections"), "sample_seconds",
        tps.alias("tps"), commits.alias("commits_per_sec"), rollbacks.alias("rollbacks_per_sec"),
        round_dp(rollback_ratio, 4).alias("rollback_ratio"), round_dp(hit, 4).alias("cache_hit_ratio"),
        F.when(hit.isNotNull(), blocks).alias("cache_blocks"),
        round_dp(per_second("prev_deadlocks", "deadlocks", dt) * 60, 2).alias("deadlocks_per_min"),
        round_dp(per_second("prev_temp_bytes", "temp_bytes", dt), 2).alias("temp_bytes_per_sec"),
        round_dp(per_second("prev_tup_returned", "tup_returned", dt), 2).alias("tup_returned_per_sec"),
        round_dp(per_second("prev_tup_written", "tup_written", dt), 2).alias("tup_written_per_sec"),
        F.when(first, "unavailable").when(reset, "reset_during_sample").otherwise("sampled").alias("exactness"),
        "stats_reset_at", "postmaster_start_at")


def wal_rates(wal: DataFrame, *, chunk_seconds: int = DAY) -> DataFrame:
    p = previous_row(wal, KEYS, "collected_at", ["collected_at", "wal_bytes", "wal_records"], chunk_seconds=chunk_seconds)
    dt = F.col("collected_at") - F.col("prev_collected_at")
    rate = per_second("prev_wal_bytes", "wal_bytes", dt)
    passthrough = [c for c in ("buffers_full", "wal_dir_bytes", "wal_dir_files") if c in wal.columns]
    return p.select("target_id", "snapshot_id", round_dp(rate, 2).alias("wal_bytes_per_sec"),
                    round_dp(per_second("prev_wal_records", "wal_records", dt), 2).alias("wal_records_per_sec"),
                    F.when(F.col("prev_collected_at").isNull(), "unavailable").when(rate.isNull(), "reset_during_sample")
                    .otherwise("sampled").alias("exactness"), *passthrough)


def io_rates(io: DataFrame, *, chunk_seconds: int = DAY) -> DataFrame:
    p = previous_row(io, KEYS, "collected_at", ["collected_at", "buffers_written"], chunk_seconds=chunk_seconds)
    dt = F.col("collected_at") - F.col("prev_collected_at")
    return p.select("target_id", "snapshot_id", "checkpoints_timed", "checkpoints_req",
                    round_dp(per_second("prev_buffers_written", "buffers_written", dt), 2).alias("buffers_written_per_sec"))


def wal_dir_size(segments: DataFrame) -> DataFrame:
    """Count and total size of a WAL segment listing, per snapshot."""
    return segments.groupBy("target_id", "snapshot_id").agg(
        F.count("*").alias("wal_dir_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("wal_dir_bytes"))


def window_columns() -> dict[str, Column]:
    """Age of the cumulative counters, and their span in days when a reset time is known."""
    age = F.col("collected_at") - F.coalesce("stats_reset_at", "postmaster_start_at")
    days = round_dp((F.col("collected_at") - F.col("stats_reset_at")).cast("double") / 3600 / 24, 2)
    return {"window_age_seconds": age, "stats_window_days": days}


def stats_window(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("target_id", "snapshot_id", "collected_at",
                            *[c.alias(n) for n, c in window_columns().items()])


def reset_reason(prev_reset: Column, cur_reset: Column, prev_start: Column, cur_start: Column) -> Column:
    """'stats_reset', 'server_restart' or NULL between two snapshots."""
    moved = cur_reset.isNotNull() & (prev_reset.isNull() | (cur_reset > prev_reset))
    return F.when(moved, "stats_reset").when(cur_start > prev_start, "server_restart")


def counter_resets(snapshots: DataFrame, *, chunk_seconds: int = DAY) -> DataFrame:
    """Snapshots whose counters cannot be compared with the previous ones, and why."""
    p = previous_row(snapshots, KEYS, "collected_at", ["snapshot_id", "stats_reset_at", "postmaster_start_at"],
                     chunk_seconds=chunk_seconds)
    reason = reset_reason(F.col("prev_stats_reset_at"), F.col("stats_reset_at"),
                          F.col("prev_postmaster_start_at"), F.col("postmaster_start_at"))
    p = p.where(F.col("prev_snapshot_id").isNotNull()).withColumn("reason", reason).where(F.col("reason").isNotNull())
    age = F.col("collected_at") - F.when(F.col("reason") == "stats_reset", F.col("stats_reset_at")).otherwise(
        F.col("postmaster_start_at"))
    return p.select("target_id", "snapshot_id", "collected_at", "prev_snapshot_id", "reason",
                    age.alias("age_seconds"), clock_duration(age).alias("age_text"))


def reset_epochs(snapshots: DataFrame, *, keys: list[str] | None = None, chunk_seconds: int = DAY) -> DataFrame:
    """Every snapshot with the number of resets so far, and reason and moment of the last one.

    ``keys`` names what counters belong to: a target, or a target and its database. Two snapshots can be compared only within
    one epoch, however many snapshots lie between them. Neither counts nor moments depend on the chunk length.
    """
    keys = keys or KEYS
    p = previous_row(snapshots, keys, "collected_at", ["snapshot_id", "stats_reset_at", "postmaster_start_at"], chunk_seconds=chunk_seconds)
    reason = F.when(F.col("prev_snapshot_id").isNotNull(), reset_reason(
        F.col("prev_stats_reset_at"), F.col("stats_reset_at"), F.col("prev_postmaster_start_at"), F.col("postmaster_start_at")))
    p = p.select(*keys, "snapshot_id", "collected_at", reason.alias("_reason"), "stats_reset_at", "postmaster_start_at")
    hit = F.col("_reason").isNotNull()
    out = carried(p, keys, "collected_at", totals={"epoch": hit.cast("long")}, lasts={"reason": F.col("_reason")}, chunk_seconds=chunk_seconds)
    moment = F.greatest("stats_reset_at", "postmaster_start_at")
    return out.select(*keys, "snapshot_id", "collected_at", "epoch", "reason", moment.alias("counting_since"),
                      F.when(moment == F.col("stats_reset_at"), "stats_reset").otherwise("server_restart").alias("since_reason"))


def interval_mean(statements: DataFrame, *, chunk_seconds: int = 370 * DAY) -> DataFrame:
    """Mean milliseconds per call within each interval, from the cumulative totals."""
    p = previous_row(statements, ["target_id", "queryid"], "collected_at", ["calls", "total_us"],
                     chunk_seconds=chunk_seconds)
    calls, total = counter_delta("prev_calls", "calls"), counter_delta("prev_total_us", "total_us")
    return p.where(F.col("prev_calls").isNotNull()).select(
        "target_id", "snapshot_id", "queryid", calls.alias("interval_calls"),
        round_dp(ratio(total, calls * 1000), 4).alias("interval_mean_ms"))
