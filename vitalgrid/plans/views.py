"""Focused views: statements, tables, vacuum, unused indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions import guc
from vitalgrid.functions.numbers import ratio, round_dp
from vitalgrid.functions.text import scrub_statement, workload_statement
from vitalgrid.operators.series import top_k

SNAP = ["target_id", "snapshot_id"]


def view_queries(statements: DataFrame, *, k: int = 20, by: str = "total") -> DataFrame:
    """Top statements per snapshot by total time, shares of the time of all statements.

    ``by='calls'`` re-ranks the same statements by calls.
    """
    s = statements.where(F.col("queryid").isNotNull() & (F.col("calls") > 0) & workload_statement("query"))
    everything = s.groupBy(*SNAP).agg(F.sum("total_us").alias("all_us"))
    top = top_k(s, SNAP, [F.col("total_us").desc(), F.col("queryid")], k).join(everything, SNAP)
    if by == "calls":
        top = top_k(top.drop("rank"), SNAP, [F.col("calls").desc(), F.col("queryid")], k)
    return top.select(
        *SNAP, "queryid", "rank", "calls", "total_us", round_dp(ratio("total_us", "all_us"), 4).alias("share"),
        round_dp(ratio(F.col("total_us") / 1000.0, "calls"), 4).alias("mean_ms"),
        round_dp(F.coalesce(ratio("blks_hit", F.col("blks_hit") + F.col("blks_read")), F.lit(0.0)), 4).alias("cache_hit"),
        scrub_statement("query").alias("query"))


def view_tables(tables: DataFrame, *, k: int = 30) -> DataFrame:
    """Largest tables with their dead share and scan counts; ``tables`` carries dead_ratio."""
    t = top_k(tables, SNAP, [F.col("total_bytes").desc(), F.col("schema"), F.col("table")], k)
    return t.select(*SNAP, "schema", "table", "rank", "total_bytes", "live_tuples", "dead_ratio", "seq_scans", "index_scans")


def vacuum_due(tables: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Is each table past its autovacuum trigger? Options of the table win over the cluster's settings.

    ``settings``: (target_id, vacuum_threshold, vacuum_scale).
    """
    t = tables
    if settings is not None:
        t = t.join(settings, "target_id", "left")
    for name, default in (("vacuum_threshold", 50.0), ("vacuum_scale", 0.2)):
        t = t.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in t.columns else F.lit(default))
    trigger = F.coalesce("rel_vacuum_threshold", "vacuum_threshold") + F.coalesce("rel_vacuum_scale", "vacuum_scale") * F.col("live_tuples").cast("double")
    due = ~guc.switched_off("rel_autovacuum_enabled") & (F.col("dead_tuples").cast("double") > trigger)
    return t.withColumn("due", due)


def view_vacuum(tables: DataFrame, settings: DataFrame | None = None, *, k: int = 30) -> DataFrame:
    """The largest tables ranked by dead rows, with the due flag."""
    t = top_k(vacuum_due(tables, settings), SNAP, [F.col("total_bytes").desc(), F.col("schema"), F.col("table")], k, "_size_rank")
    t = top_k(t, SNAP, [F.col("dead_tuples").desc(), F.col("_size_rank")], k)
    return t.select(*SNAP, "schema", "table", "rank", "live_tuples", "dead_tuples", "dead_ratio", "last_autovacuum", "due")


def vacuum_behind(tables: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    return vacuum_due(tables, settings).groupBy(*SNAP).agg(F.count_if("due").alias("behind"), F.count("*").alias("tables"))


def view_unused_indexes(unused: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` largest unused indexes with their rank, and totals over all of each snapshot."""
    total = unused.groupBy(*SNAP).agg(F.sum("bytes").alias("reclaimable_bytes"), F.count("*").alias("unused"))
    listed = top_k(unused, SNAP, [F.col("bytes").desc(), F.col("indexrelid")], k)
    return listed.select(*SNAP, "schema", "table", "index", "bytes", "rank").join(total, SNAP)


def view_diff(honesty: DataFrame, deltas: DataFrame) -> DataFrame:
    """Changes of each target's newest snapshot with what limits the comparison.

    ``honesty`` is ``baseline.diff_since``; nothing is listed across a counter reset.
    """
    j = honesty.join(deltas, SNAP, "left")
    shown = F.col("reset_reason").isNull()
    return j.groupBy(*SNAP, "base_snapshot_id", "requested_seconds", "actual_seconds", "stretched", "reset_reason", "statements_evicted").agg(
        F.count(F.when(shown, F.col("id"))).alias("changes"), F.count_if(shown & (F.col("severity") == "warn")).alias("warnings"))


def view_changes(honesty: DataFrame, deltas: DataFrame) -> DataFrame:
    """The changes that ``view_diff`` counts, one row each: what was, what is, and between which snapshots. None across a reset."""
    kept = honesty.where(F.col("reset_reason").isNull()).select(*SNAP, "base_snapshot_id", "actual_seconds", "stretched", "statements_evicted")
    return kept.join(deltas, SNAP).select(*SNAP, "base_snapshot_id", "actual_seconds", "stretched", "statements_evicted", "id", "subject", "severity", "before", "after", "pct_change")
