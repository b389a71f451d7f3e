"""Session tables to per-snapshot activity facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import round_dp
from vitalgrid.operators.series import top_k

SNAP = ["target_id", "snapshot_id"]


def activity_breakdown(activity: DataFrame) -> DataFrame:
    """Sessions per state and wait type, with the longest ages."""
    return activity.groupBy(*SNAP, F.coalesce("state", F.lit("")).alias("state"),
                            F.coalesce("wait_event_type", F.lit("")).alias("wait_event_type")).agg(
        F.count("*").alias("n"), F.max("xact_age_s").alias("max_xact_age_s"),
        F.max(F.when(F.col("state") == "active", F.col("query_age_s"))).alias("max_active_age_s"),
        F.count_if(F.col("backend_type") == "autovacuum worker").alias("autovacuum_workers"),
        F.max(F.when(F.col("backend_type") == "autovacuum worker", F.col("xact_age_s"))).alias("autovacuum_max_age_s"))


def activity_rollup(activity: DataFrame) -> DataFrame:
    """One row per snapshot. Both steps aggregate partially, so a hot target stays spread out."""
    idle_txn = F.col("state").isin("idle in transaction", "idle in transaction (aborted)")
    blocked = (F.col("wait_event_type") != "") & (F.col("wait_event_type") != "Client")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return activity_breakdown(activity).groupBy(*SNAP).agg(
        F.sum("n").alias("total"), total(F.col("state") == "active").alias("active"),
        total(F.col("state") == "idle").alias("idle"), total(idle_txn).alias("idle_in_transaction"),
        total(blocked).alias("waiting"),
        round_dp(F.coalesce(F.max("max_xact_age_s"), F.lit(0)).cast("double"), 2).alias("longest_xact_s"),
        round_dp(F.coalesce(F.max("max_active_age_s"), F.lit(0)).cast("double"), 2).alias("longest_active_s"),
        F.sum("autovacuum_workers").alias("autovacuum_workers"),
        round_dp(F.coalesce(F.max("autovacuum_max_age_s"), F.lit(0)).cast("double"), 2).alias("autovacuum_max_age_s"))


def state_maps(activity: DataFrame) -> DataFrame:
    """Sessions by state and by wait type as maps, for documents; the key sets are small and fixed."""
    b = activity_breakdown(activity)

    def as_map(key: str, name: str) -> DataFrame:
        per = b.where(F.col(key) != "").groupBy(*SNAP, key).agg(F.sum("n").alias("n"))
        return per.groupBy(*SNAP).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    return as_map("state", "by_state").join(as_map("wait_event_type", "wait_events"), SNAP, "full_outer")


def connection_groups(activity: DataFrame, k: int = 10) -> DataFrame:
    """Largest (application, user, state) groups per snapshot."""
    def named(c: str, default: str):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)

    g = activity.groupBy(*SNAP, named("app_name", "(none)"), named("username", "(none)"),
                         named("state", "unknown")).agg(F.count("*").alias("n"))
    return top_k(g, SNAP, [F.col("n").desc(), F.col("app_name"), F.col("username"), F.col("state")], k)


def blocked_sessions(lock_waits: DataFrame) -> DataFrame:
    return lock_waits.groupBy(*SNAP).agg(F.count("*").alias("blocked"), F.max("wait_s").alias("max_wait_s"))


def client_connections(activity: DataFrame) -> DataFrame:
    """What the connection limit counts: client backends only."""
    return activity.groupBy(*SNAP).agg(F.count_if(F.col("backend_type") == "client backend").alias("connections_used"))


def cluster_limits(databases: DataFrame) -> DataFrame:
    """Oldest transaction and multixact ages over the databases of a cluster's run; of a database collected twice the later row counts."""
    last = databases.groupBy("cluster_id", "run", "database").agg(
        *[F.max_by(n, "collected_at").alias(n) for n in ("max_xid_age", "max_mxid_age", "connections_used")])
    return last.groupBy("cluster_id", "run").agg(F.max("max_xid_age").alias("max_xid_age"),
                                               F.max("max_mxid_age").alias("max_mxid_age"),
                                               F.sum("connections_used").alias("connections_used"),
                                               F.count("*").alias("databases"))
