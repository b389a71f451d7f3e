"""Run-over-run changes, gated so that only material ones are reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import pct_change, round_dp
from vitalgrid.operators.baseline import BASELINE_MIN_AGE, baseline_choice
from vitalgrid.operators.rates import reset_epochs
from vitalgrid.operators.series import DAY, asof, previous_row
from vitalgrid.session import cut_lineage

# How large a change must be to count.
QUERY_MEAN_PCT, QUERY_MEAN_ABS_MS = 0.50, 5.0
SEQ_SCAN_FACTOR, SEQ_SCAN_ABS = 2.0, 1000
DB_GROWTH_PCT, DB_GROWTH_ABS = 0.10, 100 * 1024 * 1024
CONN_STEP_PCT, CONN_STEP_ABS = 0.50, 20
DEAD_RATIO_STEP = 0.10
RECEIVER_LAG_STEP = 30


def _out(df: DataFrame, id_: str, subject: Column, severity: Column | str, before: Column, after: Column,
         pct: Column | None = None, observed: Column | None = None) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        "target_id", "snapshot_id", F.lit(id_).alias("id"), subject.cast("string").alias("subject"), sev.alias("severity"),
        before.cast("double").alias("before"), after.cast("double").alias("after"),
        (pct if pct is not None else F.lit(None).cast("double")).alias("pct_change"),
        (observed if observed is not None else F.col("base_at")).cast("long").alias("first_observed"))


def query_deltas(statements: DataFrame, baseline: DataFrame) -> DataFrame:
    """New statements and mean-time changes against the chosen baseline snapshot.

    ``baseline`` maps (target, snapshot) to (base_snapshot_id, base_at).
    """
    now = statements.join(baseline, ["target_id", "snapshot_id"])
    base = statements.select("target_id", F.col("snapshot_id").alias("base_snapshot_id"), "queryid",
                             F.col("total_us").alias("b_us"), F.col("calls").alias("b_calls"))
    j = now.join(base, ["target_id", "base_snapshot_id", "queryid"], "left")
    mean = F.try_divide(F.col("total_us") / 1000.0, F.col("calls").cast("double"))
    b_mean = F.try_divide(F.col("b_us") / 1000.0, F.col("b_calls").cast("double"))
    subject = F.concat(F.lit("queryid "), F.col("queryid").cast("string"))
    new = _out(j.where(F.col("b_calls").isNull()), "query.new", subject, "info", F.lit(0.0),
               round_dp(F.col("total_us") / 1000.0, 1), observed=F.col("collected_at"))
    change = mean - b_mean
    hit = (b_mean > 0) & (F.abs(change) >= QUERY_MEAN_ABS_MS) & (F.abs(change / b_mean) >= QUERY_MEAN_PCT)
    moved = _out(j.where(F.col("b_calls").isNotNull()).where(hit), "query.mean_ms", subject,
                 F.when(change > 0, "warn").otherwise("info"), round_dp(b_mean, 4), round_dp(mean, 4),
                 round_dp(change / b_mean, 4))
    return new.unionByName(moved)


def table_deltas(tables: DataFrame, baseline: DataFrame) -> DataFrame:
    now = tables.join(baseline, ["target_id", "snapshot_id"])
    base = tables.select("target_id", F.col("snapshot_id").alias("base_snapshot_id"), "schema", "table",
                         F.col("seq_scans").alias("b_seq"), F.col("dead_ratio").alias("b_dead"))
    j = now.join(base, ["target_id", "base_snapshot_id", "schema", "table"])
    subject = F.concat_ws(".", "schema", "table")
    grew = F.col("seq_scans") - F.col("b_seq")
    seq = _out(j.where((F.col("seq_scans") > F.col("b_seq") * SEQ_SCAN_FACTOR) & (grew >= SEQ_SCAN_ABS)), "table.seq_scans",
               subject, "warn", F.col("b_seq"), F.col("seq_scans"), pct_change("b_seq", "seq_scans"))
    dead = _out(j.where(F.col("dead_ratio") - F.col("b_dead") >= DEAD_RATIO_STEP), "table.dead_ratio", subject, "warn",
                round_dp("b_dead", 4), round_dp("dead_ratio", 4))
    return seq.unionByName(dead)


def size_deltas(sizes: DataFrame) -> DataFrame:
    """Rows carry database, db_size_bytes and base_db_size_bytes."""
    b, a = F.col("base_db_size_bytes"), F.col("db_size_bytes")
    grew = a - b
    hit = (b > 0) & (grew >= DB_GROWTH_ABS) & (F.try_divide(grew.cast("double"), b.cast("double")) >= DB_GROWTH_PCT)
    return _out(sizes.where(hit), "database.size_bytes", F.col("database"), "info", b, a, pct_change(b, a))


def connection_deltas(health: DataFrame) -> DataFrame:
    """Rows carry database, connections and base_connections."""
    b, a = F.col("base_connections"), F.col("connections")
    step = a - b
    hit = (b > 0) & (F.abs(step) >= CONN_STEP_ABS) & (F.try_divide(F.abs(step).cast("double"), b.cast("double")) >= CONN_STEP_PCT)
    return _out(health.where(hit), "health.connections", F.col("database"), F.when(step > 0, "warn").otherwise("info"),
                b, a, pct_change(b, a))


def receiver_lag_deltas(lags: DataFrame) -> DataFrame:
    b, a = F.col("base_receiver_lag_sec"), F.col("receiver_lag_sec")
    return _out(lags.where(a - b >= RECEIVER_LAG_STEP), "replication.receiver_lag_sec", F.col("database"), "warn",
                round_dp(b, 2), round_dp(a, 2))


def archiver_deltas(archiver: DataFrame) -> DataFrame:
    b, a = F.col("base_failed_count"), F.col("failed_count")
    return _out(archiver.where(a - b > 0), "archiver.failed_count", F.lit("archiver"), "warn", b, a)


def standby_key() -> Column:
    return F.when(F.coalesce("app_name", F.lit("")) != "", F.col("app_name")).otherwise(F.col("client_addr"))


def standby_gone(replicas: DataFrame, baseline: DataFrame) -> DataFrame:
    """Standbys of the baseline that the snapshot no longer lists. Both sides were collected."""
    base = (replicas.select("target_id", F.col("snapshot_id").alias("base_snapshot_id"), standby_key().alias("standby"))
            .where(F.coalesce("standby", F.lit("")) != "").join(baseline, ["target_id", "base_snapshot_id"]))
    now = replicas.select("target_id", "snapshot_id", standby_key().alias("standby"))
    gone = base.join(now, ["target_id", "snapshot_id", "standby"], "left_anti")
    return _out(gone, "replication.standby_gone", F.col("standby"), "warn", F.lit(1), F.lit(0))


def snapshot_baselines(snapshots: DataFrame, *, chunk_seconds: int = DAY) -> DataFrame:
    """(target, snapshot) with the previous snapshot's id and time; snapshots without one are left out."""
    heads = snapshots.groupBy("target_id", "snapshot_id").agg(F.max("collected_at").alias("collected_at"))
    p = previous_row(heads, ["target_id"], "collected_at", ["snapshot_id", "collected_at"], chunk_seconds=chunk_seconds)
    return p.where(F.col("prev_snapshot_id").isNotNull()).select(
        "target_id", "snapshot_id", F.col("prev_snapshot_id").alias("base_snapshot_id"), F.col("prev_collected_at").alias("base_at"))


def heads_of(*tables: DataFrame) -> DataFrame:
    """(target, snapshot, collected_at) of all snapshots that any of the tables knows."""
    known = reduce(DataFrame.unionByName, [t.select("target_id", "snapshot_id", "collected_at") for t in tables])
    return known.groupBy("target_id", "snapshot_id").agg(F.max("collected_at").alias("collected_at"))


def _chosen(snapshots: DataFrame, min_age: int, chunk_seconds: int) -> DataFrame:
    b = baseline_choice(heads_of(snapshots), ["snapshot_id", "collected_at"], min_age=min_age, chunk_seconds=chunk_seconds)
    return b.where(F.col("base_snapshot_id").isNotNull()).select(
        "target_id", "snapshot_id", "collected_at", "base_snapshot_id", F.col("base_collected_at").alias("base_at"))


def delta_baselines(snapshots: DataFrame, *, min_age: int = BASELINE_MIN_AGE, chunk_seconds: int = DAY) -> DataFrame:
    """(target, snapshot) with the baseline to compare against: one at least a quarter of an hour
    old, so that two runs in a row do not compare noise, else the previous run."""
    return _chosen(snapshots, min_age, chunk_seconds).drop("collected_at")


def split_baselines(snapshots: DataFrame, counters: DataFrame, *, min_age: int = BASELINE_MIN_AGE, chunk_seconds: int = DAY) -> tuple[DataFrame, DataFrame]:
    """(baselines, suppressed): baselines of the same counting epoch, and the others with the reason.

    Both ends of a comparison look up the newest counters at or before them, so a reset anywhere between them counts, also one
    that neither end's own neighbours show. A snapshot without counters before it is compared.
    """
    epochs = cut_lineage(reset_epochs(counters, chunk_seconds=chunk_seconds), "epochs")  # one small row per snapshot, read by both look-ups
    both = asof(_chosen(snapshots, min_age, chunk_seconds), epochs, ["target_id"], F.col("collected_at"), "collected_at", ["epoch", "reason", "counting_since", "since_reason"],
                prefix="head_", chunk_seconds=chunk_seconds)
    both = asof(both, epochs, ["target_id"], F.col("base_at"), "collected_at", ["epoch"], prefix="first_", chunk_seconds=chunk_seconds)
    crossed = F.col("head_epoch") > F.coalesce("first_epoch", "head_epoch")
    # Counters that began after the baseline, though no snapshot before shows it.
    began = F.col("first_epoch").isNull() & (F.col("head_counting_since") > F.col("base_at"))
    reason = F.when(crossed, F.col("head_reason")).when(began, F.col("head_since_reason"))
    keys = ["target_id", "snapshot_id", "base_snapshot_id", "base_at"]
    both = both.withColumn("reason", reason)
    resets = F.greatest(F.col("head_epoch") - F.coalesce("first_epoch", "head_epoch"), F.lit(1)).alias("resets")
    return both.where(F.col("reason").isNull()).select(*keys), both.where(F.col("reason").isNotNull()).select(*keys, "reason", resets)


def comparable_only(deltas: DataFrame, resets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deltas of snapshots without a counter reset, and the reasons of the others."""
    keys = ["target_id", "snapshot_id"]
    return deltas.join(resets.select(*keys), keys, "left_anti"), resets.select(*keys, "reason")


DELTA = "target_id long, snapshot_id long, id string, subject string, severity string, before double, after double, pct_change double, first_observed long"
EVENT = "target_id long, snapshot_id long, kind string, object string, before string, after string, occurred_after long, occurred_before long, confidence double"


def all_deltas(*parts: DataFrame, spark=None, schema: str = DELTA) -> DataFrame:
    """Union of the parts; without any an empty frame of the schema."""
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def against_base(df: DataFrame, baselines: DataFrame, *measures: str) -> DataFrame:
    """A row per snapshot with the measures of its baseline as ``base_<measure>``, and when that was."""
    base = df.select("target_id", F.col("snapshot_id").alias("base_snapshot_id"), *[F.col(m).alias("base_" + m) for m in measures])
    return df.join(baselines, ["target_id", "snapshot_id"]).join(base, ["target_id", "base_snapshot_id"])


def worst_slowdown(deltas: DataFrame, *, factor: float = 2.0, min_ms: float = 10.0) -> DataFrame:
    """Per snapshot, the statement that slowed down most, among material slowdowns."""
    ratio = F.try_divide(F.col("after"), F.col("before"))
    hit = (F.col("id") == "query.mean_ms") & (F.col("before") > 0) & (F.col("after") >= min_ms) & (ratio >= factor)
    rows = deltas.where(hit).withColumn("factor", ratio)
    return rows.groupBy("target_id", "snapshot_id").agg(
        F.max("factor").alias("factor"), F.max_by("subject", F.struct("factor", "subject")).alias("subject"),
        F.max_by("before", F.struct("factor", "subject")).alias("before"),
        F.max_by("after", F.struct("factor", "subject")).alias("after"))
