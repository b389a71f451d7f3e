"""Snapshot history: as-of look-ups, retention, trends, the stored target list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import severity_rank  # noqa: F401  (re-exported for callers)
from vitalgrid.operators.rates import reset_reason
from vitalgrid.operators.series import DAY, asof, newest_per_key, previous_row, top_k

KEYS = ["target_id"]

# History policy and comparison gates.
KEEP_ALL_DAYS = 7
KEEP_HOURLY_DAYS = 90
BASELINE_MIN_AGE = 900
YESTERDAY_SLACK = 1800
TREND_METRICS = ("tps", "cache_hit", "connections", "db_size_bytes", "dead_ratio_max", "longest_xact_s")


def fingerprint(host: Column | str, port: Column | str, database: Column | str, system_identifier: Column | str) -> Column:
    """Stable 16-digit key of a target. The database name is always part of the seed,
    because a system identifier is shared by a whole cluster."""
    c = [F.col(x) if isinstance(x, str) else x for x in (host, port, database, system_identifier)]
    seed = F.when(F.coalesce(c[3], F.lit("")) != "", F.concat_ws("|", c[3], c[2])).otherwise(F.concat_ws("|", c[0], c[1], c[2]))
    return F.substring(F.sha2(seed, 256), 1, 16)


def definition_hash(kind: Column | str, identity: Column | str, definition: Column | str) -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (kind, identity, definition)]
    return F.substring(F.sha2(F.concat_ws("\0", *c), 256), 1, 16)


def shared_fingerprints(targets: DataFrame) -> DataFrame:
    """Fingerprints used by more than one database; a run over them must be refused."""
    per_db = targets.groupBy("fingerprint", "database").agg(F.count("*").alias("n"))
    return (per_db.groupBy("fingerprint").agg(F.count("*").alias("databases"), F.sum("n").alias("targets"))
            .where(F.col("targets") > 1))


def list_baselines(snapshots: DataFrame) -> DataFrame:
    """Per target: how many snapshots, oldest, newest, and the newest database name."""
    return snapshots.groupBy(*KEYS).agg(
        F.count("*").alias("snapshots"), F.min("collected_at").alias("oldest"), F.max("collected_at").alias("newest"),
        F.max_by("database", "collected_at").alias("database"))


def previous_snapshot(snapshots: DataFrame, min_age: int, columns: list[str], *, chunk_seconds: int = DAY) -> DataFrame:
    """Newest snapshot at least ``min_age`` seconds older than each snapshot.

    Age zero means the one before: a snapshot is not its own baseline.
    """
    if min_age == 0:
        return previous_row(snapshots, KEYS, "collected_at", columns, prefix="base_", chunk_seconds=chunk_seconds)
    return asof(snapshots, snapshots, KEYS, F.col("collected_at") - min_age, "collected_at", columns,
                chunk_seconds=chunk_seconds)


def baseline_choice(snapshots: DataFrame, columns: list[str], *, min_age: int = BASELINE_MIN_AGE,
                    chunk_seconds: int = DAY) -> DataFrame:
    """A baseline old enough to be meaningful, else simply the previous snapshot."""
    aged = asof(snapshots, snapshots, KEYS, F.col("collected_at") - min_age, "collected_at", columns, prefix="aged_",
                chunk_seconds=chunk_seconds)
    both = previous_row(aged, KEYS, "collected_at", columns, prefix="last_", chunk_seconds=chunk_seconds)
    have_aged = F.col(f"aged_{columns[0]}").isNotNull()
    return both.select(*snapshots.columns, *[
        F.when(have_aged, F.col("aged_" + c)).otherwise(F.col("last_" + c)).alias("base_" + c) for c in columns])


def same_hour_yesterday(snapshots: DataFrame, columns: list[str], *, chunk_seconds: int = DAY) -> DataFrame:
    """Nearest snapshot to 24 hours earlier, within half an hour either way."""
    return asof(snapshots, snapshots, KEYS, F.col("collected_at") - DAY, "collected_at", columns,
                nearest_within=YESTERDAY_SLACK, chunk_seconds=chunk_seconds)


def diff_since(snapshots: DataFrame, since: int, *, chunk_seconds: int = DAY) -> DataFrame:
    """For each target's newest snapshot: the baseline at least ``since`` older, and how honest it is.

    Flags an interval over 1.25 times the requested one, a reset in between, and statement evictions.
    """
    latest = newest_per_key(snapshots, KEYS, [F.col("collected_at").desc(), F.col("snapshot_id").desc()])
    carry = ["snapshot_id", "collected_at", "stats_reset_at", "postmaster_start_at", "dealloc"]
    j = asof(latest, snapshots, KEYS, F.col("collected_at") - since, "collected_at", carry, chunk_seconds=chunk_seconds)
    actual = F.col("collected_at") - F.col("base_collected_at")
    return j.where(F.col("base_snapshot_id").isNotNull()).select(
        "target_id", "snapshot_id", "base_snapshot_id", F.lit(since).cast("long").alias("requested_seconds"),
        actual.alias("actual_seconds"), (actual > 1.25 * since).alias("stretched"),
        reset_reason(F.col("base_stats_reset_at"), F.col("stats_reset_at"),
                     F.col("base_postmaster_start_at"), F.col("postmaster_start_at")).alias("reset_reason"),
        (F.col("dealloc") > F.col("base_dealloc")).alias("statements_evicted"))


def retention_thin(snapshots: DataFrame, as_of: Column | int) -> DataFrame:
    """Keep everything for a week, the last-written snapshot per hour up to 90 days, nothing older.

    The hourly pick is a partial aggregate, so even a hot target's old rows shrink before
    they are shuffled.
    """
    now = F.lit(as_of) if isinstance(as_of, int) else as_of
    recent = snapshots.where(F.col("collected_at") >= now - KEEP_ALL_DAYS * DAY)
    aging = snapshots.where((F.col("collected_at") < now - KEEP_ALL_DAYS * DAY)
                            & (F.col("collected_at") >= now - KEEP_HOURLY_DAYS * DAY))
    hour = F.floor(F.col("collected_at") / 3600).cast("long")
    others = [c for c in snapshots.columns if c not in ("target_id", "snapshot_id")]
    hourly = aging.groupBy("target_id", hour.alias("_hour")).agg(
        F.max("snapshot_id").alias("snapshot_id"), *[F.max_by(c, "snapshot_id").alias(c) for c in others])
    return recent.unionByName(hourly.select(*snapshots.columns))


def history_budget(snapshots: DataFrame, budget_bytes: int) -> DataFrame:
    """Drop the oldest snapshots of a store that is over its byte budget, never the newest.

    One lazy plan. How many go follows from the totals; which second that count falls into follows from counts per day and per
    second, summed up within days; ids are ranked inside that one second only. The log itself is never sorted.
    """
    day = F.floor(F.col("collected_at") / DAY).cast("long")
    seconds = snapshots.groupBy(day.alias("_day"), "collected_at").agg(F.count("*").alias("n"), F.sum("doc_bytes").alias("size"))
    days = seconds.groupBy("_day").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    every = Window.partitionBy(F.lit(1))
    rows, size = F.sum("n").over(every), F.sum("size").over(every)
    wanted = F.greatest(F.ceil(rows * (size - F.lit(budget_bytes * 9 // 10)) / size).cast("long"), F.lit(1))
    evict = F.when((size > budget_bytes) & (rows > 1), F.least(wanted, rows - 1)).otherwise(F.lit(0))
    placed = days.select("_day", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_earlier"), evict.cast("long").alias("_evict"))
    inside = Window.partitionBy("_day").orderBy("collected_at").rowsBetween(Window.unboundedPreceding, -1)
    marks = seconds.join(placed, "_day").withColumn("_before", F.col("_earlier") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    here = (F.col("_evict") > F.col("_before")) & (F.col("_evict") <= F.col("_before") + F.col("n"))
    cut = marks.where(here).agg(F.max("collected_at").alias("_cut"), F.max(F.col("_evict") - F.col("_before")).alias("_rest"))  # always one row
    log = snapshots.crossJoin(F.broadcast(cut))
    later = log.where(F.col("_cut").isNull() | (F.col("collected_at") > F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy("collected_at").orderBy("snapshot_id"))
    at_cut = log.where(F.col("collected_at") == F.col("_cut")).withColumn("_rank", rank).where(F.col("_rank") > F.col("_rest"))
    return later.select(*snapshots.columns).unionByName(at_cut.select(*snapshots.columns))


def latest_two_schemas(objects: DataFrame) -> DataFrame:
    """Objects of each target's two newest schema snapshots; only the snapshot list is ranked."""
    heads = objects.select("target_id", "snapshot_id").distinct()
    kept = top_k(heads, KEYS, [F.col("snapshot_id").desc()], 2, "age_rank")
    return objects.join(kept, ["target_id", "snapshot_id"])


def extract_scalars(health: DataFrame, tables: DataFrame | None = None, activity: DataFrame | None = None) -> DataFrame:
    """Trend scalars of each snapshot."""
    snap = ["target_id", "snapshot_id"]
    out = health.select(*snap, "collected_at", "tps", F.col("cache_hit_ratio").alias("cache_hit"),
                        F.when(F.col("connections") > 0, F.col("connections")).alias("connections"))
    if tables is not None:
        g = tables.groupBy(*snap).agg(F.sum("total_bytes").alias("db_size_bytes"),
                                      F.max("dead_ratio").alias("dead_ratio_max"))
        out = out.join(g, snap, "left")
    if activity is not None:
        out = out.join(activity.select(*snap, F.col("longest_xact_s")), snap, "left")
    return out


def trend(scalars: DataFrame, metric: str, n: int = 24) -> DataFrame:
    """Last ``n`` known values of one metric per target, oldest first."""
    if metric not in TREND_METRICS:
        raise ValueError(f"unknown trend metric {metric!r}; one of {', '.join(TREND_METRICS)}")
    known = scalars.where(F.col(metric).isNotNull())
    last = top_k(known, KEYS, [F.col("collected_at").desc(), F.col("snapshot_id").desc()], n, "_r")
    return last.groupBy(*KEYS).agg(
        F.count("*").alias("points"),
        F.transform(F.array_sort(F.collect_list(F.struct("collected_at", F.col(metric).alias("v")))), lambda x: x["v"]).alias("series"))


def recent_events(events: DataFrame, n: int) -> DataFrame:
    return top_k(events, KEYS, [F.col("occurred_before").desc(), F.col("kind"), F.col("object")], n)


def latest_verdicts(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Newest verdict per index; the form an upsert takes in an append-only table."""
    return newest_per_key(verdicts, key, [F.col("checked_at").desc()])


def dead_rules(runs: DataFrame, *, misses: int = 5, chunk_runs: int = 1024) -> DataFrame:
    """Per run, rules whose last match is at least ``misses`` runs back.

    Run positions and last matches are computed inside run chunks and carried over from
    a per-chunk summary, like the other series operators.
    """
    keys = ["target_id", "rule"]
    c = runs.withColumn("_chunk", F.floor(F.col("run") / chunk_runs).cast("long"))
    w = Window.partitionBy(*keys, "_chunk").orderBy("run")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_pos", F.row_number().over(w))
    c = c.withColumn("_hit", F.max(F.when(F.col("matched"), F.col("_pos"))).over(upto))
    edge = c.groupBy(*keys, "_chunk").agg(F.count("*").alias("n"), F.max(F.when(F.col("matched"), F.col("_pos"))).alias("hit"))
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_offset", F.coalesce(F.sum("n").over(prior), F.lit(0)))
    edge = edge.withColumn("_hit_before", F.coalesce(F.max(F.col("_offset") + F.col("hit")).over(prior), F.lit(0)))
    j = c.join(edge.select(*keys, "_chunk", "_offset", "_hit_before"), [*keys, "_chunk"])
    since = F.col("_offset") + F.col("_pos") - F.coalesce(F.col("_offset") + F.col("_hit"), F.col("_hit_before"))
    return j.select(*keys, "run", since.alias("misses")).where(F.col("misses") >= misses)
