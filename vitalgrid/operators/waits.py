"""Sampled sessions to wait profiles and wait roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import ratio

WINDOW = ["target_id", "window_id"]
MINUTE_DAYS = 7
HOUR_DAYS = 90
DAY = 86_400


def wait_type() -> Column:
    """A sample with no wait is on CPU."""
    return F.when(F.coalesce(F.col("wait_event_type"), F.lit("")) == "", "CPU").otherwise(F.col("wait_event_type"))


def _counts(samples: DataFrame, *keys: str) -> DataFrame:
    """Sample counts at the finest grain; everything else rolls up from these few rows."""
    return (samples.withColumn("wait_type", wait_type())
            .withColumn("event", F.coalesce("wait_event", F.lit("")))
            .groupBy(*keys, "wait_type", "event").agg(F.count("*").alias("n")))


def _with_total(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Add the profile's total. The window runs over pre-aggregated rows: statements, types and
    events, not samples, so its groups stay small however hot a target is."""
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def wait_by_type(samples: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    c = _with_total(_counts(samples, *keys), keys)
    g = c.groupBy(*keys, "wait_type").agg(F.sum("n").alias("samples"), F.max("total").alias("total"))
    return g.withColumn("share", ratio("samples", "total"))


def wait_by_event(samples: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """Named events outside CPU; shares are of all samples."""
    c = _with_total(_counts(samples, *keys), keys)
    g = c.where((F.col("wait_type") != "CPU") & (F.col("event") != ""))
    return g.select(*keys, "wait_type", F.col("event").alias("wait_event"), F.col("n").alias("samples"), "total",
                    ratio("n", "total").alias("share"))


def wait_by_query(samples: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """Per statement: share of the window, lock and IO shares, its top wait type and top event."""
    c = _with_total(_counts(samples, *keys, "query_id"), keys).where(F.coalesce(F.col("query_id"), F.lit(0)) != 0)
    c = c.withColumn("type_n", F.sum("n").over(Window.partitionBy(*keys, "query_id", "wait_type")))
    label = F.when(F.col("event") == "", F.col("wait_type")).otherwise(F.concat_ws(":", "wait_type", "event"))

    def of_type(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("wait_type") == name, F.col("n"))), F.lit(0))

    q = c.groupBy(*keys, "query_id").agg(
        F.sum("n").alias("samples"), F.max("total").alias("total"), of_type("Lock").alias("lock"), of_type("IO").alias("io"),
        F.min(F.struct((-F.col("type_n")).alias("n"), F.col("wait_type").alias("name"))).alias("top"),
        F.min(F.struct((-F.col("n")).alias("n"), label.alias("name"))).alias("top_event"))
    return q.select(*keys, "query_id", "samples", "total", ratio("samples", "total").alias("share"), ratio("lock", "samples").alias("lock_share"),
                    ratio("io", "samples").alias("io_share"), "lock", F.col("top.name").alias("top_type"), F.col("top_event.name").alias("top_event"))


def wait_summary(samples: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """One row per window: totals and the two shares the wait rules grade."""
    c = _counts(samples, *keys)
    lw = (F.col("wait_type") == "LWLock") & (F.col("event") != "")
    return c.groupBy(*keys).agg(
        F.sum("n").alias("samples"), F.coalesce(F.sum(F.when(F.col("wait_type") == "IO", F.col("n"))), F.lit(0)).alias("io"),
        F.coalesce(F.sum(F.when(F.col("wait_type") == "LWLock", F.col("n"))), F.lit(0)).alias("lwlock"),
        F.min(F.when(lw, F.struct((-F.col("n")).alias("n"), F.col("event")))).alias("top_lwlock"),
        F.min(F.when((F.col("wait_type") == "IO") & (F.col("event") != ""),
                     F.struct((-F.col("n")).alias("n"), F.col("event")))).alias("top_io"))


def profile_availability(polls: DataFrame, samples: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """A sampler whose every poll failed is unavailable; polls without samples are an idle server."""
    p = polls.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if("failed").alias("failures"))
    s = samples.groupBy(*keys).agg(F.count("*").alias("samples"))
    n = F.coalesce("samples", F.lit(0))
    state = (F.when((F.col("attempts") > 0) & (F.col("failures") == F.col("attempts")), "unavailable")
             .when(n == 0, "idle").when(n < 20, "thin").otherwise("available"))
    return p.join(s, keys, "left").select(*keys, "attempts", "failures", n.alias("samples"), state.alias("state"))


def with_statement_text(by_query: DataFrame, texts: DataFrame) -> DataFrame:
    """Attach (scrubbed) statement text; the join strategy is left to run-time sizes."""
    return by_query.join(texts.select("target_id", F.col("queryid").alias("query_id"), F.col("query").alias("sample_text")),
                         ["target_id", "query_id"], "left")


def wait_rollup_minute(samples: DataFrame) -> DataFrame:
    """Counts per (target, minute, type, event); event-less samples of a type keep an empty event."""
    minute = F.floor(F.col("sample_at") / 60).cast("long") * 60
    event = F.when(wait_type() == "CPU", F.lit("")).otherwise(F.coalesce("wait_event", F.lit("")))
    return samples.groupBy("target_id", minute.alias("bucket_at"), wait_type().alias("wait_type"),
                           event.alias("wait_event")).agg(F.count("*").alias("samples"))


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """Add roll-ups of disjoint sample sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = [c for c in out.columns if c != "samples"]
    return out.groupBy(*keys).agg(F.sum("samples").alias("samples"))


def wait_rollup_fold(rollups: DataFrame, as_of: Column | int) -> DataFrame:
    """Minute rows past seven days become hour rows; hours past ninety days go.

    ``rollups`` may already hold hour rows; the fold adds to them.
    """
    now = F.lit(as_of) if isinstance(as_of, int) else as_of
    df = rollups if "granularity" in rollups.columns else rollups.withColumn("granularity", F.lit("minute"))
    old = (F.col("granularity") == "minute") & (F.col("bucket_at") < now - MINUTE_DAYS * DAY)
    hour = F.floor(F.col("bucket_at") / 3600).cast("long") * 3600
    df = df.withColumn("bucket_at", F.when(old, hour).otherwise(F.col("bucket_at"))).withColumn(
        "granularity", F.when(old, "hour").otherwise(F.col("granularity")))
    keep = ~((F.col("granularity") == "hour") & (F.col("bucket_at") < now - HOUR_DAYS * DAY))
    return (df.where(keep).groupBy("target_id", "bucket_at", "granularity", "wait_type", "wait_event")
            .agg(F.sum("samples").alias("samples")))
