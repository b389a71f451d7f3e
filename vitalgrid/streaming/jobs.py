"""Streaming forms of the jobs, each with the same results as its batch twin.

Wait roll-ups, sliding profiles and incident sessions are event-time aggregations with a
watermark. When a finite stream has ended, what its windows still hold is read from the
operator's own state, so nothing waits for a later event that never comes.

Counter rates and finding transitions need the previous run of every target in a batch;
they run per micro-batch over the batch plus the carried rows of the buckets its targets
hash to. Only those buckets are written anew. Ordering, late rows and hot targets are
handled by the same window operators as in batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalgrid.functions.numbers import ratio, severity_rank
from vitalgrid.operators.rates import HEALTH_COUNTERS, health_rates
from vitalgrid.operators.series import previous_row
from vitalgrid.operators.waits import wait_type
from vitalgrid.session import staging_path

# --- event-time aggregations ----------------------------------------------------


def _timed(samples: DataFrame, delay: str) -> DataFrame:
    """Samples with a watermarked event time and the CPU bucket filled in."""
    event = F.when(wait_type() == "CPU", F.lit("")).otherwise(F.coalesce("wait_event", F.lit("")))
    return (samples.withColumn("event_time", F.timestamp_seconds("sample_at")).withColumn("wait_type", wait_type())
            .withColumn("wait_event", event).withWatermark("event_time", delay))


def _epoch(c: Column) -> Column:
    return F.unix_seconds(c)


def wait_rollup(samples: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Counts per target, minute, wait type and event. Rows later than the watermark are dropped."""
    g = _timed(samples, delay).groupBy(F.window("event_time", "1 minute"), "target_id", "wait_type", "wait_event").agg(F.count("*").alias("samples"))
    return g.select("target_id", _epoch(F.col("window.start")).alias("bucket_at"), "wait_type", "wait_event", "samples")


def wait_profile(samples: DataFrame, *, length: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Counts per sliding window and wait type; ``profile_shares`` turns finished windows to shares."""
    g = _timed(samples, delay).groupBy(F.window("event_time", length, slide), "target_id", "wait_type").agg(F.count("*").alias("samples"))
    return g.select("target_id", _epoch(F.col("window.start")).alias("window_start"), "wait_type", "samples")


def profile_shares(counts: DataFrame) -> DataFrame:
    keys = ["target_id", "window_start"]
    total = counts.groupBy(*keys).agg(F.sum("samples").alias("total"))
    return counts.join(total, keys).withColumn("share", ratio("samples", "total"))


def incident_sessions(samples: DataFrame, *, gap: str = "2 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of lock-waiting samples of one statement, closed by a quiet gap."""
    locks = _timed(samples, delay).where(F.col("wait_type") == "Lock")
    g = locks.groupBy(F.session_window("event_time", gap), "target_id", "query_id").agg(F.count("*").alias("samples"))
    return g.select("target_id", "query_id", _epoch(F.col("session_window.start")).alias("started_at"),
                    _epoch(F.col("session_window.end")).alias("ended_at"), "samples")


# --- run-over-run jobs ----------------------------------------------------------


BUCKETS = 256


class CarriedState:
    """Rows handed from one micro-batch to later ones, in hash buckets of targets.

    A batch reads the buckets of its own targets and writes those anew; a manifest says which batch wrote a bucket last. What a
    batch writes so follows the batch, not the fleet. A batch that is retried overwrites its own folders and reads what the
    batch before it left, so results do not depend on how often it ran. Versions that no batch can ask for again are deleted.
    """

    def __init__(self, root: str, buckets: int = BUCKETS):
        self.root, self.buckets = root, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("target_id"), F.lit(self.buckets)).cast("int")

    def output(self, batch_id: int) -> str:
        return os.path.join(self.root, "out", f"batch={batch_id}")

    def state(self, batch_id: int) -> str:
        return os.path.join(self.root, "state", f"batch_{batch_id}")

    def manifest(self, batch_id: int) -> str:
        return os.path.join(self.root, "manifest", f"batch_{batch_id}")

    def held(self, spark, batch_id: int) -> dict[int, int]:
        """The batch that wrote each bucket last, after batch ``batch_id``; at most one entry per bucket."""
        if batch_id < 0:
            return {}
        rows = spark.read.schema("bucket int, batch long").parquet(self.manifest(batch_id)).collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def touched(self, batch: DataFrame) -> list[int]:
        return [r[0] for r in batch.select(self.bucket()).distinct().collect()]

    def read_previous(self, batch: DataFrame, held: dict[int, int], touched: list[int]) -> DataFrame:
        """Carried rows of the batch's buckets, empty at the start."""
        paths = [os.path.join(self.state(held[b]), f"bucket={b}") for b in touched if b in held]
        if not paths:
            return batch.limit(0)
        return batch.sparkSession.read.schema(batch.schema).parquet(*paths)

    def write(self, rows: DataFrame, batch_id: int, held: dict[int, int], touched: list[int]) -> None:
        spark = rows.sparkSession
        kept = rows.withColumn("bucket", self.bucket())
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.state(batch_id))
        full = {r[0] for r in spark.read.schema(kept.schema).parquet(self.state(batch_id)).select("bucket").distinct().collect()}
        now = {**{b: n for b, n in held.items() if b not in touched}, **{b: batch_id for b in full}}
        spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(self.manifest(batch_id))

    def forget(self, spark, batch_id: int) -> None:
        """Delete what batch ``batch_id`` superseded; called once a later batch runs, so it cannot be asked for again."""
        old, new = self.held(spark, batch_id - 1), self.held(spark, batch_id)
        for b, n in old.items():
            if new.get(b) != n:
                _delete(spark, os.path.join(self.state(n), f"bucket={b}"))
        if batch_id > 0:
            _delete(spark, self.manifest(batch_id - 1))

    def results(self, spark) -> DataFrame:
        return spark.read.parquet(os.path.join(self.root, "out")).drop("batch")


def _path(spark, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _delete(spark, uri: str) -> None:
    system, path = _path(spark, uri)
    system.delete(path, True)


def _exists(spark, uri: str) -> bool:
    system, path = _path(spark, uri)
    return system.exists(path)


def _carry(stream: DataFrame, root: str, process: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame],
           fresh: Callable[[DataFrame, DataFrame], DataFrame], expire_after: int | None = None, at: str = "collected_at", **trigger) -> StreamingQuery:
    """``expire_after``: targets whose carried row is that much older than the batch's newest are forgotten when their bucket is written."""
    state = CarriedState(root)

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = state.held(spark, batch_id - 1)
        if batch_id > 0 and _exists(spark, state.manifest(batch_id - 2)):
            state.forget(spark, batch_id - 1)
        touched = state.touched(batch)
        old = state.read_previous(batch, held, touched)
        both = fresh(batch, old).withColumn("_carried", F.lit(False)).unionByName(old.withColumn("_carried", F.lit(True))).persist()
        try:
            process(both).write.mode("overwrite").parquet(state.output(batch_id))
            rows = keep(both.drop("_carried"))
            if expire_after is not None:
                newest = both.agg(F.max(at)).first()[0]
                rows = rows.where(F.col(at) >= (newest or 0) - expire_after)
            state.write(rows, batch_id, held, touched)
        finally:
            both.unpersist()

    return (stream.writeStream.foreachBatch(one).option("checkpointLocation", os.path.join(root, "checkpoint"))
            .trigger(**(trigger or {"availableNow": True})).start())


def counter_rates(stream: DataFrame, root: str, expire_after: int | None = None, **trigger) -> StreamingQuery:
    """Health rates as counters arrive. Samples not newer than a target's last one are dropped."""
    columns = ["target_id", "snapshot_id", "collected_at", "numbackends", *HEALTH_COUNTERS, "stats_reset_at", "postmaster_start_at"]

    def fresh(batch: DataFrame, old: DataFrame) -> DataFrame:
        seen = old.select("target_id", F.col("collected_at").alias("_seen"))
        return batch.join(seen, "target_id", "left").where(F.col("_seen").isNull() | (F.col("collected_at") > F.col("_seen"))).drop("_seen")

    def process(both: DataFrame) -> DataFrame:
        carried = both.where("_carried").select("target_id", "collected_at").withColumn("_c", F.lit(True))
        return health_rates(both.drop("_carried")).join(carried, ["target_id", "collected_at"], "left_anti")

    def keep(both: DataFrame) -> DataFrame:
        return both.groupBy("target_id").agg(*[F.max_by(c, "collected_at").alias(c) for c in both.columns if c != "target_id"]).select(*both.columns)

    return _carry(stream.select(*columns), root, process, keep, fresh, expire_after, **trigger)


def finding_transitions(findings: DataFrame) -> DataFrame:
    """Opened, escalated and closed findings between a target's consecutive runs.

    Rows: target_id, run, id, object, severity. A row with an empty id only says that the run
    took place. A target's first run opens all of its findings.
    """
    runs = findings.select("target_id", "run").distinct()
    order = previous_row(runs, ["target_id"], "run", ["run"], prefix="prev_")
    key = ["target_id", "run", "id", "object"]
    real = findings.where(F.col("id") != "")
    now = real.groupBy(*key).agg(F.max(severity_rank("severity")).alias("rank"))
    before = (now.withColumnsRenamed({"run": "prev_run", "rank": "prev_rank"})
              .join(order.where(F.col("prev_run").isNotNull()), ["target_id", "prev_run"]).drop("prev_run"))
    both = now.join(before, key, "full_outer")
    change = (F.when(F.col("prev_rank").isNull(), "opened").when(F.col("rank").isNull(), "closed")
              .when(F.col("rank") > F.col("prev_rank"), "escalated"))
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(*key, "change")


def stream_transitions(stream: DataFrame, root: str, expire_after: int | None = None, **trigger) -> StreamingQuery:
    columns = ["target_id", "run", "id", "object", "severity"]

    def fresh(batch: DataFrame, old: DataFrame) -> DataFrame:
        seen = old.groupBy("target_id").agg(F.max("run").alias("_seen"))
        return batch.join(seen, "target_id", "left").where(F.col("_seen").isNull() | (F.col("run") > F.col("_seen"))).drop("_seen")

    def process(both: DataFrame) -> DataFrame:
        # The carried run is context only; what it opened was reported when it arrived.
        carried = both.where("_carried").select("target_id", "run").distinct()
        return finding_transitions(both.drop("_carried")).join(carried, ["target_id", "run"], "left_anti")

    def keep(both: DataFrame) -> DataFrame:
        last = both.groupBy("target_id").agg(F.max("run").alias("run"))
        return both.join(last, ["target_id", "run"]).select(*both.columns)

    return _carry(stream.select(*columns), root, process, keep, fresh, expire_after, "run", **trigger)


# --- running a finite stream to its end -----------------------------------------


def open_rollup(state: DataFrame) -> DataFrame:
    """Minutes of ``wait_rollup`` that are still open."""
    k = F.col("key")
    return state.select(k["target_id"].alias("target_id"), _epoch(k["window"]["start"]).alias("bucket_at"), k["wait_type"].alias("wait_type"), k["wait_event"].alias("wait_event"),
                        F.col("value.count").alias("samples"))


def open_profile(state: DataFrame) -> DataFrame:
    """Windows of ``wait_profile`` that are still open."""
    k = F.col("key")
    return state.select(k["target_id"].alias("target_id"), _epoch(k["window"]["start"]).alias("window_start"), k["wait_type"].alias("wait_type"), F.col("value.count").alias("samples"))


def open_sessions(state: DataFrame) -> DataFrame:
    """Sessions of ``incident_sessions`` that are still open."""
    v = F.col("value")
    return state.select(v["target_id"].alias("target_id"), v["query_id"].alias("query_id"), _epoch(v["session_window"]["start"]).alias("started_at"),
                        _epoch(v["session_window"]["end"]).alias("ended_at"), v["count"].alias("samples"))


def drain(df: DataFrame, name: str, still_open: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run an append-mode stream over what is available now and return what it emitted.

    With ``still_open`` the stream is taken to have ended: windows and sessions that its watermark has not closed are read
    from the operator's state, as one of the functions above lays them out, and come along.
    """
    spark = df.sparkSession
    root = staging_path(spark, name)
    out, checkpoint = os.path.join(root, "out"), os.path.join(root, "checkpoint")
    q = (df.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    emitted = spark.read.schema(df.schema).parquet(out)
    if still_open is None or not _exists(spark, os.path.join(checkpoint, "state", "0", "0")):
        return emitted
    rest = still_open(spark.read.format("statestore").load(checkpoint))
    return emitted.unionByName(rest.select(*[F.col(f.name).cast(f.dataType) for f in df.schema]))


def drain_carried(start: Callable[[str], StreamingQuery], spark, name: str) -> DataFrame:
    root = staging_path(spark, name)
    start(root).awaitTermination()
    return CarriedState(root).results(spark)
